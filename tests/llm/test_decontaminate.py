import random

from kohesion.llm import decontaminate as dc


def brute(docs, items, k=5, threshold=0.8):
    out = set()
    for d, text in docs:
        words = (text or "").encode().lower().split()
        for i, item in items:
            width, shingles = dc.item_shingles(item, k)
            if not shingles:
                continue
            own = {b" ".join(words[j : j + width]) for j in range(len(words) - width + 1)}
            n = len(shingles & own)
            if n >= dc.needed(len(shingles), threshold):
                out.add((d, i, n, len(shingles)))
    return out


def found(df):
    return {(r["doc_id"], r["item_id"], r["shared"], r["item_size"]) for r in df.collect()}


def corpus():
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 9, 20, 60])))) for i in range(40)]
    items += [(90, None), (91, ""), (92, "only once"), (92, "only once"), (93, "rep rep rep rep rep rep rep rep")]
    rows = []
    for d in range(60):
        text = [word() for _ in range(rnd.choice([3, 50, 3000]))]
        own = rnd.choice(items)[1] or ""
        words = own.split()
        for _ in range(rnd.randrange(3)):
            if words:
                words[rnd.randrange(len(words))] = "changed"
        at = rnd.randrange(len(text) + 1)
        rows.append((d, " ".join([*text[:at], *[w.upper() for w in words], *text[at:]])))
    rows += [(100, None), (101, ""), (None, "x only once y"), (102, "rep " * 50), (102, "rep " * 50)]
    return rows, items


def test_matches_brute_force(spark, docs, clashing):
    rows, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = docs(rows, clashing)
    assert found(dc.find_contained(table, benchmark)) == brute(rows, items)
    assert found(dc.find_contained(table, benchmark, threshold=1.0)) == brute(rows, items, threshold=1.0)
    # Several blocks of items give the same matches.
    assert found(dc.find_contained(table, benchmark, block_chars=300)) == brute(rows, items)
    clean = dc.drop_contaminated(table, benchmark)
    bad = {d for d, *_ in brute(rows, items)}
    assert clean.columns == table.columns
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted((d for d, _ in rows if d not in bad), key=str)
    assert clean.count() == dc.drop_contaminated(table, benchmark, block_chars=300).count()


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_contained(docs([(1, "a")]), none).count() == 0
    assert dc.find_contained(docs([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert dc.drop_contaminated(docs([(1, "a")]), none).count() == 1


def test_short_items_in_long_documents(spark, docs):
    item = " ".join(f"q{i}" for i in range(14))
    far = " ".join(f"f{i}" for i in range(20_000))
    rows = [(1, f"{far} {item} {far}"), (2, far), (3, f"{item[:20]} {far}")]
    got = dc.find_contained(docs(rows), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["containment"]) for r in got] == [(1, 7, 1.0)]
