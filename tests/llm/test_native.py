"""Line deduplication, source mixing and secret scans."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from kohesion.llm import lines, mixing, secrets
from pyspark.sql import functions as F

# ---------------------------------------------------------------- lines


def brute_lines(rows, ratio, least):
    pages, holds = Counter(), defaultdict(Counter)
    for host, text in rows:
        pages[host] += 1
        holds[host].update({x.strip(" ") for x in (text or "").split("\n")} - {""})
    return ["\n".join(x for x in (text or "").split("\n") if not (pages[host] >= least and holds[host][x.strip(" ")] > ratio * pages[host])) for host, text in rows]


def test_lines_match_brute_force(docs, clashing):
    rnd = random.Random(0)
    rows = []
    for i in range(300):
        host = rnd.choice(["a", "a", "a", "b", "c", None])
        own = [rnd.choice(["menu", " menu ", "footer", "", f"line {rnd.randrange(50)}", f"own {i}"]) for _ in range(rnd.randrange(6))]
        rows.append((i, "\n".join(own), host))
    rows += [(400, None, "a"), (401, "", "b"), (402, "menu", "rare"), (403, "menu\n" * 3000 + "x", "a"), (404, "menu", "a"), (404, "menu", "a")]
    table = docs(rows, clashing)
    for ratio, least in ((0.3, 5), (0.05, 1)):
        out = lines.drop_site_lines(table, F.col("source"), lines.text_lines(F.col("text")), ratio, 1, least)
        got = Counter((r["row"]["doc_id"], r["clean"], r["n_lines"] - r["n_dropped"]) for r in out.collect())
        clean = brute_lines([(h, t) for _, t, h in rows], ratio, least)
        kept = [len(c.split("\n")) if c or not t else None for c, (_, t, _) in zip(clean, rows, strict=True)]
        assert Counter(g[:2] for g in got) == Counter({(i, c): 1 for (i, _, _), c in zip(rows, clean, strict=True)})
        assert all(k is None or any(g[0] == i and g[2] == k for g in got) for k, (i, _, _) in zip(kept, rows, strict=True))
        assert out.select("row.*").columns == table.columns
    assert lines.drop_site_lines(docs([]), F.col("source"), lines.text_lines(F.col("text"))).count() == 0


def test_html_lines_and_hosts(spark):
    rows = [
        ("HTTP://A.Example:80/x?y#z", "<html><body class='x'><p>one <b>two</b></p><br/>three<P>four</p ><pre>five\nsix</pre><span>in</span>line"),
        ("no host", None), (None, ""), ("ftp://b/", "<paragraph>kept</paragraph><LI>li"),
    ]
    got = spark.createDataFrame(rows, "u string, h string").select(lines.url_host(F.col("u")).alias("u"), lines.html_lines(F.col("h")).alias("h")).collect()
    assert [r["u"] for r in got] == ["a.example", None, None, "b"]
    assert [r["h"] for r in got] == [["one two", "three", "four", "five", "six", "inline"], [], [], ["kept", "li"]]


# ---------------------------------------------------------------- mixing


def brute_count(seed, doc_id, rate):
    u = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}:0".encode()).hexdigest()[:13], 16) / 16**13
    p = total = math.exp(-rate)
    k = 0
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mix_matches_brute_force(docs, clashing):
    rows = [(i, f"text {i}", "big" if i % 3 else f"s{i % 5}") for i in range(400)] + [(500, None, None), (501, "", None), (None, "n", "big"), (502, "r", "big"), (502, "r", "big")]
    table = docs(rows, clashing)
    sizes = Counter(r[2] for r in rows)
    for weights in (None, {"big": 1.0, "s0": 3.0}):
        w = {s: n**0.5 if weights is None else weights.get(s, 0.0) for s, n in sizes.items()}
        rate = {s: w[s] / sum(w.values()) * len(rows) / sizes[s] for s in sizes}
        want = Counter()
        for i, _, s in rows:
            want[i] += brute_count(17, i, rate[s]) if rate[s] else 0
        mixed = mixing.mix_sources(table, weights)
        got = mixed.collect()
        assert Counter(r["row"]["doc_id"] for r in got) == +want
        assert mixed.select("row.*").columns == table.columns
        order = [r["order"] for r in got]
        assert order == sorted(order)
    assert mixing.mix_sources(docs([])).count() == 0
    long = mixing.mix_sources(docs([(1, "word " * 400_000, "a")]), total=3).collect()
    assert all(len(r["row"]["text"]) == 2_000_000 for r in long)


def test_mix_meets_its_weights(docs):
    rows = [(i, "t", "a" if i < 4000 else "b") for i in range(6000)]
    got = Counter(r["row"]["source"] for r in mixing.mix_sources(docs(rows), {"a": 1, "b": 4}, total=10_000).collect())
    assert abs(got["a"] - 2000) < 200 and abs(got["b"] - 8000) < 400


def test_large_rates_are_drawn_in_parts(docs):
    got = mixing.mix_sources(docs([(1, "t", "a"), (2, "t", "a")]), total=4000)
    counts = Counter(r["row"]["doc_id"] for r in got.collect())
    assert all(abs(n - 2000) < 250 for n in counts.values())


# ---------------------------------------------------------------- secrets


def brute_spans(text):
    kinds = [(n, p, g, m) for n, p, g, m in (("assign", secrets.ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))]
    out = [(m.start(), i, m.end(), n) for i, (n, p, g, least) in enumerate(kinds) for m in re.finditer(p, text or "", re.ASCII) if len(m.group(g)) >= least]
    return sorted(out)


TRICKY = [
    None, "", "token=secret:longvalue1234", "token=secret=abcdefghij", "PassWord : 'hunter2hunter2' apikey=\"abc\" API_KEY:abcdefgh", "🙂🙂 secret=ABCDEFGHIJ é token='x'",
    "AKIA AKIAAKIA AKIAABCDEFGHIJKL AKIASHORT", "x" + "0123456789abcdef" * 3 + "g" + "a" * 31 + " " + "b" * 32, "secret=" + "0123456789abcdef" * 2, "token==abcdefgh", "secret: : abcdefgh",
    "ſecret=abcdefgh toKen=abcdefgh", "password=\nabcdefgh", "secret=aaaa,secret=bbbbbbbb", "a" * 40 + "AKIA" + "B" * 12 + "token=" + "c" * 40,
]


def spans_of(df):
    return {r["id"]: r for r in df.collect()}


def test_base_spans_match_brute_force(docs, clashing):
    rnd = random.Random(1)
    parts = ["token", "secret", "=", ":", " ", '"', "'", "AKIA", "abcdef01" * 4, "ABCDEFGH1234", "é", "🙂", "x", "password", "api_key", "apikey", "deadbeef", "\n"]
    rows = list(enumerate(TRICKY + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(300)]))
    got = spans_of(secrets.find_secrets(docs(rows, clashing)))
    for i, text in rows:
        want = brute_spans(text)
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in got[i]["base"]] == want, text
        assert set(got[i]["base"]) <= set(got[i]["found"])
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(s[1] == k for s in want) for k in range(3))


def test_random_tokens_are_found_and_words_are_not(docs):
    rnd = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    plain = ["getElementByIdentifierOrName", "chapter_12_of_the_long_story", "some/path/to/a/file/in/2024/here", "ThisIsACamelCaseNameForAClass1", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "1234567890123456789012345678"]
    rows = [(i, f"here is {t} in a text") for i, t in enumerate(plain)]
    rows += [(100 + i, "the key " + "".join(rnd.choice(letters) for _ in range(40)) + " leaked") for i in range(20)]
    got = spans_of(secrets.find_secrets(docs(rows)))
    assert [i for i in range(len(plain)) if got[i]["found"]] == []
    hits = [got[100 + i]["found"] for i in range(20)]
    assert sum(bool(h) for h in hits) >= 19
    assert all(h[0]["start"] == 8 and h[0]["end"] == 48 and h[0]["kind"] == "random" for h in hits if h)


def test_p_values_match_scipy_free_reference(spark):
    for z in (-3.0, -0.5, 0.0, 0.5, 1.96, 4.0):
        got = spark.range(1).select(secrets.normal_tail(F.lit(z)).alias("p")).first()["p"]
        assert got == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=2e-7)


def test_secret_edge_rows(docs):
    rows = [(1, None), (None, "token=abcdefgh"), (2, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "word " * 100_000 + "secret=abcdefgh")]
    got = sorted((str(r["id"]), r["n_assign"], r["base"][0]["start"] if r["base"] else None) for r in secrets.find_secrets(docs(rows)).collect())
    assert got == [("1", 0, None), ("2", 1, 0), ("2", 1, 0), ("3", 1, 500_000), ("None", 1, 0)]
    assert secrets.find_secrets(docs([])).count() == 0
