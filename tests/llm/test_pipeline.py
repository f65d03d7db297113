import inspect

import corpus_pipeline
import numpy as np
from kohesion.llm import decontaminate, quality, simhash, tokens
from kohesion.llm._store import save
from kohesion.llm.queries import END_ID, oracle_sql, queries, vocabulary


def test_shape():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 == len(set(names))
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
    assert sorted(int(q[2:].split("_")[0]) for q in queries() if q.startswith("op")) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for (name, stage), check in zip(corpus_pipeline.STAGES, (check_quality, check_dedup, check_decontamination, check_mix, check_tokens), strict=True):
        out = save(stage(spark, docs, sf), "stage-test")
        if name != "token_output":
            assert out.columns == columns
        check(spark, docs, out, sf)
        docs = out
    final = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, docs.collect()))


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def check_quality(spark, before, after, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {i for i, _ in texts(after)}
    assert kept <= {i for i, _ in texts(before)}
    assert np.mean([i in kept for i, q in labels.items() if q == 1]) > 0.95
    assert np.mean([i in kept for i, q in labels.items() if q == 0]) < 0.2
    assert quality.keep_good(before, quality.fit_quality(before)).count() == after.count()


def check_dedup(spark, before, after, sf):
    from test_near_similarity import exact_pairs, kept_of

    rows = texts(before)
    assert sorted(i for i, _ in texts(after)) == sorted(kept_of(rows, exact_pairs(rows)))
    assert after.count() < before.count()


def check_decontamination(spark, before, after, sf):
    from test_decontaminate import brute

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, *_ in brute(texts(before), items)}
    assert bad and sorted(texts(after)) == sorted((i, t) for i, t in texts(before) if i not in bad)
    assert decontaminate.THRESHOLD == 0.8


def check_mix(spark, before, after, sf):
    assert set(texts(after)) <= set(texts(before))
    assert abs(after.count() - before.count()) < 5 * before.count() ** 0.5


def check_tokens(spark, before, after, sf):
    own, start = tokens.Encoder(vocabulary()), 0
    rows = sorted(texts(before))
    got = sorted(map(tuple, after.select("start", "doc_id", "n_tokens").collect()))
    assert END_ID == 2 and len(got) == len(rows)
    for (at, i, n), (j, t) in zip(got, rows, strict=True):
        assert (at, i, n) == (start, j, len(own.encode_many([t or ""])[0]) // 4 + 1)
        start += n


def test_stages_take_odd_rows_and_names(spark, docs, clashing, sf):
    good = [f"The house by the river number {i} is old, and the people who live in it were there before the war; they said it will stay. " * 4 for i in range(40)]
    rows = [*enumerate(good), (50, None), (51, ""), (None, good[0]), (None, None), (52, good[1]), (52, good[1]), (53, "word " * 100_000), (54, good[2], None), (55, good[3] + "more", "src1")]
    table = docs(rows, clashing)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = save(stage(spark, table, sf), f"test-{name}")
        assert after.columns == table.columns and set(texts(after)) <= set(texts(table)), name
        table = after
    assert not any(t is None or not t.strip() for _, t in texts(table))
    got = corpus_pipeline.STAGES[-1][1](spark, table, sf).collect()
    assert len(got) == table.count()


def test_stages_take_an_empty_table(spark, docs, clashing, sf):
    table = docs([], clashing)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = save(stage(spark, table, sf), f"test-{name}")
        assert table.count() == 0 and table.columns == docs([], clashing).columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, table, sf).count() == 0
