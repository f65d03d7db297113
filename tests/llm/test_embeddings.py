import numpy as np
from kohesion.llm import embeddings
from pyspark.sql import types as T

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold):
    """{row number: (links, component)}."""
    ok, unit = [], {}
    for i, (vid, x, label) in enumerate(rows):
        if vid is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x) or not any(x):
            continue
        v = np.array(x, np.float32).astype(float)
        v = v / np.abs(v).max()
        unit[i] = v / np.linalg.norm(v)
        ok.append(i)
    root, links = {r[0]: r[0] for r in rows if r[0] is not None}, {i: 0 for i in range(len(rows))}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return {i: (rows[i][0], links[i], None if rows[i][0] is None else find(rows[i][0])) for i in range(len(rows))}


def clustered(n, copies, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    x = np.concatenate([base] + [base[: n // 4] + 0.08 * rng.normal(size=(n // 4, dim)) for _ in range(copies)])
    return x[rng.permutation(len(x))]


def test_matches_brute_force(spark):
    x = clustered(400, 4)
    rows = [(int(i), [float(v) for v in row], int(i % 3)) for i, row in enumerate(x)]
    got = {r["id"]: (r["n_links"], r["component"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA), 0.93).collect()}
    want = brute(rows, 0.93)
    links = sum(w[1] for w in want.values())
    assert links > 300
    # Nothing that isn't linked is reported, and nearly every link is.
    assert all(got[v][0] <= n for v, n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.97 * links


def test_recall_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    from kohesion.llm.queries import op4_embedding_near_dedup

    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op4_embedding_near_dedup(spark, sf.replace("0.001", "0.1")).collect()}
    want = brute(rows, 0.93)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[1] for w in want.values())
    assert all(g[2] == (v == g[1]) for v, g in got.items())


def test_traversal_is_the_multi_sequence_order():
    rng = np.random.default_rng(1)
    unit = embeddings._unit(rng.normal(size=(20, 8)))
    index = embeddings.MultiIndex(rng.normal(size=(7, 4)), rng.normal(size=(5, 4)), 9)
    cells = index.traverse(unit)
    for x, own in zip(unit, cells, strict=True):
        d = ((x[:4] - index.first) ** 2).sum(1)[:, None] + ((x[4:] - index.second) ** 2).sum(1)[None]
        assert np.allclose(d.ravel()[own], np.sort(d.ravel())[:9])
    assert index.traverse(unit, 35).shape == (20, 35)


def test_blocks_of_a_large_cell(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "RESIDENTS", 7)
    monkeypatch.setattr(embeddings, "VISITORS", 5)
    rng = np.random.default_rng(2)
    x = np.concatenate([np.ones((60, 6)) + 0.01 * rng.normal(size=(60, 6)), rng.normal(size=(10, 6))])
    rows = [(int(i), [float(v) for v in row], 1) for i, row in enumerate(x)]
    got = {r["id"]: (r["n_links"], r["component"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == (59, 0) for i in range(60))
    assert got == {v: (n, c) for v, n, c in brute(rows, 0.93).values()}


def test_edge_rows(spark, clashing):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (None, [1.0, 0.0], 0), (5, None, 0), (6, [0.0, 0.0], 0), (7, [1.0, None], 0),
        (8, [nan, 1.0], 0), (9, [inf, 1.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [], 0), (12, [1e-30, 0.0], 0), (2, [2.0, 0.0], 0), (13, [0.0, 1.0], 0), (14, [1.0, 0.0], 0),
    ]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in clashing if c != "label"]])
    table = spark.createDataFrame([(*r, *["x"] * (len(clashing) - 1)) for r in rows], schema)
    got = sorted(((r["id"], r["n_links"], r["component"]) for r in embeddings.near_vectors(table).collect()), key=str)
    assert got == sorted(brute(rows, 0.93).values(), key=str)
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
