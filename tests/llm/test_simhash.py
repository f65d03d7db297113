import re

import numpy as np
import pyarrow as pa
import xxhash
from kohesion.llm import simhash
from kohesion.llm.bktree import Forest, merge


def brute_fingerprint(text, words):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([b" ".join(found)] if found else [])
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for j in range(64):
            bits[j] += h >> j & 1
    return sum(1 << j for j in range(64) if 2 * bits[j] > len(shingles))


def brute_components(prints, radius):
    """{id: smallest id reachable}."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_match_brute_force():
    texts = [None, "", "  \t\n", "One", "one TWO", "a b c", "a  b\tc\x0bd\x0ce\rf", "É é ÀB ab", "x\xa0y z w", "the the the the", "𝔘nicode 🙂 words here now " * 50]
    for words in (1, 3, 5):
        got = simhash.fingerprints(texts, words)
        assert (got[:3] == 0).all()
        assert [int(f) for f in got] == [brute_fingerprint(t, words) for t in texts]


def test_forest_finds_every_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.concatenate([base, *[base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 60, 6)]])
    values = np.unique(near)
    tree = np.arange(len(values)) % 2
    for radius in (0, 1, 2, 5):
        got = set()
        for a, b in Forest(values, tree).search(radius):
            got |= set(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist(), strict=True))
        far = np.bitwise_count(values[:, None] ^ values[None])
        want = {(i, j) for i in range(len(values)) for j in range(i) if tree[i] == tree[j] and far[i, j] <= radius}
        assert got == want


def test_dense_groups_are_not_compared_pair_by_pair(monkeypatch):
    from kohesion.llm import bktree

    monkeypatch.setattr(bktree, "ROUND", 16)
    rng = np.random.default_rng(5)
    dense = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 40, (1500, 3)).astype(np.uint64), axis=1))
    values = np.concatenate([dense, rng.integers(0, 1 << 63, 300, dtype=np.uint64), dense[:400] ^ np.uint64(1 << 63)])
    tree = np.concatenate([np.zeros(len(dense) + 150), np.ones(150), np.full(400, 2)]).astype(np.int64)
    for radius in (1, 2, 3, 6):
        forest, want = Forest(values, tree), np.arange(len(values))
        pairs = 0
        for a, b in forest.search(radius):
            pairs += len(a)
            merge(want, a, b)
        assert (forest.connect(radius) == want).all()
        if radius == 6:
            seen = []
            own = forest.search
            monkeypatch.setattr(forest, "search", lambda *a, own=own, seen=seen: (seen.append(len(x[0])) or x for x in own(*a)))
            forest.connect(radius)
            assert sum(seen) < pairs / 10


def test_merge_keeps_the_smallest():
    label = np.arange(6)
    merge(label, np.array([5, 4, 3]), np.array([4, 3, 1]))
    assert label.tolist() == [0, 1, 2, 1, 1, 1]


def test_components_match_brute_force(spark, sf):
    from kohesion.llm.queries import op3_simhash_near_dedup

    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {r["doc_id"]: brute_fingerprint(r["text"], 3) for r in rows}
    want = brute_components(prints, 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op3_simhash_near_dedup(spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_chains_and_wider_radii(spark):
    rng = np.random.default_rng(1)
    values = [int(v) for v in rng.integers(0, 1 << 63, 30)]
    chain = [values[0]]
    for i in range(12):
        chain.append(chain[-1] ^ (0b11 << (4 * i)))
    prints = dict(enumerate([*chain[::-1], *values[1:], *[v ^ 0b111111 << 50 for v in values[1:10]]]))
    points = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in prints.items()], "fp long, rep long")
    for radius, blocks in ((2, 4), (6, 9)):
        from kohesion.llm._components import connected_components

        links = simhash.link_fingerprints(points, radius, blocks)
        got = {i: i for i in prints} | {r["node"]: r["component"] for r in connected_components(links).collect()}
        assert got == brute_components(prints, radius)


def test_edge_rows(spark, docs, clashing):
    rows = [(3, None), (1, ""), (2, " \n"), (5, "some words here now"), (5, "some words here now"), (None, "some words here now"), (7, "w " * 5000)]
    got = [(r["id"], r["component"]) for r in simhash.simhash_components(docs(rows, clashing)).collect()]
    assert sorted(got, key=str) == sorted([(3, 1), (1, 1), (2, 1), (5, 5), (5, 5), (None, None), (7, 7)], key=str)
    kept = simhash.near_dedup(docs(rows, clashing))
    assert kept.columns == docs(rows, clashing).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 5, None, 7], key=str)
    assert simhash.near_dedup(docs([])).count() == 0
    assert simhash.simhash_components(docs([])).count() == 0


def test_an_id_with_two_texts_joins_them(docs):
    rows = [(9, "alpha beta gamma"), (4, "alpha beta gamma"), (9, "delta epsilon zeta"), (6, "delta epsilon zeta")]
    assert {r["component"] for r in simhash.simhash_components(docs(rows)).collect()} == {4}


def test_near_copies_go(docs):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in rng.integers(0, 5000, 2000)]
    changed = [*words]
    changed[1000] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(f"v{i}" for i in rng.integers(0, 5000, 2000)))]
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs(rows)).collect()) == [1, 3]


def test_accepted_links_match_brute_force():
    rng = np.random.default_rng(4)
    for n, radius in ((200, 20), (60, 64)):
        values, tree = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 3, n)
        allowed = {(a, b) for a in range(n) for b in range(n) if (a * 7 + b * 7) % 11 == 0}
        links = [(a, b) for a, b in allowed if a < b and tree[a] == tree[b] and (int(values[a]) ^ int(values[b])).bit_count() <= radius]
        root = list(range(n))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        got = Forest(values, tree).connect(radius, lambda a, b, allowed=allowed: (a, b) in allowed)
        assert [*map(int, got)] == [find(i) for i in range(n)]


def test_a_dense_group_is_not_compared_pair_by_pair():
    """Copies of one text that resemble it and not each other: its fingerprint is nearest the majority, so it is asked first."""
    rng = np.random.default_rng(5)
    base, asked = rng.integers(0, 1 << 63), []
    copies = [base ^ int(sum(1 << int(b) for b in rng.choice(63, 6, replace=False))) for _ in range(2000)]
    rows = pa.table({"key": np.zeros(2001, np.int64), "rep": np.arange(2001), "fp": np.array([*copies, base], np.int64), "shingles": pa.array([np.uint64(i).tobytes() for i in range(2001)], pa.binary())})
    real = simhash.similar_enough

    def similar(x, y, similarity):
        asked.append(1)
        return 2000 in (int(x[0]), int(y[0]))

    simhash.similar_enough = similar
    try:
        links = simhash._link_shards(rows, 18, 0.8)
    finally:
        simhash.similar_enough = real
    assert links.num_rows == 2000 and len(asked) < 3000


def test_shards_of_the_same_points_are_one():
    """Two keys with the same near points and one key with another far point."""
    key, rep, fp = [1, 1, 2, 2, 2, 3, 3], [5, 6, 5, 6, 9, 5, 9], [0, 1, 0, 1, -1, 0, -1]
    rows = pa.table({"key": key, "rep": rep, "digest": [10 * r for r in rep], "fp": fp})
    out = pa.Table.from_batches(simhash.shard_classes(rows.to_batches(), 18)).to_pylist()
    assert len({r["shard"] for r in out}) == 1
    assert sorted((r["rep"], r["digest"], r["fp"]) for r in out) == [(5, 50, 0)] * 2 + [(6, 60, 1)] * 2


def test_shards_go_on_over_batches(monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_BYTES", 400)
    own = np.arange(12, dtype=np.uint64)
    rows = pa.table({"key": np.repeat(np.arange(10), 6), "rep": np.arange(60), "fp": np.zeros(60, np.int64) + np.arange(60) % 6, "shingles": pa.array([own.tobytes()] * 60, pa.binary())})
    links = pa.Table.from_batches(simhash.shard_similar(rows.to_batches(max_chunksize=4), 18, 0.8))
    assert sorted(zip(*links.to_pydict().values(), strict=True)) == [(6 * k + i, 6 * k) for k in range(10) for i in range(1, 6)]
