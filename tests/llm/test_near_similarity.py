"""The near-duplicate stage against exact Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline
import numpy as np
from kohesion.llm import _text, simhash


def shingles(text, words=5):
    w = _text.split_words(text)
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def exact_pairs(rows, least=0.8):
    """Pairs of row numbers by similarity, through an index of all shingles."""
    sets, holds, out = [shingles(t) for _, t in rows], {}, {}
    for b, own in enumerate(sets):
        shared = {}
        for s in own:
            for a in holds.setdefault(s, []):
                shared[a] = shared.get(a, 0) + 1
            holds[s].append(b)
        for a, n in shared.items():
            similarity = n / (len(own) + len(sets[a]) - n)
            if similarity >= least - 1e-12:
                out[a, b] = similarity
    return out


def kept_of(rows, pairs):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(rows[a][0]), find(rows[b][0])
        root[max(x, y)] = min(x, y)
    return {find(i) for i in root}


def test_stage_keeps_what_exact_similarity_keeps(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert all(t and t.split() for _, t in rows)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert got == kept_of(rows, exact_pairs(rows))


def test_recall_from_a_similarity_of_080(spark, docs):
    rnd, rows = random.Random(6), []
    for i in range(300):
        words = [f"w{rnd.randrange(9000)}" for _ in range(300)]
        copy = [*words]
        for at in rnd.sample(range(300), 6):
            copy[at] = "other"
        rows += [(i, " ".join(words)), (1000 + i, " ".join(copy))]
    pairs = exact_pairs(rows)
    assert len(pairs) > 250 and np.mean(list(pairs.values())) < 0.85
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(rows), "").collect()}
    want = kept_of(rows, pairs)
    assert want <= got
    assert len(got - want) <= 0.03 * len(pairs)


def test_a_near_fingerprint_alone_does_not_drop(docs):
    rnd = random.Random(7)
    often = "the same line again and again "
    rows = [(i, often * 60 + " ".join(f"w{rnd.randrange(9000)}" for _ in range(60))) for i in range(6)]
    prints = simhash.fingerprints([t for _, t in rows], 5)
    assert (np.bitwise_count(prints[0] ^ prints[1:]) <= 18).any() and not exact_pairs(rows)
    assert simhash.near_dedup(docs(rows)).count() == 6
