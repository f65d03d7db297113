import math
import re
import zlib

import numpy as np
from kohesion.llm import toxicity


def sentences(n, seed=0, insults=("idiot", "clown", "worthless", "pathetic")):
    rng = np.random.default_rng(seed)
    parts = ["th", "re", "on", "an", "er", "ing", "ed", "le", "ou", "st"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    texts, toxic = [], []
    for i in range(n):
        body = [word() for _ in range(60)]
        if i % 4 == 0:
            body[int(rng.integers(60))] = str(rng.choice(insults))
        texts.append(". ".join(" ".join(body[j : j + 12]) for j in range(0, 60, 12)))
        toxic.append(int(i % 4 == 0))
    return texts, np.array(toxic)


def brute_spread(w):
    out = {}
    for c in toxicity.PATTERNS:
        for i in range(len(w) - c[-1]):
            u = w[i] + "".join(w[i + o] for o in c)
            out[u] = out.get(u, 0) + toxicity.DECAY ** toxicity._skipped(c)
    return out


def brute_kernel(a, b):
    """The kernel of two words, divided by their norms."""
    x, y = brute_spread(a), brute_spread(b)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y.get(u, 0) for u, v in x.items()) / norm if norm else 0.0


WORDS = ["idiot", "idxiot", "theron", "pathetic", "ab", "banana", "aaaaaaaaaaaa", "stupidstupidstupidstupidstupidstupidstupidstupid", "hello", "mississippi" * 7]


def letters_of(words):
    raw = [w.encode().translate(bytes(toxicity._LETTER)) for w in words]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(w) for w in raw])


def test_folded_weights_are_the_kernel():
    letter, sizes = letters_of(WORDS)
    vocabulary = toxicity.Vocabulary(np.zeros(len(WORDS), np.int64), sizes, letter)
    for j, b in enumerate(WORDS):
        rows, slots, values = vocabulary.features(vocabulary.id[[j]])
        weights = np.zeros(1 << toxicity.SLOT_BITS)
        np.add.at(weights, slots, values)
        assert np.allclose(toxicity.word_values(letter, sizes, weights), [brute_kernel(a, b) for a in WORDS], atol=1e-9)


def test_norms_are_exact_in_pieces_and_at_any_length(monkeypatch):
    letter, sizes = letters_of(WORDS)
    weights = np.random.default_rng(1).normal(size=1 << toxicity.SLOT_BITS)
    whole = toxicity.word_values(letter, sizes, weights)
    monkeypatch.setattr(toxicity, "PIECE", 20)
    # Words of over 20 letters now go through the sums of all slots.
    assert np.allclose(toxicity.word_values(letter, sizes, weights), whole, atol=1e-9)


def brute_documents(text, weights, bias, value):
    """The two highest words and the number of words; single letters in a row are a word, inside a sentence, which ends at . ! ? or a line's end."""
    found = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text or ""):
        run = ""
        for w in sentence.split():
            w = "".join(c for c in w.lower() if "a" <= c <= "z")
            if len(w) == 1:
                run += w
                continue
            found += [run, w] if run else [w]
            run = ""
        found += [run] if run else []
    top = sorted((value(u) + bias for u in found), reverse=True)[:2]
    return [max(x, toxicity._NOTHING) for x in top] + [toxicity._NOTHING] * (2 - len(top)) + [math.log1p(len(found))]


def test_scores_match_brute_force():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=1 << toxicity.SLOT_BITS)
    parts = ["the", "idiot", "i", "d", "o", "t", "a", "s", "s", "end.", "why?", "no!\n", "wo-rd", "a1b2c", "hello", "banana", "zzzzzz"]
    texts = [" ".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(60)] + ["", None, "a s s", "one"]

    def value(word):
        letter, sizes = letters_of([word])
        spread = brute_spread(word)
        norm = math.sqrt(sum(v * v for v in spread.values()))
        total = 0.0
        for own, slot, skipped in toxicity.subsequences(letter, np.zeros(len(letter), np.int64)):
            total += float(weights[slot].sum()) * toxicity.DECAY**skipped
        return total / norm if norm else 0.0

    judge = toxicity.Judge(weights, 0.25)
    want = [brute_documents(t, weights, 0.25, value) for t in texts]
    for _ in range(2):
        assert np.allclose(judge.documents(texts), want, atol=1e-9)


def test_learns_and_tolerates_gaps():
    texts, toxic = sentences(600)
    model = toxicity.train(texts, toxic, 0.25)
    new, truth = sentences(200, 5)
    assert ((toxicity.score(new, model) >= 0.5) == truth).mean() > 0.97
    clean = "there thon anle restou. onan thest"
    variants = ("idiot", "IDIOT", "id-i.ot", "idxiot", "i d i o t", "wortthless", "pathetiic", "cllown")
    top = toxicity.Judge(model.weights, model.bias).documents([clean, *[f"{clean} {w} {clean}" for w in variants]])[:, 0]
    assert top[0] < 0 and (top[1:] > 0).all(), top
    assert np.allclose(top[1], top[[2, 3, 5]])


def test_degenerate_training():
    for texts, toxic in (([], []), (["a"], [1]), (["", ""], [0, 1]), ([None, "xy"], [1, 0])):
        model = toxicity.train(texts, np.array(toxic), 0.3)
        marks = toxicity.score(["", None, "word here", "long " * 60_000], model)
        assert ((0 <= marks) & (marks <= 1)).all()


def test_held_out_accuracy(spark, sf):
    from kohesion.llm.queries import op6_toxicity

    sf = sf.replace("sf0.001", "sf0.1")
    got = {r["doc_id"]: r for r in op6_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [(got[i]["predicted"], y) for i, y in labels.items() if got[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.98
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_held_out_labels_change_nothing(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    own = toxicity.fit_toxicity(docs, labels)
    flipped = toxicity.fit_toxicity(docs, labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert (own.weights == flipped.weights).all() and (own.curve == flipped.curve).all()


def test_edge_rows(spark, docs, clashing):
    texts, toxic = sentences(80)
    rows = [*enumerate(texts), (100, None), (101, ""), (None, "idiot"), (102, "x"), (102, "x")]
    labels = spark.createDataFrame([*[(i, 1, int(y)) for i, y in enumerate(toxic)], (None, 1, 1), (100, 1, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    table = docs(rows, clashing)
    got = toxicity.score_toxicity(table, toxicity.fit_toxicity(table, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(docs([]), toxicity.fit_toxicity(docs([]), labels.limit(0))).count() == 0


def test_machines_are_fitted_on_an_executor(spark, sf, monkeypatch):
    """The driver gets their weights, not the words; they are the machines of the texts themselves."""

    def refuse(*args):
        raise AssertionError("the driver has the vocabulary")

    texts, toxic = sentences(200)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    used = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    want = toxicity.train([texts[i] for i in used], toxic[used], float(toxic[used].mean()))
    # Tasks import the module anew, so only the driver's is changed.
    monkeypatch.setattr(toxicity, "_machine", refuse)
    got = toxicity.fit_toxicity(docs, labels)
    assert np.allclose(got.weights, want.weights) and np.isclose(got.bias, want.bias) and np.allclose(got.curve, want.curve)
