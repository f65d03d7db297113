import numpy as np
from kohesion.llm import quality


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    n, good = 20_000, rng.uniform(size=20_000) < 0.8
    bad_rate = np.array([[0.6, 0.5, 0.7, 0.05], [0.02, 0.05, 0.01, 0.05]])
    vote = np.full((n, len(quality.LABELLERS)), 2)
    for j in range(4):
        vote[:, j] = (rng.uniform(size=n) >= np.where(good, bad_rate[1, j], bad_rate[0, j])).astype(int)
    patterns, count = np.unique(vote, axis=0, return_counts=True)
    model = quality.fit_label_model(patterns, count.astype(float))
    assert abs(model.prior - 0.8) < 0.03
    assert np.abs(model.bad_rate[:, :3] - bad_rate[:, :3]).max() < 0.06
    assert ((model.posterior(vote) >= 0.5) == good).mean() > 0.93


def test_patterns_round_trip():
    rng = np.random.default_rng(1)
    vote = rng.integers(0, 3, (50, len(quality.LABELLERS)))
    assert (quality.decode(quality.pattern_code(vote)) == vote).all()


def test_measures_by_hand():
    row = dict(zip(quality.MEASURES, quality.measures(["A a. | !! %% go go go 7"])[0], strict=True))
    assert row["words"] == 9 and row["bars"] == 1 / 9 and row["exclaims"] == 2 / 9 and row["symbols"] == 2 / 9
    assert row["repeats"] == 2 / 9 and row["returns"] == 1 / 9 and row["lone_marks"] == 3 / 9 and row["digits"] == 1 / 9
    assert quality.measures(["", "x"]).shape == (2, len(quality.MEASURES))


def test_agrees_with_held_labels(spark, sf):
    from kohesion.llm.queries import op1_quality_classifier

    sf = sf.replace("0.001", "0.01")
    got = {r["doc_id"]: r for r in op1_quality_classifier(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [got[i]["good"] for i, q in labels.items() if q == 1]
    bad = [got[i]["good"] for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and 0 <= r["weak_label"] <= 1 for r in got.values())


def test_edge_rows(docs, clashing):
    text = "This is a plain line of words, as one would write it. It goes on for a while, and ends."
    junk = "BUY!! NOW!! THE!! BEST!! OFFER!! OF!! ALL!! TIME!! FOR!! YOU!! AND!! ME!!"
    rows = [(1, None), (2, ""), (3, " \n"), (None, text), (4, text), (4, text), (5, "word. " * 50_000), *[(10 + i, text) for i in range(30)], *[(50 + i, junk) for i in range(8)]]
    table = docs(rows, clashing)
    model = quality.fit_quality(table)
    got = quality.score_quality(table, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["score"] == 0 and not by[i]["good"] for i in (1, 2, 3))
    assert by[4]["good"] and by[None]["good"] and not by[50]["good"]
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns and kept.count() == sum(r["good"] for r in got)
    empty = docs([])
    assert quality.score_quality(empty, quality.fit_quality(empty)).count() == 0


# ---------------------------------------------------------------- brute force

SPACE = b" \t\n\x0b\x0c\r"
MARKS = b".,;:'\"()-?/"


def kind(b):
    if b in SPACE:
        return "space"
    if 0x30 <= b <= 0x39:
        return "digit"
    if 0x41 <= b <= 0x5A:
        return "upper"
    if 0x61 <= b <= 0x7A or b >= 0x80:
        return "lower"
    return "mark" if b in MARKS else "exclaim" if b == ord("!") else "bar" if b == ord("|") else "symbol"


def brute_measures(text):
    raw = text.encode()
    words, kinds = raw.split(), [kind(b) for b in raw]
    n, letters = max(len(words), 1), max(kinds.count("upper") + kinds.count("lower"), 1)
    same = [i > 0 and words[i] == words[i - 1] for i in range(len(words))]
    values = {
        "words": len(words),
        "symbols": kinds.count("symbol") / n,
        "symbol_ends": sum(kind(w[-1]) == "symbol" for w in words) / n,
        "exclaims": kinds.count("exclaim") / n,
        "uppers": kinds.count("upper") / letters,
        "digits": kinds.count("digit") / n,
        "bars": kinds.count("bar") / n,
        "lone_marks": sum(not any(kind(b) in ("digit", "upper", "lower") for b in w) for w in words) / n,
        "repeats": sum(same) / n,
        "returns": sum(i > 0 and same[i] and same[i - 1] for i in range(len(words))) / n,
        "length": (kinds.count("upper") + kinds.count("lower")) / n,
        "stops": sum(w[-1:] in (b".", b",", b"?") for w in words) / n,
    }
    return [values[m] for m in quality.MEASURES]


def brute_votes(measured):
    out = []
    for name, good, bad in quality.LABELLERS.values():
        x, up = measured[quality.MEASURES.index(name)], good > bad
        is_bad = (x <= bad if up else x >= bad) and measured[0] >= 12
        out.append(0 if is_bad else 1 if (x >= good if up else x <= good) else 2)
    return out


def brute_features(text):
    half = quality.HASHED // 2
    shape = [{"lower": 0x61, "upper": 0x41, "digit": 0x30}.get(kind(b), b) for b in text.encode() + b"\n"]
    counts = [0] * half
    for a, b, c in zip(shape, shape[1:], shape[2:], strict=False):
        code = ((a * 65_599 + b) * 65_599 + c) % 2**32
        counts[(code * 2_654_435_761) % 2**32 >> 21] += 1
    out = [(c / max(sum(counts), 1)) ** 0.5 for c in counts] + [0.0] * half
    for j, x in enumerate(brute_measures(text)):
        out[half + (j * 97 + sum(x >= s for s in quality._STEPS) * 31) % half] += 0.5
    return out


def brute_posteriors(votes, rounds=500, smooth=0.5):
    """Expectation-maximisation row by row."""
    good = [0.1 if 0 in v else 0.95 for v in votes]
    for _ in range(rounds):
        rates = [[0.0] * len(votes[0]) for _ in range(2)]
        for c in range(2):
            for j in range(len(votes[0])):
                share = [g if c else 1 - g for g in good]
                bad = sum(s for s, v in zip(share, votes, strict=True) if v[j] == 0)
                cast = sum(s for s, v in zip(share, votes, strict=True) if v[j] != 2)
                rates[c][j] = (bad + smooth) / (cast + 2 * smooth)
        prior = min(max(sum(good) / len(good), 0.01), 0.99)
        new = []
        for v in votes:
            like = [prior if c else 1 - prior for c in range(2)]
            for c in range(2):
                for j, x in enumerate(v):
                    like[c] *= 1 if x == 2 else rates[c][j] if x == 0 else 1 - rates[c][j]
            new.append(like[1] / sum(like))
        done = max(abs(a - b) for a, b in zip(new, good, strict=True)) < 1e-9
        good = new
        if done:
            break
    return good


def some_texts(n=60):
    rng = np.random.default_rng(7)
    parts = ["The", "house,", "river.", "is", "OLD!!", "|", "%%%", "go", "go", "7", "2024", "é", "Straße", "why?", "a-b", "***", "xxxxxxxxxxxxxxxxxxxxxxxx", "\n", "\t"]
    return [" ".join(rng.choice(parts, rng.integers(1, 60))) for _ in range(n)] + ["", " ", "x", "go go go go go go go go go go go go go go"]


def test_measures_votes_and_features_match_brute_force():
    texts = some_texts()
    got = quality.measures(texts)
    assert np.allclose(got, [brute_measures(t) for t in texts])
    assert quality.votes(got).tolist() == [brute_votes(brute_measures(t)) for t in texts]
    assert np.allclose(quality.features(texts), [brute_features(t) for t in texts], atol=1e-6)


def test_whole_query_matches_brute_force(docs):
    """Weak labels from all rows, and scores from the fitted weights, without patterns, batches or hashes of words."""
    texts = [t for t in some_texts() if t.strip()]
    rows = list(enumerate(texts))
    table = docs(rows)
    model = quality.fit_quality(table)
    got = {r["doc_id"]: r for r in quality.score_quality(table, model).collect()}
    weak = brute_posteriors([brute_votes(brute_measures(t)) for t in texts])
    for i, t in rows:
        z = float(np.dot(brute_features(t), model.weights[:-1]) + model.weights[-1])
        assert abs(got[i]["weak_label"] - weak[i]) < 1e-4
        assert abs(got[i]["score"] - 1 / (1 + np.exp(-z))) < 1e-4
        assert got[i]["good"] == (got[i]["score"] >= 0.5)


def test_scorer_minimises_its_loss():
    """Accelerated descent against Newton's method on the same weighed soft labels."""
    rng = np.random.default_rng(8)
    x, target = rng.normal(size=(200, 3)), rng.uniform(size=200)
    w = quality.fit_scorer(x, target, rounds=3000)
    z = np.concatenate([x, np.ones((200, 1))], axis=1)
    weight = target / target.sum() + (1 - target) / (1 - target).sum()
    weight /= weight.sum()
    best = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ best))
        best -= np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + 1e-4 * np.eye(4), z.T @ (weight * (p - target)) + 1e-4 * best)
    assert np.allclose(w, best, atol=1e-3)
