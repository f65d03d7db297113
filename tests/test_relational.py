"""Hand-computed cases of sampling, agreement, consensus, accuracy, selection and reports."""

import math

import numpy as np
import pytest
from kohesion.functions import accuracy, agreement, consensus, features, products, reports, sampling, selection
from pyspark.sql import functions as F


def runs(spark, *samples, split="train"):
    rows = [(0, b, split, s, label) for b, (ids, labels) in enumerate(samples) for s, label in zip(ids, labels, strict=True)]
    return spark.createDataFrame(rows, "config_id int, resample int, split string, sample_id bigint, label int")


def pairs(spark, p, n):
    rows = [(0, i, j, 1, 0, float(p(i, j))) for i in range(n) for j in range(i + 1, n) if p(i, j) is not None]
    return spark.createDataFrame(rows, "config_id int, i bigint, j bigint, n_cosample bigint, n_cocluster bigint, p float")


def test_subsamples(spark):
    x = spark.range(100).select(F.col("id").alias("sample_id"))
    for ratio in (0.5, 0.618, 0.99):
        got = sampling.membership(x, 3, ratio).groupBy("resample", "split").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("d")).collect()
        sizes = {(r["resample"], r["split"]): (r["n"], r["d"]) for r in got}
        m = math.floor(100 * ratio)
        assert all(sizes[b, "train"] == sizes[b, "stab"] == (m, m) and sizes[b, "test"] == (100 - m, 100 - m) for b in range(3))
    a, b = (sorted(map(tuple, sampling.membership(x.repartition(n), 4).collect())) for n in (1, 7))
    assert a == b
    assert sampling.membership(x, 2, second=False).filter("split = 'stab'").count() == 0


def test_adjusted_rand(spark):
    def ari(a, b):
        df = spark.createDataFrame([(0, x, y) for x, y in zip(a, b, strict=True)], "g int, a int, b int")
        return agreement.adjusted_rand(df, ["g"], "a", "b").first()["ari"]

    assert ari([0, 0, 1, 1], [1, 1, 0, 0]) == 1 and ari([0], [3]) == 1 and ari([0, 0], [0, 0]) == 1
    assert ari([0, 0, 1, 1], [0, 1, 0, 1]) == pytest.approx(-0.5)
    assert ari([0, 0, 1, 2], [0, 0, 1, 1]) == pytest.approx(4 / 7)
    left, right = np.random.default_rng(0).integers(0, 4, (2, 80)).tolist()
    renamed = [(v + 1) % 4 for v in left]
    assert ari(left, right) == pytest.approx(ari(renamed, right)) == pytest.approx(ari(right, left))


def test_summary(spark):
    df = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("a", None), ("b", 0.5), ("c", None)], "g string, v double")
    got = {r["g"]: r for r in agreement.summary(df, ["g"], "v").collect()}
    assert got["a"]["v"] == pytest.approx(0.3) and got["a"]["v_se"] == pytest.approx(0.1) and got["a"]["v_upper"] == pytest.approx(0.39)
    assert got["b"]["v"] == 0.5 and got["b"]["v_se"] is None and got["c"]["v"] is None and got["c"]["v_lower"] is None


def test_consensus_pins(spark):
    got = {(r["i"], r["j"]): (r["n_cosample"], r["n_cocluster"], r["p"]) for r in consensus.consensus_pairs(runs(spark, ([0, 1, 2, 3], [0, 0, 1, 1]), ([1, 2, 3, 4], [0, 1, 1, 1]))).collect()}
    assert (0, 4) not in got and got[0, 1] == (1, 1, 1.0) and got[1, 2] == (2, 0, 0.0) and got[2, 3] == (2, 2, 1.0)
    pin = {(r["i"], r["j"]): r["p"] for r in consensus.consensus_pairs(runs(spark, ([1, 2, 3], [1, 1, 2]), ([2, 3, 4], [1, 2, 2]))).collect()}
    assert pin == {(1, 2): 1, (1, 3): 0, (2, 3): 0, (2, 4): 0, (3, 4): 1}


def test_consensus_scores(spark):
    block = pairs(spark, lambda i, j: float((i < 5) == (j < 5)), 10)
    assert consensus.pac_score(block).first()["pac"] == 1
    assert all(r["gini"] > 0.9 and r["ce"] > 0.9 for r in consensus.sample_stability(block).collect())
    half = pairs(spark, lambda i, j: 0.5, 4)
    assert consensus.pac_score(half).first()["pac"] == 0
    assert all(abs(r["gini"]) < 1e-9 and abs(r["ce"]) < 1e-9 for r in consensus.sample_stability(half).collect())
    assert consensus.pac_score(pairs(spark, lambda i, j: 0.03 if (i + j) % 2 else 0.97, 6)).first()["pac"] == 1
    # 32-bit ratios: 1/20 is above the lower bound, 19/20 below the upper one.
    assert consensus.pac_score(pairs(spark, lambda i, j: np.float32(1 / 20), 3)).first()["pac"] == 0
    assert consensus.pac_score(pairs(spark, lambda i, j: None, 3)).count() == 0
    few = consensus.sample_stability(pairs(spark, lambda i, j: None if (i, j) == (0, 1) else 0.8, 3))
    assert {r["sample_id"] for r in few.collect()} == {0, 1, 2}
    assert consensus.config_scores(few, 4).first()["consensus_gini_stability"] is None


def test_both_plans_take_any_labels(spark):
    """A clusterer may call noise -1."""
    rng = np.random.default_rng(3)
    rows = [(0, b, "train", int(i), int(rng.choice([-1, 4, 900]))) for b in range(6) for i in rng.choice(20, 12, replace=False)]
    own = spark.createDataFrame(rows, "config_id int, resample int, split string, sample_id long, label int")
    pairs_of = consensus.consensus_pairs(own)
    want = {r["sample_id"]: (r["gini"], r["ce"]) for r in consensus.sample_stability(pairs_of).collect()}
    samples, pac = consensus.consensus_scores_blocked(own, 7)
    got = {r["sample_id"]: (r["gini"], r["ce"]) for r in samples.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)
    assert pac.first()["pac"] == pytest.approx(consensus.pac_score(pairs_of).first()["pac"])
    ids = np.arange(20)
    assert np.allclose(consensus.consensus_matrix(own, ids, block=6), consensus.dense_matrix(pairs_of, ids))


def test_block_plan_equals_pairs(spark):
    rng = np.random.default_rng(0)
    own = runs(spark, *[(sorted(rng.choice(60, 37, replace=False).tolist()), rng.integers(0, 3, 37).tolist()) for _ in range(6)])
    want = {r["sample_id"]: (r["gini"], r["ce"]) for r in consensus.sample_stability(consensus.consensus_pairs(own)).collect()}
    for block in (7, 1000):
        samples, pac = consensus.consensus_scores_blocked(own, block)
        got = {r["sample_id"]: (r["gini"], r["ce"]) for r in samples.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[s], want[s]) for s in want)
        assert pac.first()["pac"] == pytest.approx(consensus.pac_score(consensus.consensus_pairs(own)).first()["pac"])


def test_samples_with_equal_draws_are_one_class(spark):
    """Three sorts of samples: what is compared doesn't grow with them, and all pairs come out."""
    n = 300
    ids = list(range(n))
    own = runs(spark, (ids, [i % 3 for i in ids]), (ids, [min(i % 3, 1) for i in ids]))
    members, classes = consensus.consensus_classes(own)
    assert members.count() == n and sorted(r["size"] for r in classes.collect()) == [100, 100, 100]
    got = {(r["i"], r["j"]): r["p"] for r in consensus.consensus_pairs(own, block=2).collect()}
    want = {(i, j): ((i % 3 == j % 3) + (min(i % 3, 1) == min(j % 3, 1))) / 2 for i in ids for j in range(i + 1, n)}
    assert got == want
    samples, pac = consensus.consensus_scores_blocked(own, 2)
    assert pac.first()["pac"] == pytest.approx(1 - sum(p == 0.5 for p in want.values()) / len(want))
    gini = {r["sample_id"]: r["gini"] for r in samples.collect()}
    assert gini == {i: pytest.approx(1 if i % 3 == 0 else 1 - 100 / (n - 1)) for i in ids}


def test_consensus_labels_of_classes(spark):
    """Many samples of few draws: labels come from the classes; undrawn samples get one too."""
    from kohesion.operators import labels

    n = 21_000
    ids = spark.range(n + 5).withColumnRenamed("id", "sample_id")
    draws = F.explode(F.array(*[F.lit(b) for b in range(3)]))
    own = ids.filter(F.col("sample_id") < n).select(F.lit(0).alias("config_id"), draws.alias("resample"), "sample_id", (F.col("sample_id") % 3).cast("int").alias("label"))
    got = {r["sample_id"]: r["label"] for r in labels.consensus_label_table(own, ids, 4).collect()}
    assert len(got) == n + 5 and len(set(got.values())) == 4
    assert all(got[i] == got[i % 3] for i in range(n))


def predicted(spark, *resamples):
    rows = [(0, b, s, t, p) for b, (ids, true, pred) in enumerate(resamples) for s, t, p in zip(ids, true, pred, strict=True)]
    return spark.createDataFrame(rows, "config_id int, resample int, sample_id bigint, label_true int, label_pred int")


@pytest.mark.parametrize(
    ("resamples", "n", "want"),
    [
        ([([0, 1, 2, 3], [0, 0, 1, 1], [0, 0, 0, 1])], 4, [1, 1, 0, 1]),
        ([([0, 1, 2, 3], [0, 0, 1, 1], [0, 0, 1, 1])] * 2 + [([0, 1, 2, 3], [0, 0, 1, 1], [0, 0, 0, 1])], 4, [1, 1, 2 / 3, 1]),
        ([([0, 1], [0, 0], [0, 0])], 5, [1, 1, 0, 0, 0]),
        ([([0, 1, 2], [1, 1, 2], [1, 1, 1]), ([1, 2, 3], [1, 2, 2], [1, 2, 2])], 4, [1, 1, 0.5, 1]),
        ([([0, 1, 2, 3], [0, 0, 1, 1], [7, 7, 3, 3])], 4, [1, 1, 1, 1]),
    ],
)
def test_accuracy(spark, resamples, n, want):
    samples = spark.range(n).select(F.col("id").alias("sample_id"))
    got = accuracy.sample_accuracy(predicted(spark, *resamples), samples).orderBy("sample_id").collect()
    assert [r["accuracy"] for r in got] == pytest.approx(want)


BASE = {
    "ari_stability": ([0.90, 0.85, 0.70, 0.60], [0.02, 0.03, 0.05, 0.06], [0.92, 0.88, 0.75, 0.66], [0.88, 0.82, 0.65, 0.54]),
}


def results(spark, scores, se=None, upper=None, lower=None):
    n = len(scores)
    rows = [(i, "kmeans", 2 + i, float(scores[i]), se and float(se[i]), upper and float(upper[i]), lower and float(lower[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "config_id int, estimator string, n_clusters int, ari_stability double, ari_stability_se double, ari_stability_upper double, ari_stability_lower double")
    return df if se else df.select("config_id", "estimator", "n_clusters", "ari_stability")


def test_selection(spark):
    k = lambda df, rule, **o: selection.chosen(df, "stability", rule, **o)["n_clusters"]
    base = results(spark, *BASE["ari_stability"])
    assert [k(base, r) for r in ("max", "1se", "quantile")] == [2, 2, 2]
    wide = results(spark, [0.90, 0.89, 0.88, 0.50], [0.05, 0.04, 0.03, 0.02], [0.95] * 4, [0.85] * 4)
    assert k(wide, "1se") == 4
    assert k(results(spark, [0.85, 0.83, 0.80], [0.01] * 3, [0.90] * 3, [0.80] * 3), "quantile") == 4
    with pytest.warns(RuntimeWarning):
        assert k(results(spark, [0.9, 0.8], [0.01] * 2, [0.40] * 2, [0.60] * 2), "quantile") == 2
    with pytest.warns(RuntimeWarning):
        assert k(results(spark, [0.9, 0.8]), "1se") == 2
    other = results(spark, [0.90, 0.88, 0.85, 0.50], [0.02] * 4, [0.92] * 4, [0.88] * 4)
    assert [k(other, "max"), k(other, "1se"), k(other, "quantile"), k(other, "max", not_two=True)] == [2, 3, 3, 3]
    assert k(other, "1se", k=4) == 4
    with pytest.raises(ValueError):
        k(other, "max", k=9)
    with pytest.raises(ValueError):
        k(other.filter("n_clusters = 2"), "max", not_two=True)
    ties = results(spark, [0.5, 0.9, 0.9], [0.0] * 3, [0.9] * 3, [0.9] * 3)
    assert k(ties, "max") == 3 and k(ties, "1se") == 4
    curve = spark.createDataFrame([("a", 2, 0.5), ("a", 3, 0.5), ("b", 2, None), ("b", 3, None)], "m string, k int, metric_value double")
    assert {r["m"]: r["k"] for r in selection.metric_optimum(curve, ["m"]).collect()} == {"a": 2, "b": None}


def test_reports(spark):
    rows = spark.createDataFrame([(0, 0), (100, 100), (50, 100)], "s int, n int")
    low, high = reports.wilson(F.col("s"), F.col("n"))
    got = {r["s"]: (r["lo"], r["hi"]) for r in rows.select("s", low.alias("lo"), high.alias("hi")).collect()}
    assert got[0] == (None, None) and got[100][0] > 0.9 and got[50][0] < 0.5 < got[50][1]
    stats = reports.summary_stats(spark.createDataFrame([("a", float(v)) for v in range(1, 6)] + [("b", 4.0), ("c", None)], "g string, v double"), ["g"], "v")
    by = {r["g"]: r for r in stats.collect()}
    assert by["a"]["mean"] == 3 and by["a"]["median"] == 3 and by["b"]["sd"] == 0 and by["c"]["mean"] is None
    with pytest.raises(ValueError):
        reports.anchors(rows, "s.x".split(".")[0]) if rows.count() != 3 else reports.anchors(rows.limit(2), "s")
    assert reports.anchors(rows, "s") == [0, 50, 100]
    text = reports.tex_table([{"m": "a_b", "v": 0.5}, {"m": "c", "v": 0.7}, {"m": "d", "v": None}], ["m", "v"], 2, "cap", "tab:x", {"v": "max"})
    assert r"a\_b & \underline{0.50}" in text and r"c & \textbf{0.70}" in text and "d & --" in text


def test_features(spark):
    x = features.features_from_matrix(spark, np.array([[1.0, 5.0], [3.0, 5.0], [5.0, 5.0]]))
    z = [r["x"] for r in features.standardize(x).orderBy("sample_id").collect()]
    assert np.allclose(z, [[-math.sqrt(1.5), 0], [0, 0], [math.sqrt(1.5), 0]])
    assert features.features_from_matrix(spark, [1, 2, 3]).count() == 1 and features.features_from_matrix(spark, np.array([1.0, 2, 3])).count() == 3
    with pytest.raises(ValueError):
        features.features_from_matrix(spark, "abc")
    with pytest.raises(ValueError):
        features.features_from_columns(spark.createDataFrame([(1, "a")], "i long, s string"), "i", ["s"])
    t = features.transpose(x, "sample_id", "x").orderBy("sample_id").collect()
    assert [r["x"] for r in t] == [[1, 3, 5], [5, 5, 5]]
    scores = np.array([r["x"] for r in features.pca(x, 1).orderBy("sample_id").collect()])
    assert np.allclose(scores.ravel(), [-2, 0, 2]) and features.explained_variance(x, 1)[0] == pytest.approx(4)
    assert [r["x"] for r in features.poly_embed(x, 2).orderBy("sample_id").collect()][1] == [3, 5, 9, 25, 15]
    assert len(features.fourier_embed(x, 6).first()["x"]) == 6
    with pytest.raises(ValueError):
        features.apply_step(x, "other", {})


def test_products(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "sample_id long, label int")
    order = {r["sample_id"]: (r["position"], r["boundary"]) for r in products.block_order(labels).collect()}
    assert order == {1: (0, False), 0: (1, True), 2: (2, False)}
    grid = {(r["row"], r["col"]): r["p"] for r in products.heatmap(pairs(spark, lambda i, j: 0.25 if (i, j) == (0, 2) else None, 3), products.block_order(labels)).collect()}
    assert grid[1, 2] == grid[2, 1] == 0.25 and grid[0, 1] == 0.5 and grid[0, 0] == 1 and len(grid) == 9
    flat = products.scatter_encoding(spark.createDataFrame([(0, 2.0), (1, 2.0), (2, None)], "sample_id long, score double"), "score")
    assert {r["sample_id"]: r["norm"] for r in flat.collect()} == {0: 0.5, 1: 0.5, 2: 0}
