import numpy as np
import pytest
from kohesion.functions import indices, reports
from kohesion.operators import benchmark, kernels
from kohesion.operators.simulate import make_blobs, simulate_clusters
from kohesion.operators.validator import Validator

GRIDS = [("kmeans", {"n_clusters": [2, 3, 4], "n_init": [3]})]


@pytest.fixture(scope="module")
def data(spark):
    return simulate_clusters(spark, 90, 3, 4, centers=10 * np.eye(3, 4), random_state=2).persist()


def test_validity_matches_the_relational_indices(spark, data):
    rows = data.orderBy("sample_id").toPandas()
    x, label = np.stack(rows["x"]), rows["label"].to_numpy()
    got = kernels.validity(x, label)
    for f, name in ((indices.silhouette, "silhouette"), (indices.calinski_harabasz, "calinski_harabasz"), (indices.davies_bouldin_inverted, "davies_bouldin_inverted"), (indices.dispersion, "dispersion")):
        assert got[name] == pytest.approx(f(data).first()[name])
    assert kernels.validity(x, np.zeros(90))["silhouette"] is None


def test_baselines(spark, data):
    x = data.select("sample_id", "x")
    truth = data.selectExpr("sample_id", "label as truth")
    curves = benchmark.baseline_curves(x, GRIDS, n_null=2)
    best = benchmark.baseline_best(curves)
    assert {r["metric_name"]: r["k"] for r in best.collect()}["silhouette"] == 3 and best.count() == 4
    labels = benchmark.baseline_best_labels(x, best, GRIDS, "silhouette")
    assert benchmark._ari(labels, truth) == 1
    with pytest.raises(KeyError):
        benchmark.baseline_best_labels(x, best, GRIDS, "other")
    with pytest.raises(ValueError):
        benchmark.baseline_curves(x, GRIDS, ["other"])
    fitted = Validator(n_resamples=5, estimator_param_grids=GRIDS, n_trees=3).fit(x)
    table = {(r["method"], r["source"]): r for r in benchmark.ari_comparison(truth, x, best, GRIDS, fitted).collect()}
    assert len(table) == 6 and table["stability", "validated"]["k"] == 3 and table["stability", "validated"]["ari"] > 0.9
    side = benchmark.composite(truth, labels, fitted.label_table())
    assert side.filter("truth <> own").count() == 0


def test_study(spark):
    rows = benchmark.difficulty_study(spark, GRIDS, ["easy"], simulation={"n_samples": 60, "n_features": 3}, metrics=["stability_1se", "pac"], n_resamples=3, n_trees=2).persist()
    assert rows.count() == 3 * 5
    picked = rows.filter("is_optimal")
    assert picked.count() == 5
    assert reports.k_recovery(picked, ["metric_name"]).count() == 5
    times = benchmark.scaling_study(spark, "samples", [40, 60, 80], GRIDS, simulation={"n_features": 2}, n_resamples=2).collect()
    assert [r["n"] for r in times] == [40, 60, 80] and all(r["t_sec_s"] > 0 for r in times) and {r["stage"] for r in times} == {"low", "mid", "high"}


def test_squarest_seed(spark):
    flat = make_blobs(spark, 60, 1, 2, 1.0, 0)
    long = flat.selectExpr("sample_id", "array(x[0] * 9, x[1]) as x", "label")
    assert benchmark.squarest_seed({1: long.select("sample_id", "x"), 2: flat.select("sample_id", "x")}) == 2


def test_silhouettes_are_shared_by_tasks(spark, monkeypatch):
    """No task compares all rows with all, whatever the number of configurations; the means are those of the definition."""
    x = np.random.default_rng(3).normal(size=(301, 4))
    codes = {0: np.arange(301) % 3, 1: np.arange(301) // 300, 2: np.zeros(301, int)}
    sent = spark.sparkContext.broadcast((np.arange(301), x))
    got = benchmark._silhouettes(spark, sent, codes, rows=50)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for c in (0, 1):
        total, size = np.stack([d[:, codes[c] == v].sum(1) for v in np.unique(codes[c])], 1), np.bincount(codes[c])
        want = []
        for i, v in enumerate(codes[c]):
            a, b = total[i, v] / max(size[v] - 1, 1), min(total[i, w] / size[w] for w in range(len(size)) if w != v)
            want.append((b - a) / max(a, b) if size[v] > 1 else 0.0)
        assert np.isclose(got[c], np.mean(want))
    assert got[2] is None
