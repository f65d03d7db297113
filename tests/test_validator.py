import numpy as np
import pytest
from kohesion.functions import indices, sampling
from kohesion.functions.features import features_from_matrix
from kohesion.operators import clustering, simulate
from kohesion.operators.labels import attach_labels, factorize
from kohesion.operators.validator import Validator
from kohesion.functions import selection
from kohesion.plans.planner import Config, plan_branches
from kohesion.sources import reports
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def x(spark):
    rng = np.random.RandomState(42)
    return features_from_matrix(spark, np.concatenate([rng.randn(30, 5) + 6 * np.eye(5)[i] for i in range(3)]))


@pytest.fixture(scope="module")
def fitted(x):
    grids = [("kmeans", {"n_clusters": [2, 3, 4]}), ("agglomerative", {"n_clusters": [2, 3, 4], "linkage": ["ward"]})]
    return Validator(n_resamples=8, subsample_ratio=0.8, estimator_param_grids=grids, n_trees=10, random_state=0).fit(x)


def test_fit(fitted):
    rows = {r["config_id"]: r for r in fitted.fitted.results.collect()}
    assert len(rows) == 6 and fitted.get_k() == 3 and fitted.get_k("gini", "max") == 3
    best = rows[1]
    assert best["ari_stability"] > 0.9 and best["ari_generalizability"] > 0.9 and best["consensus_pac_stability"] > 0.95
    assert best["accuracy_generalizability"] > 0.3 and best["n_clusters"] == 3
    assert best["ari_average"] == pytest.approx((best["ari_stability"] + best["ari_generalizability"]) / 2)
    name, params = fitted.get_estimator()
    assert name in ("kmeans", "agglomerative") and params["n_clusters"] == 3
    assert fitted.get_estimator(k=4)[1]["n_clusters"] == 4
    assert fitted.warnings_table().count() == 0


def test_labels(fitted, x):
    truth = np.repeat([2, 0, 1], 30)
    labels = fitted.get_labels()
    assert len(np.unique(labels)) == 3 and all(len(set(labels[i * 30 : i * 30 + 30])) == 1 for i in range(3))
    assert (fitted.get_labels(reference=truth) == truth).all()
    assert (fitted.get_labels(mode="generalizability") >= 0).all()
    assert attach_labels(x, fitted.label_table(), "sample_id").count() == 90
    with pytest.raises(ValueError):
        attach_labels(x.limit(10), fitted.label_table(), "sample_id")
    with pytest.raises(ValueError):
        fitted.get_labels(mode="other")


def test_reports(fitted):
    assert fitted.metric_over_n_clusters().count() == 6
    assert fitted.cluster_quartiles().count() == 3
    assert fitted.scatter().count() == 90
    assert fitted.consensus_heatmap().count() == 90 * 90
    assert {r["n_clusters"] for r in fitted.preprocessing_summary().collect()} == {2, 3, 4}


def test_modes_and_state(spark, x, tmp_path, fitted):
    with pytest.raises(RuntimeError):
        Validator().get_k()
    grids = [("kmeans", {"n_clusters": [2, 3]})]
    with pytest.warns(RuntimeWarning):
        one = Validator(n_resamples=3, estimator_param_grids=grids).fit(x, mode="stability")
    row = one.fitted.results.first()
    assert row["ari_generalizability"] is None and row["accuracy_generalizability"] is None and row["ari_stability"] is not None
    with pytest.raises(RuntimeError):
        one.consensus(0, "generalizability")
    fitted.save(f"{tmp_path}/state")
    again = Validator.load(spark, f"{tmp_path}/state")
    assert again.get_k() == 3 and (again.get_labels() == fitted.get_labels()).all()
    with pytest.raises(RuntimeError):
        again.scatter()
    fitted.save(f"{tmp_path}/data", include_data=True)
    assert Validator.load(spark, f"{tmp_path}/data").scatter().count() == 90
    with pytest.raises(FileNotFoundError):
        Validator.load(spark, f"{tmp_path}/none")
    (tmp_path / "other").mkdir()
    with pytest.raises(TypeError):
        Validator.load(spark, f"{tmp_path}/other")


def test_random_preprocessing(x):
    own = Validator(n_resamples=5, estimator_param_grids=[("kmeans", {"n_clusters": [3]})], n_trees=3, normalization_options=[("standardize", {}), ("identity", {})], dim_reduction_options=[("pca", {"n_components": [2, 3]})])
    own.fit(x, randomize_preprocessing=True, random_state=1)
    assert own.fitted.runs.select("resample").distinct().count() == 5
    assert own.fitted.results.first()["ari_stability"] > 0.8


def test_broadcast_and_grouped_plans_agree(spark, x):
    from kohesion.functions.sampling import membership

    members = membership(x, 2)
    configs = [Config(0, "kmeans", 3), Config(1, "agglomerative", 2, {"linkage": "average"})]
    a, b = (sorted(map(tuple, clustering.cluster_runs(x, members, configs, plan_branches("default"), "nearest_centroid", broadcast_bytes=n).collect())) for n in (1 << 20, 0))
    assert a == b and len(a) > 0
    with pytest.raises(ValueError):
        clustering.cluster_runs(x, members, [Config(0, "other", 2)], plan_branches("default"))
    custom = clustering.cluster_runs(x, members, [Config(0, lambda v, k, p, s: np.zeros(len(v), int), 2)], plan_branches("stability"))
    assert custom.select("label").distinct().count() == 1


def test_indices(spark, x):
    truth = spark.createDataFrame([(i, i // 30) for i in range(90)], "sample_id long, label int")
    good, bad = x.join(truth, "sample_id"), x.join(truth.withColumn("label", F.col("sample_id") % 3), "sample_id")
    for f, name in ((indices.silhouette, "silhouette"), (indices.calinski_harabasz, "calinski_harabasz"), (indices.davies_bouldin_inverted, "davies_bouldin_inverted")):
        assert f(good).first()[name] > f(bad).first()[name]
    assert indices.calinski_harabasz(good.filter("label = 0")).first()["calinski_harabasz"] is None
    values = np.array([r["x"] for r in x.orderBy("sample_id").collect()])
    d = ((values[:, None] - values[None]) ** 2).sum(2)
    want = {(i, r + 1): j for i in range(90) for r, j in enumerate(np.argsort(d[i], kind="stable")[:4])}
    assert {(r["i"], r["rank"]): r["j"] for r in indices.knn(x, 4, block=13).collect()} == want


def test_simulation(spark):
    for kind in simulate.SHAPES:
        df = simulate.simulate_clusters(spark, 200, 2, 3, distribution=kind, outliers=10, scale=[1.0, 2.0], corr="ar1", rho=0.3)
        assert df.count() == 200 and df.filter("label = -1").count() == 10 and len(df.first()["x"]) == 3
    a, b = (sorted(map(tuple, (map(str, r) for r in simulate.simulate_clusters(spark, 100, 3, 2, random_state=s).collect()))) for s in (1, 1))
    assert a == b
    for method in ("none", "best_candidate", "lhs", "min_dist"):
        assert simulate.place_centers(method, 4, 2, (-5, 5), np.random.default_rng(0)).shape == (4, 2)
    assert simulate.cluster_sizes(11, 3) == [4, 4, 3] and simulate.cluster_sizes(10, 2, [0.75, 0.25]) == [8, 2]
    assert min(simulate.cluster_sizes(100, 5, balanced=False, min_abs=10, rng=np.random.default_rng(0))) >= 10
    with pytest.raises(ValueError):
        simulate.cluster_sizes(5, 3, balanced=False, min_abs=4)
    with pytest.warns(RuntimeWarning):
        assert simulate.outlier_count(1.5, 100) == 0
    assert simulate.outlier_count(0.0, 100) == 0 and simulate.outlier_count(0.05, 100) == 5
    for embed, p in (("poly", 5), ("rbf", 50), ("random_fourier", 7)):
        x = simulate.simulate_clusters(spark, 80, 2, 2, embed=embed, embed_dim=7, post_scale="standardize_preserve", noise_dims=2)
        assert len(x.first()["x"]) == p + 2
    assert np.linalg.eigvalsh(simulate.correlation("block", 5, 0.5, 2)).min() > 0
    with pytest.raises(ValueError):
        simulate.correlation("ar1", 3, 1.5)
    assert simulate.simulate_difficulty(spark, "easy", n_samples=30).count() == 30
    assert simulate.simulate_axis(spark, "samples", 44.5).count() == 45
    assert simulate.make_moons(spark, 50).count() == 50


def test_sources(spark, tmp_path):
    (tmp_path / "results_a.csv").write_text("metric_name,k,true_k,is_optimal,metric_value\nm,3,3,True,0.5\nm,x,3,no,bad\n")
    (tmp_path / "results_b.csv").write_text("metric_name,k,true_k,is_optimal,metric_value\nm,4,3,1,0.25\n")
    rows = sorted(reports.load_results(spark, f"{tmp_path}/results_*.csv").collect(), key=str)
    assert {(r["benchmark"], r["k"], r["is_optimal"], r["metric_value"]) for r in rows} == {("a", 3, True, 0.5), ("a", None, False, None), ("b", 4, True, 0.25)}
    import bz2

    (tmp_path / "block.csv.bz2").write_bytes(bz2.compress(b"gene,c1,c2\ng1,1,x\ng2,3,4\ng1,9,9\n"))
    block = reports.read_block(spark, f"{tmp_path}/block.csv.bz2", "gene")
    assert {(r["id"], r["column"]): r["value"] for r in block.collect()} == {("g1", "c1"): 1, ("g1", "c2"): 0, ("g2", "c1"): 3, ("g2", "c2"): 4}
    other = spark.createDataFrame([("g3", "d1", 7.0)], "id string, column string, value double")
    assert reports.align_blocks([block, other]).count() == 9
    df = spark.createDataFrame([(1, 0.5)], "a int, b double")
    assert reports.write_once(df, f"{tmp_path}/once").collect() == reports.write_once(df.limit(0), f"{tmp_path}/once").collect() == df.collect()
    named = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2)], "v string, p int")
    assert {r["v"]: r["code"] for r in factorize(named, "v", "p").collect()} == {"b": 0, "a": 1}
    assert {r["v"]: r["code"] for r in factorize(named, "v", "p", by_value=True).collect()} == {"b": 1, "a": 0}


def test_estimator_objects(spark):
    class Halves:
        """A clusterer in the manner of other libraries."""

        def __init__(self, n_clusters=2, shift=0.0):
            self.n_clusters, self.shift, self.random_state = n_clusters, shift, None

        def fit(self, x):
            cuts = np.quantile(x[:, 0], np.linspace(0, 1, self.n_clusters + 1)[1:-1])
            self.labels_ = np.searchsorted(cuts, x[:, 0] + self.shift)
            return self

    class Nearest:
        """A classifier object; it must be copied for every use."""

        def __init__(self):
            self.used, self.random_state = 0, None

        def fit(self, x, y):
            assert self.used == 0
            self.used, self.x, self.y = 1, x, y

        def predict(self, new):
            return self.y[((new[:, None] - self.x[None]) ** 2).sum(2).argmin(1)]

    from kohesion.functions.features import features_from_matrix

    x = features_from_matrix(spark, np.random.default_rng(0).normal(size=(60, 3)))
    grids = [(Halves(), {"n_clusters": [2, 3], "shift": [0.0]}), (Halves, {"n_clusters": [2, 3]})]
    fit = Validator(n_resamples=4, estimator_param_grids=grids, classifier=Nearest()).fit(x)
    rows = fit.fitted.results.orderBy("config_id").collect()
    assert len(rows) == 4 and all(r["ari_generalizability"] is not None for r in rows)
    # Parameters of any name come back.
    assert selection.hyper_params(rows[0]) == {"n_clusters": 2, "shift": 0.0}
    assert fit.get_estimator(rule="max")[1]["n_clusters"] in (2, 3)


TIMES = ("seconds_s", "seconds_g", "seconds_per_k_s", "seconds_per_k_g")


def test_runtimes(spark, tmp_path):
    header = ",".join([*(c.split()[0] for c in reports.RUNTIME_COLUMNS.split(", ")), *TIMES])
    (tmp_path / "runtimes.csv").write_text(f"{header}\nsamples,1000,low,0,5,1000,50,20,10,kmeans,2.0,15.0,0.4,3.0\nsamples,1000,low,1,5,1000,50,20,10,kmeans,4.0,17.0,0.8,3.4\n")
    from kohesion.functions.reports import runtime_table

    got = runtime_table(reports.load_runtimes(spark, f"{tmp_path}/runtimes.csv", TIMES), "axis_value", [1000], {"s": TIMES[0], "g": TIMES[1]}).collect()
    assert {r["stage"]: r["1000_mean"] for r in got} == {"s": 3.0, "g": 16.0}


def test_tiles_equal_brute_force():
    """Products find the candidates, differences decide: ties go to the smaller place, copies are at exactly zero."""
    rng = np.random.default_rng(0)
    for n, m, p in ((700, 5000, 3), (60, 4500, 64), (10, 5, 4)):
        b = rng.integers(0, 9, (m, p)).astype(float) if p == 3 else rng.normal(size=(m, p)) + 100
        a = np.concatenate([b[: min(n, m) // 2], rng.normal(size=(n, p))])[:n]
        own = np.where(np.arange(n) < min(n, m) // 2, np.arange(n), -1)
        d = indices.exact_distances(a, b)
        order = np.argsort(np.where(own[:, None] == np.arange(m), -1.0, d), axis=1, kind="stable")[:, :7]
        place, d2 = indices.nearest_rows(a, b, 7, own)
        assert (place == order).all() and (d2 == np.take_along_axis(d, order, 1)).all()
        one_hot = np.eye(3)[rng.integers(0, 3, m)]
        assert np.allclose(indices.distance_sums(a, b, one_hot), np.sqrt(d) @ one_hot, rtol=1e-9, atol=1e-7)


def test_subsamples_are_tasks_of_their_own(spark):
    """Five resamples with two subsamples are ten tasks' work; hashes put several into one."""
    rng = np.random.default_rng(0)
    x = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(60)], "sample_id long, x array<double>")
    found = clustering.cluster_runs(x, sampling.membership(x, 5), [Config(0, "kmeans", 2)], plan_branches("stability"))
    tasks = found.filter("split <> 'test'").groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("resample", "split").alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 10 and len(tasks) >= 9


def test_gap_takes_tables_that_carry_x(spark):
    x = spark.createDataFrame([(i, [float(i % 7), float(i * i % 11)]) for i in range(40)], "sample_id long, x array<double>")
    cut = lambda t, s: t.withColumn("label", (F.col("x")[0] > 3).cast("int"))
    assert indices.gap_statistic(x, cut, 2, 1) == pytest.approx(indices.gap_statistic(x, lambda t, s: cut(t, s).drop("x"), 2, 1))
