"""Benchmarks: classical indices over k, their comparison with validated selections, and simulated studies."""

from __future__ import annotations

import math
import time
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohesion.functions.agreement import adjusted_rand
from kohesion.functions.indices import distance_sums
from kohesion.functions.selection import metric_optimum
from kohesion.operators.clustering import _clusterer
from kohesion.operators.kernels import align_labels, row_leaf_order, silhouette_sum, validity
from kohesion.operators.simulate import simulate_axis, simulate_difficulty
from kohesion.operators.validator import Validator
from kohesion.plans.planner import Config, GridSpec, parse_metric_name, plan_configs, resolve_measure

INDICES = ("silhouette", "calinski_harabasz", "davies_bouldin_inverted", "gap")
#: Uniform tables behind a gap statistic.
N_NULL = 10


def _matrix(x: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = x.select("sample_id", "x").toArrow().sort_by("sample_id")
    return rows.column("sample_id").to_numpy(), np.asarray(rows.column("x").combine_chunks().flatten(), float).reshape(rows.num_rows, -1)


def _on_tasks(x: DataFrame, configs: Sequence[Config], work, schema: str, sent=None) -> DataFrame:
    """``work(config, ids, x)`` for every configuration as one job.  The table has to fit a task, as its clusterers need it whole; ``sent`` is its broadcast, if there is one."""
    spark = x.sparkSession
    sent, plan = sent or spark.sparkContext.broadcast(_matrix(x)), {c.config_id: c for c in configs}

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield work(plan[i], *sent.value)

    # By range, as hashes would put several of so few rows into one task.
    tasks = spark.createDataFrame([(c.config_id,) for c in configs], "config_id int").repartitionByRange(max(1, len(configs)), "config_id")
    return tasks.mapInArrow(run, schema)


def full_labels(x: DataFrame, configs: Sequence[Config], seed: int = 0, sent=None) -> DataFrame:
    """(config_id, sample_id, label) of every configuration on the whole table."""

    def work(c: Config, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        found = np.asarray(_clusterer(c.estimator)(values, c.n_clusters, c.params, seed))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), c.config_id, np.int32)), pa.array(ids), pa.array(found.astype(np.int32))], ["config_id", "sample_id", "label"])

    return _on_tasks(x, configs, work, "config_id int, sample_id long, label int", sent)


def _silhouettes(spark: SparkSession, sent, codes: Mapping[int, np.ndarray], rows: int = 2048) -> dict[int, float | None]:
    """The mean silhouette of each labelling with codes from 0.  A task has some rows against all; distances are made once for all labellings."""
    n = len(next(iter(codes.values()), ()))
    sizes = {c: np.bincount(code) for c, code in codes.items()}
    fit = [c for c in codes if 2 <= len(sizes[c]) < n]
    labels = spark.sparkContext.broadcast({c: codes[c] for c in fit})
    rows = max(1, min(rows, -(-n // (4 * spark.sparkContext.defaultParallelism))))

    def run(batches):
        x = sent.value[1]
        one_hot = np.concatenate([np.eye(len(sizes[c]))[labels.value[c]] for c in fit], axis=1)
        edges = np.cumsum([0] + [len(sizes[c]) for c in fit])
        for batch in batches:
            for start in batch.column(0).to_pylist():
                total = distance_sums(x[start : start + rows], x, one_hot)
                sums = [silhouette_sum(total[:, edges[i] : edges[i + 1]], labels.value[c][start : start + rows], sizes[c]) for i, c in enumerate(fit)]
                yield pa.RecordBatch.from_arrays([pa.array([start] * len(fit), pa.int64()), pa.array(fit, pa.int32()), pa.array(sums)], ["start", "config_id", "sum"])

    out: dict[int, float | None] = dict.fromkeys(codes)
    if fit:
        starts = spark.createDataFrame([(i,) for i in range(0, n, rows)], "start long").repartitionByRange(max(1, min(-(-n // rows), 4096)), "start")
        found = starts.mapInArrow(run, "start long, config_id int, sum double").toArrow().sort_by("start").to_pylist()
        out |= {c: math.fsum(r["sum"] for r in found if r["config_id"] == c) / n for c in fit}
    return out


def leaf_order(x: DataFrame, linkage: str = "average") -> DataFrame:
    """(position, sample_id): the rows in the dendrogram order of a linkage."""

    def work(c: Config, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids[row_leaf_order(values, linkage)])], ["position", "sample_id"])

    return _on_tasks(x, [Config(0, "agglomerative", 1, {"linkage": linkage})], work, "position int, sample_id long")


def _log_dispersion(values: np.ndarray, labels: np.ndarray) -> float | None:
    w = _dispersion(values, labels)
    return float(np.log(w)) if w > 0 else None


def _dispersion(values: np.ndarray, labels: np.ndarray) -> float:
    return float(sum(((values[labels == c] - values[labels == c].mean(0)) ** 2).sum() for c in np.unique(labels)))


def baseline_curves(x: DataFrame, grids: Sequence[GridSpec], metrics: Sequence[str] = INDICES, seed: int = 0, n_null: int = N_NULL) -> DataFrame:
    """(config_id, model, k, metric_name, metric_value): classical indices of every configuration on the whole table."""
    unknown = set(metrics) - set(INDICES)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}; options: {', '.join(INDICES)}")
    configs, spark = plan_configs(grids), x.sparkSession
    sent = spark.sparkContext.broadcast(_matrix(x))
    # A number a row and configuration; the table itself is on the driver anyway.
    found = full_labels(x, configs, seed, sent).toArrow()
    number, ids, label = (found.column(c).to_numpy() for c in ("config_id", "sample_id", "label"))
    codes = {}
    for c in configs:
        own = np.flatnonzero(number == c.config_id)
        codes[c.config_id] = np.unique(label[own[np.argsort(ids[own], kind="stable")]], return_inverse=True)[1].astype(np.int32)
    silhouettes = _silhouettes(spark, sent, codes) if "silhouette" in metrics else {}
    labels = spark.sparkContext.broadcast(codes)

    def work(c: Config, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        cluster, found = _clusterer(c.estimator), labels.value[c.config_id]
        scores = validity(values, found, silhouette=False) | {"silhouette": silhouettes.get(c.config_id)}
        if "gap" in metrics:
            rng, own = np.random.default_rng(seed), _log_dispersion(values, found)
            null = []
            for b in range(n_null):
                box = rng.uniform(values.min(0), values.max(0), values.shape)
                null.append(_log_dispersion(box, np.asarray(cluster(box, c.n_clusters, c.params, seed + b))))
            scores["gap"] = None if own is None or None in null else float(np.mean(null)) - own
        n = len(metrics)
        name = c.estimator if isinstance(c.estimator, str) else getattr(c.estimator, "__name__", "custom")
        return pa.RecordBatch.from_arrays(
            [pa.array([c.config_id] * n, pa.int32()), pa.array([name] * n), pa.array([c.n_clusters] * n, pa.int32()), pa.array(list(metrics)), pa.array([scores[m] for m in metrics], pa.float64())],
            ["config_id", "model", "k", "metric_name", "metric_value"],
        )

    return _on_tasks(x, configs, work, "config_id int, model string, k int, metric_name string, metric_value double", sent)


def baseline_best(curves: DataFrame) -> DataFrame:
    """Per metric the configuration of the highest value, the smallest k on ties; a metric without values keeps a null row."""
    return metric_optimum(curves, ["metric_name"])


def baseline_best_labels(x: DataFrame, best: DataFrame, grids: Sequence[GridSpec], metric: str, seed: int = 0) -> DataFrame:
    """(sample_id, label) of the configuration that ``metric`` picked; KeyError if it picked none."""
    row = best.filter(F.col("metric_name") == metric).first()
    if row is None or row["k"] is None:
        raise KeyError(metric)
    chosen = [c for c in plan_configs(grids) if c.config_id == row["config_id"]]
    return full_labels(x, chosen, seed).select("sample_id", "label")


def ari_comparison(truth: DataFrame, x: DataFrame, best: DataFrame, grids: Sequence[GridSpec], fitted: Validator, measures: Sequence[str] = ("stability", "generalizability"), rule: str = "1se", not_two: bool = False, seed: int = 0) -> DataFrame:
    """(method, model, k, ari, source): agreement with ``truth(sample_id, truth)`` of classical picks and of validated ones."""
    spark = x.sparkSession
    rows = []
    for r in best.filter("k is not null").collect():
        found = baseline_best_labels(x, best, grids, r["metric_name"], seed)
        rows.append((r["metric_name"], r["model"], r["k"], _ari(found, truth), "baseline"))
    for m in measures:
        row = fitted.get_row(m, rule, not_two)
        rows.append((m, row["estimator"], row["n_clusters"], _ari(fitted.label_table(measure=m, rule=rule, not_two=not_two), truth), "validated"))
    return spark.createDataFrame(rows, "method string, model string, k int, ari double, source string")


def _ari(found: DataFrame, truth: DataFrame) -> float:
    return adjusted_rand(found.join(truth, "sample_id"), [], "label", "truth").first()["ari"]


def composite(truth: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """(sample_id, truth, own, other): two labellings renamed after the truth, ready for flows and crosstabs."""
    rows = truth.join(own.select("sample_id", F.col("label").alias("own")), "sample_id").join(other.select("sample_id", F.col("label").alias("other")), "sample_id").orderBy("sample_id").toPandas()
    t = rows["truth"].to_numpy()
    rows["own"], rows["other"] = align_labels(t, rows["own"].to_numpy()), align_labels(t, rows["other"].to_numpy())
    return truth.sparkSession.createDataFrame([tuple(int(v) for v in r) for r in rows[["sample_id", "truth", "own", "other"]].itertuples(index=False)], "sample_id long, truth int, own int, other int")


def squarest_seed(tables: Mapping[int, DataFrame]) -> int:
    """The seed whose first two principal components are most alike in variance."""
    from kohesion.functions.features import explained_variance

    def ratio(x: DataFrame) -> float:
        v = explained_variance(x, 2)
        return min(v) / max(v) if max(v) > 0 else 0.0

    return max(sorted(tables), key=lambda s: ratio(tables[s]))


# ---------------------------------------------------------------- studies

#: Validated selections that a study scores.
METRICS = ("stability", "stability_1se", "stability_quant", "generalizability", "generalizability_1se", "generalizability_quant", "pac", "gini", "ce", "accuracy")
ROW_SCHEMA = "axis_name string, axis_value double, stage string, baseline_ari double, dataset_iteration int, true_k int, metric_name string, k int, metric_value double, is_optimal boolean, is_correct boolean, metric_ari double"


def study_rows(data: DataFrame, grids: Sequence[GridSpec], true_k: int, seed: int, axis: str, value: float | None, stage: str, metrics: Sequence[str] = METRICS, classical: Sequence[str] = INDICES[:3], **options) -> list[tuple]:
    """One dataset's long rows: every candidate k of every metric, the one that it picks, and agreement with the truth."""
    x, truth = data.select("sample_id", "x").persist(), data.select("sample_id", F.col("label").alias("truth")).persist()
    fitted = Validator(estimator_param_grids=list(grids), random_state=seed, **options).fit(x)
    configs = plan_configs(grids)
    oracle = [c for c in configs if c.n_clusters == true_k][:1]
    baseline = _ari(full_labels(x, oracle, seed), truth) if oracle else None
    ks = sorted({c.n_clusters for c in configs})
    aris = {k: _ari(fitted.label_table(k=k, rule="max"), truth) for k in ks}
    out = []
    table = fitted.fitted.results.collect()
    for name in metrics:
        measure, rule = parse_metric_name(name)
        column = resolve_measure(measure)
        # With few resamples a consensus measure can be null throughout; then nothing is picked.
        picked = fitted.get_row(measure, rule)["n_clusters"] if any(r[column] is not None for r in table) else None
        for k in ks:
            own = [r[column] for r in table if r["n_clusters"] == k and r[column] is not None]
            out.append((axis, value, stage, baseline, seed, true_k, name, k, max(own, default=None), k == picked, k == true_k, aris[k]))
    curves = baseline_curves(x, grids[:1], classical, seed).collect()
    own = {(r["metric_name"], r["k"]): r["metric_value"] for r in curves}
    labels = full_labels(x, plan_configs(grids[:1]), seed).persist()
    by_k = {c.n_clusters: _ari(labels.filter(F.col("config_id") == c.config_id), truth) for c in plan_configs(grids[:1])}
    for name in classical:
        known = [k for k in ks if own.get((name, k)) is not None]
        picked = max(known, key=lambda k: (own[name, k], -k)) if known else None
        out += [(axis, value, stage, baseline, seed, true_k, name, k, own.get((name, k)), k == picked, k == true_k, by_k.get(k)) for k in ks]
    for table in (x, truth, labels):
        table.unpersist()
    return out


def difficulty_study(spark: SparkSession, grids: Sequence[GridSpec], difficulties: Sequence[str] = ("easy", "medium", "hard"), n_seeds: int = 1, true_k: int = 3, simulation: Mapping | None = None, **options) -> DataFrame:
    """Long rows over difficulties and seeds; dataset seeds are spaced by 10,000 a difficulty."""
    rows = []
    for i, difficulty in enumerate(difficulties):
        for s in range(n_seeds):
            seed = s + 10_000 * i
            data = simulate_difficulty(spark, difficulty, seed, n_clusters=true_k, **(simulation or {}))
            rows += study_rows(data, grids, true_k, seed, "difficulty", float(i), difficulty, **options)
    return spark.createDataFrame(rows, ROW_SCHEMA)


def scaling_study(spark: SparkSession, axis: str, values: Sequence[float], grids: Sequence[GridSpec], n_seeds: int = 1, true_k: int = 3, simulation: Mapping | None = None, n_resamples: int = 100) -> DataFrame:
    """(axis_name, axis_value, stage, dataset_iteration, true_k, n, p, seconds of a stability and of a generalizability fit, and per k)."""
    import warnings

    ks = sorted({c.n_clusters for c in plan_configs(grids)})
    rows = []
    for i, value in enumerate(values):
        for s in range(n_seeds):
            data = simulate_axis(spark, axis, value, s + 10_000 * i, **({"n_clusters": true_k} | dict(simulation or {}))).select("sample_id", "x").persist()
            n, p = data.count(), len(data.first()["x"])
            seconds = {}
            for mode in ("stability", "generalizability"):
                began = time.perf_counter()
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    Validator(n_resamples=n_resamples, estimator_param_grids=list(grids), random_state=s).fit(data, mode=mode)
                seconds[mode] = time.perf_counter() - began
            stage = ("low", "mid", "high")[i] if len(values) == 3 else str(i)
            rows.append((axis, float(value), stage, s, true_k, n, p, seconds["stability"], seconds["generalizability"], seconds["stability"] / len(ks), seconds["generalizability"] / len(ks)))
            data.unpersist()
    return spark.createDataFrame(rows, "axis_name string, axis_value double, stage string, dataset_iteration int, true_k int, n int, p int, t_sec_s double, t_sec_g double, t_per_k_sec_s double, t_per_k_sec_g double")

