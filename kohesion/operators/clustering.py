"""Clusterings of every configuration and resample as one Spark job.

For each (configuration, resample) a task clusters the two subsamples and the
held-out rows, trains the classifier and predicts.  Its kernels hold a
subsample in memory, so a feature matrix of up to ``BROADCAST_BYTES`` goes to
the executors once and only ids are shuffled; a larger one is joined to the
memberships and grouped by task.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Collection, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohesion.operators.kernels import CLASSIFIERS, CLUSTERERS
from kohesion.plans.planner import GENERALIZABILITY, STABILITY, Config

BROADCAST_BYTES = 256 << 20
RUN_SCHEMA = "config_id int, resample int, split string, sample_id long, label int, label_pred int"
_FIELDS = [("config_id", pa.int32()), ("resample", pa.int32()), ("split", pa.string()), ("sample_id", pa.int64()), ("label", pa.int32()), ("label_pred", pa.int32())]


def _labels_of(estimator: Any, x: np.ndarray) -> np.ndarray:
    """The labels that an estimator object finds: ``fit_predict``, else ``fit`` and ``labels_``, else ``predict`` after ``fit``."""
    if hasattr(estimator, "fit_predict"):
        return estimator.fit_predict(x)
    fitted = estimator.fit(x) or estimator
    return fitted.labels_ if hasattr(fitted, "labels_") else fitted.predict(x)


def _with_settings(estimator: Any, settings: Mapping[str, Any], seed: int) -> Any:
    """A fresh copy of an estimator object with the settings it knows, and the seed if it takes one."""
    own = copy.deepcopy(estimator)
    for name, value in {**settings, "random_state": seed}.items():
        if name != "random_state" or hasattr(own, name):
            setattr(own, name, value)
    return own


def _clusterer(name: Any) -> Callable:
    """A function (x, k, params, seed) from a name, a function, a class or an estimator object."""
    if isinstance(name, type):
        return lambda x, k, params, seed: _labels_of(_with_settings(name(), {"n_clusters": k, **params}, seed), x)
    if hasattr(name, "fit") or hasattr(name, "fit_predict"):
        return lambda x, k, params, seed: _labels_of(_with_settings(name, {"n_clusters": k, **params}, seed), x)
    if callable(name):
        return name
    if name not in CLUSTERERS:
        raise ValueError(f"unknown estimator {name!r}; options: {', '.join(CLUSTERERS)}")
    return CLUSTERERS[name]


def _classifier(name: Any) -> Callable:
    """A function (x, labels, new x, params, seed) from a name, a function or a classifier object, which is copied for every use."""
    if hasattr(name, "fit") and hasattr(name, "predict"):

        def predict(x, labels, new, params, seed):
            own = _with_settings(name, params, seed)
            return (own.fit(x, labels) or own).predict(new)

        return predict
    if callable(name):
        return name
    if name not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {name!r}; options: {', '.join(CLASSIFIERS)}")
    return CLASSIFIERS[name]


def validate_task(ids: Mapping[str, np.ndarray], x: Mapping[str, np.ndarray], cluster: Callable, k: int, params: Mapping, classify: Callable, classify_params: Mapping, seed: int, branches: Collection[str]) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(split, ids, labels, predicted labels) of one configuration's clusterings on one resample."""
    out, train = [], None
    if len(ids.get("train", ())):
        train = np.asarray(cluster(x["train"], k, params, seed))
        out.append(("train", ids["train"], train, None))
    if STABILITY in branches and len(ids.get("stab", ())):
        out.append(("stab", ids["stab"], np.asarray(cluster(x["stab"], k, params, seed)), None))
    if GENERALIZABILITY in branches and len(ids.get("test", ())) and train is not None:
        test = np.asarray(cluster(x["test"], k, params, seed)) if len(ids["test"]) >= k else np.zeros(len(ids["test"]), np.int64)
        out.append(("test", ids["test"], test, np.asarray(classify(x["train"], train, x["test"], classify_params, seed))))
    return out


_SPLITS = ("train", "stab", "test")


def _rows(config_id: int, resample: int, found) -> pa.RecordBatch:
    n = [len(f[1]) for f in found]
    total = sum(n)
    pred = pa.concat_arrays([pa.nulls(len(f[1]), pa.int32()) if f[3] is None else pa.array(f[3].astype(np.int32)) for f in found])
    columns = [
        pa.array(np.full(total, config_id, np.int32)),
        pa.array(np.full(total, resample, np.int32)),
        pa.array(_SPLITS).take(pa.array(np.repeat([_SPLITS.index(f[0]) for f in found], n))),
        pa.array(np.concatenate([f[1] for f in found]).astype(np.int64)),
        pa.array(np.concatenate([f[2] for f in found]).astype(np.int32)),
        pred,
    ]
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in _FIELDS])


def cluster_runs(
    features: DataFrame,
    members: DataFrame,
    configs: Sequence[Config],
    branches: Collection[str],
    classifier: Any = "forest",
    classifier_params: Mapping[str, Any] | None = None,
    random_state: int = 0,
    broadcast_bytes: int = BROADCAST_BYTES,
    n_resamples: int | None = None,
) -> DataFrame:
    """RUNS with ``label_pred``, which held-out rows have.

    A task has the ids of one resample and some of the configurations: all of
    them if ``n_resamples`` keep the cluster busy, fewer if they don't.
    """
    spark = features.sparkSession
    plan = {c.config_id: (_clusterer(c.estimator), c.n_clusters, dict(c.params)) for c in configs}
    classify, classify_params = _classifier(classifier), dict(classifier_params or {})
    shape = features.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).first()

    def run(config_id: int, resample: int, ids, x) -> pa.RecordBatch:
        cluster, k, params = plan[config_id]
        return _rows(config_id, resample, validate_task(ids, x, cluster, k, params, classify, classify_params, random_state + resample, branches))

    if (shape["n"] or 0) * (shape["p"] or 0) * 8 <= broadcast_bytes:
        # At most broadcast_bytes, checked just above.
        rows = features.select("sample_id", "x").toArrow()
        own = rows.column("sample_id").to_numpy()
        order = np.argsort(own)
        x = np.asarray(rows.column("x").combine_chunks().flatten(), float).reshape(len(own), -1)[order] if len(own) else np.zeros((0, 1))
        sent = spark.sparkContext.broadcast((own[order], x))
        shares = len(configs) if n_resamples is None else min(len(configs), -(-4 * spark.sparkContext.defaultParallelism // max(n_resamples, 1)))
        # Agglomerative configurations that differ in the number of clusters alone cut one tree, so they go together.
        alike: dict[tuple, list[int]] = {}
        for c in configs:
            alike.setdefault((c.estimator, json.dumps(c.params, sort_keys=True, default=str)) if c.estimator == "agglomerative" else (c.config_id,), []).append(c.config_id)
        units = list(alike.values())
        shares = min(shares, len(units))
        groups = spark.createDataFrame([(g, [i for u in units[g::shares] for i in u]) for g in range(shares)], "share int, configs array<int>")
        draws = members.groupBy("resample").agg(*[F.collect_list(F.when(F.col("split") == s, F.col("sample_id"))).alias(s) for s in _SPLITS])
        # The second subsample asks for nothing of the first, so it is a task of its own.
        none, halves = F.array().cast("array<long>"), 2 if STABILITY in branches else 1
        parts = [F.when(F.col("half") == (halves - 1 if s == "stab" else 0), F.col(s)).otherwise(none).alias(s) for s in _SPLITS]
        tasks = draws.crossJoin(F.broadcast(groups)).withColumn("half", F.explode(F.array(*[F.lit(h) for h in range(halves)])))
        # By range, as hashes would put several of so few rows into one task.
        dealt = max(1, min(4096, shares * (n_resamples or draws.count()) * halves))
        tasks = tasks.repartitionByRange(dealt, "resample", "share", "half").select("resample", "configs", *parts)

        def from_broadcast(batches):
            known, x = sent.value
            for batch in batches:
                lists = [batch.column(i) for i in range(1, 5)]
                bounds = [np.asarray(c.offsets) for c in lists]
                values = [np.asarray(c.values) for c in lists]
                for i, resample in enumerate(batch.column(0).to_pylist()):
                    numbers, *parts = [v[b[i] : b[i + 1]] for v, b in zip(values, bounds, strict=True)]
                    ids = {name: np.sort(v) for name, v in zip(_SPLITS, parts, strict=True) if len(v)}
                    if not ids:
                        continue
                    held = {s: x[np.searchsorted(known, v)] for s, v in ids.items()}
                    for config_id in numbers.tolist():
                        yield run(config_id, resample, ids, held)

        return tasks.mapInArrow(from_broadcast, RUN_SCHEMA)

    numbers = spark.createDataFrame([(c.config_id,) for c in configs], "config_id int")
    joined = members.join(features, "sample_id").crossJoin(F.broadcast(numbers))

    def grouped(table: pa.Table) -> pa.Table:
        table = table.sort_by("sample_id")
        split = np.array(table.column("split").to_pylist())
        own = table.column("sample_id").to_numpy()
        x = np.asarray(table.column("x").combine_chunks().flatten(), float).reshape(len(own), -1)
        names = np.unique(split)
        return pa.Table.from_batches([run(table.column("config_id")[0].as_py(), table.column("resample")[0].as_py(), {s: own[split == s] for s in names}, {s: x[split == s] for s in names})])

    return joined.groupBy("config_id", "resample").applyInArrow(grouped, RUN_SCHEMA)


def config_table(spark, configs: Sequence[Config]) -> DataFrame:
    """(config_id, estimator, n_clusters, linkage, affinity, gamma, params)."""
    rows = [(c.config_id, c.estimator if isinstance(c.estimator, str) else getattr(c.estimator, "__name__", "custom"), c.n_clusters, c.params.get("linkage"), c.params.get("affinity"), None if c.params.get("gamma") is None else float(c.params["gamma"]), json.dumps(c.params, sort_keys=True, default=str)) for c in configs]
    return spark.createDataFrame(rows, "config_id int, estimator string, n_clusters int, linkage string, affinity string, gamma double, params string")


def voronoi_runs(features: DataFrame, members: DataFrame, ks: Sequence[int], random_state: int = 0, n_resamples: int | None = None) -> DataFrame:
    """RUNS of a clusterer that is DataFrame expressions alone: k seeds by smallest md5, nearest seed wins.

    ``config_id`` is the number of clusters.  Held-out rows get ``label_pred``
    from the nearest centroid of the training clusters.
    """
    from pyspark.sql import Window

    from kohesion.functions.features import squared_distance

    most = max(ks)
    rows = members.join(features, "sample_id")
    key = F.md5(F.concat_ws(":", F.lit("seed"), F.col("resample").cast("string"), F.col("split"), F.col("sample_id").cast("string")))
    place = F.row_number().over(Window.partitionBy("resample", "split").orderBy("key", "sample_id"))
    picked = members.withColumn("key", key).withColumn("seed", place).filter(F.col("seed") <= most).join(features, "sample_id")
    # At most max(ks) seeds a subsample.
    seeds = picked.groupBy("resample", "split").agg(F.transform(F.sort_array(F.collect_list(F.struct("seed", "x"))), lambda s: s["x"]).alias("seeds"))
    near = rows.join(seeds, ["resample", "split"]).select("resample", "split", "sample_id", "x", F.transform("seeds", lambda s: squared_distance("x", s)).alias("d"))
    each = near.withColumn("config_id", F.explode(F.array(*[F.lit(k) for k in ks])))
    first = F.slice("d", F.lit(1), F.col("config_id"))
    labelled = each.select("config_id", "resample", "split", "sample_id", "x", (F.array_position(first, F.array_min(first)) - 1).cast("int").alias("label"))
    return labelled


def nearest_centroid_runs(labelled: DataFrame) -> DataFrame:
    """PRED_RUNS of ``voronoi_runs``: the held-out clusterings against the nearest training centroid."""
    from kohesion.functions.features import squared_distance

    train = labelled.filter("split = 'train'")
    means = train.select("config_id", "resample", "label", F.posexplode("x").alias("dim", "v")).groupBy("config_id", "resample", "label", "dim").agg(F.avg("v").alias("v"))
    centers = means.groupBy("config_id", "resample", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda e: e["v"]).alias("c"))
    packed = centers.groupBy("config_id", "resample").agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("centers"))
    test = labelled.filter("split = 'test'").join(packed, ["config_id", "resample"])
    nearest = F.array_min(F.transform("centers", lambda e: F.struct(squared_distance("x", e["c"]).alias("d"), e["label"].alias("label"))))["label"]
    return test.select("config_id", "resample", "sample_id", F.col("label").alias("label_true"), nearest.alias("label_pred"))
