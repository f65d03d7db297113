"""Per-sample generalizability: how often a held-out sample is predicted into its own cluster."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohesion.operators.kernels import best_assignment


def label_mapping(pred_runs: DataFrame) -> DataFrame:
    """(config_id, resample, label_pred, label_aligned): the matching of predicted to true clusters with the largest overlap.

    Only the small contingency tables reach Python.  A predicted cluster
    without a partner keeps its own label.
    """
    table = pred_runs.groupBy("config_id", "resample", "label_true", "label_pred").agg(F.count("*").alias("n"))

    def match(rows: pa.Table) -> pa.Table:
        true, pred, n = (rows.column(c).to_pylist() for c in ("label_true", "label_pred", "n"))
        pairs = best_assignment(dict(zip(zip(true, pred, strict=True), n, strict=True)))
        labels = sorted(set(pred))
        return pa.table(
            {
                "config_id": pa.array([rows.column("config_id")[0].as_py()] * len(labels), pa.int32()),
                "resample": pa.array([rows.column("resample")[0].as_py()] * len(labels), pa.int32()),
                "label_pred": pa.array(labels, pa.int32()),
                "label_aligned": pa.array([pairs.get(x, x) for x in labels], pa.int32()),
            }
        )

    return table.groupBy("config_id", "resample").applyInArrow(match, "config_id int, resample int, label_pred int, label_aligned int")


def sample_accuracy(pred_runs: DataFrame, samples: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """(config_id, sample_id, n_evaluated, accuracy) for every sample and configuration; 0 for one never held out."""
    mapping = label_mapping(pred_runs) if mapping is None else mapping
    aligned = pred_runs.join(mapping, ["config_id", "resample", "label_pred"])
    right = F.sum((F.col("label_aligned") == F.col("label_true")).cast("long"))
    scored = aligned.groupBy("config_id", "sample_id").agg(F.count("*").alias("n"), right.alias("right"))
    every = samples.select("sample_id").crossJoin(F.broadcast(pred_runs.select("config_id").distinct()))
    joined = every.join(scored, ["config_id", "sample_id"], "left")
    return joined.select("config_id", "sample_id", F.coalesce("n", F.lit(0)).alias("n_evaluated"), F.coalesce(F.col("right") / F.col("n"), F.lit(0.0)).alias("accuracy"))


def config_accuracy(samples: DataFrame) -> DataFrame:
    return samples.groupBy("config_id").agg(F.avg("accuracy").alias("accuracy_generalizability"))
