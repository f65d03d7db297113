"""Agreement of two labellings: contingency tables, the adjusted Rand index, and its summary over resamples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """(*by, a, b, n)."""
    return pairs.groupBy(*by, a, b).agg(F.count("*").alias("n"))


def _choose2(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1.0) / 2.0


def adjusted_rand(pairs: DataFrame, by: Sequence[str], a: str, b: str, name: str = "ari") -> DataFrame:
    """(*by, name): the adjusted Rand index of columns ``a`` and ``b`` in each group.

    1 for fewer than two rows and where the index can't exceed its expectation.
    The rows are counted once; every cell then adds to itself and to its two
    margins, so all sums come from one more aggregation and without joins.
    """
    table = contingency(pairs, by, a, b)
    nothing = F.lit(None)
    parts = F.explode(
        F.array(
            F.struct(F.lit(0).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b")),
            F.struct(F.lit(1).alias("kind"), F.col(a).alias("a"), nothing.cast(table.schema[b].dataType).alias("b")),
            F.struct(F.lit(2).alias("kind"), nothing.cast(table.schema[a].dataType).alias("a"), F.col(b).alias("b")),
        )
    )
    sums = table.select(*by, "n", parts.alias("part")).groupBy(*by, "part").agg(F.sum("n").alias("n"))
    chosen = lambda kind, value: F.sum(F.when(F.col("part.kind") == kind, value))
    joined = sums.groupBy(*by).agg(
        chosen(0, _choose2(F.col("n"))).alias("cells"), chosen(1, _choose2(F.col("n"))).alias("rows"), chosen(2, _choose2(F.col("n"))).alias("cols"), chosen(0, F.col("n")).alias("total")
    )
    # NULLIF keeps the other branches' division out of ANSI mode's way.
    expected = F.col("rows") * F.col("cols") / F.nullif(_choose2(F.col("total")), F.lit(0.0))
    most = (F.col("rows") + F.col("cols")) / 2.0
    value = F.when(F.col("total") < 2, 1.0).when(most == expected, 1.0).otherwise((F.col("cells") - expected) / F.nullif(most - expected, F.lit(0.0)))
    return joined.select(*by, value.alias(name))


def summary(scores: DataFrame, by: Sequence[str], column: str, prefix: str | None = None) -> DataFrame:
    """(*by, prefix, prefix_se, prefix_upper, prefix_lower): mean, standard error, and 95 % and 5 % points of non-null scores."""
    p = prefix or column
    return scores.groupBy(*by).agg(*summary_columns(column, p))


def summary_columns(column: str, prefix: str) -> list[Column]:
    n = F.count(column).cast("double")
    return [
        F.avg(column).alias(prefix),
        F.when(n > 1, F.stddev_samp(column) / F.sqrt(n)).alias(f"{prefix}_se"),
        F.percentile(column, F.lit(0.95)).alias(f"{prefix}_upper"),
        F.percentile(column, F.lit(0.05)).alias(f"{prefix}_lower"),
    ]


def stability_ari(runs: DataFrame) -> DataFrame:
    """(config_id, resample, ari_stability): agreement of the two subsamples' clusterings on the rows that both hold."""
    key = ["config_id", "resample", "sample_id"]
    a = runs.filter("split = 'train'").select(*key, F.col("label").alias("a"))
    b = runs.filter("split = 'stab'").select(*key, F.col("label").alias("b"))
    return adjusted_rand(a.join(b, key), ["config_id", "resample"], "a", "b", "ari_stability")


def generalizability_ari(pred_runs: DataFrame) -> DataFrame:
    """(config_id, resample, ari_generalizability): held-out clusterings against predicted labels."""
    return adjusted_rand(pred_runs, ["config_id", "resample"], "label_true", "label_pred", "ari_generalizability")


def resample_scores(stability: DataFrame | None, generalizability: DataFrame | None) -> DataFrame:
    """(config_id, resample, ari_stability, ari_generalizability, ari_average); a branch that wasn't run is null."""
    key, none = ["config_id", "resample"], F.lit(None).cast("double")
    if stability is None:
        joined = generalizability.withColumn("ari_stability", none)
    elif generalizability is None:
        joined = stability.withColumn("ari_generalizability", none)
    else:
        joined = stability.join(generalizability, key, "full")
    return joined.select(*key, "ari_stability", "ari_generalizability", ((F.col("ari_stability") + F.col("ari_generalizability")) / 2.0).alias("ari_average"))


def label_count_warnings(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_id, resample, split, n_labels, n_clusters) of the runs that found another number of clusters than asked for."""
    found = runs.groupBy("config_id", "resample", "split").agg(F.count_distinct("label").alias("n_labels"))
    return found.join(F.broadcast(configs.select("config_id", "n_clusters")), "config_id").filter("n_labels <> n_clusters")
