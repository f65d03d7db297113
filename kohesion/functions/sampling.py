"""Subsamples without replacement that depend on nothing but seed and id.

A row's rank under a seed is its place by md5 of "seed:id".  Rows are put in
4096 buckets by the first hexadecimal digits; the buckets' counts settle every
bucket but the one in which the cut falls, so no task sorts more than a bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATIO = 0.618
_DIGITS = 3


def sample_key(seed: Column, sample_id: Column) -> Column:
    return F.md5(F.concat_ws(":", seed.cast("string"), sample_id.cast("string")))


def ranked(ids: DataFrame, by: list[str]) -> DataFrame:
    """``ids(*by, sample_id, key)`` with ``rn``, the place of the key within ``by``."""
    bucketed = ids.withColumn("bucket", F.substring("key", 1, _DIGITS))
    counts = bucketed.groupBy(*by, "bucket").agg(F.count("*").alias("size"))
    before = counts.withColumn("before", F.sum("size").over(Window.partitionBy(*by).orderBy("bucket")) - F.col("size")).drop("size")
    inside = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("key", "sample_id"))
    return bucketed.withColumn("inside", inside).join(before, [*by, "bucket"]).select(*by, "sample_id", (F.col("before") + F.col("inside")).alias("rn"))


def membership(features: DataFrame, n_resamples: int, ratio: float = RATIO, random_state: int = 0, second: bool = True, first_resample: int = 0) -> DataFrame:
    """(resample, split, sample_id): ``train`` of floor(ratio n) rows, ``test`` the rest, and ``stab`` a second subsample.

    Every configuration shares these subsamples.  Resample b draws train with
    seed random_state + b and stab with random_state + b + n_resamples.
    """
    ids = features.select("sample_id")
    size = ids.agg(F.floor(F.count("*") * F.lit(float(ratio))).alias("m"))
    spark = features.sparkSession
    draws = spark.range(n_resamples * (2 if second else 1)).select((F.col("id") + random_state + first_resample).cast("int").alias("seed"))
    keyed = ids.crossJoin(F.broadcast(draws)).select("seed", "sample_id", sample_key(F.col("seed"), F.col("sample_id")).alias("key"))
    placed = ranked(keyed, ["seed"]).crossJoin(F.broadcast(size))
    number = F.col("seed") - random_state - first_resample
    is_second = number >= n_resamples
    split = F.when(is_second, F.lit("stab")).when(F.col("rn") <= F.col("m"), F.lit("train")).otherwise(F.lit("test"))
    return placed.filter(~is_second | (F.col("rn") <= F.col("m"))).select((F.pmod(number, F.lit(n_resamples)) + first_resample).cast("int").alias("resample"), split.alias("split"), "sample_id")


def overlap(members: DataFrame) -> DataFrame:
    """(resample, sample_id) of the rows in both subsamples."""
    a, b = (members.filter(F.col("split") == s).select("resample", "sample_id") for s in ("train", "stab"))
    return a.join(b, ["resample", "sample_id"])


def stratified_subsample(df: DataFrame, id_col: str, stratum_col: str, ratio: float, seed: int = 0) -> DataFrame:
    """(sample_id, stratum): of every stratum the round(ratio n) rows with the smallest keys, one at least."""
    ids = df.select(F.col(id_col).cast("long").alias("sample_id"), F.col(stratum_col).alias("stratum"))
    placed = ranked(ids.withColumn("key", sample_key(F.lit(seed), F.col("sample_id"))), ["stratum"])
    sizes = ids.groupBy("stratum").agg(F.greatest(F.floor(F.count("*") * F.lit(float(ratio)) + 0.5), F.lit(1)).alias("m"))
    return placed.join(sizes, "stratum").filter("rn <= m").select("sample_id", "stratum")


def null_box(features: DataFrame, seed: int = 0) -> DataFrame:
    """As many rows, drawn uniformly from the features' bounding box."""
    from kohesion.functions.features import _as_row, column_stats

    box = _as_row(column_stats(features), "low", "high")
    cell = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("sample_id").cast("string"), i.cast("string"))), 1, 13), 16, 10).cast("double") / float(16**13)
    drawn = F.transform(F.col("__low"), lambda lo, i: lo + (F.get("__high", i) - lo) * cell(i))
    return features.select("sample_id").crossJoin(F.broadcast(box)).select("sample_id", drawn.alias("x"))


def half_up(x: float) -> int:
    return math.floor(x + 0.5)
