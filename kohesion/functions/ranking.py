"""Row numbers over a whole table, without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohesion.sources.state import settle


def numbered(df: DataFrame, order: list[Column | str], name: str, first: int = 1) -> DataFrame:
    """``df`` with ``name``, the rows' numbers from ``first`` in a total order: ranges of rows, and places inside a range."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = settle(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))
    # One row per range.
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    placed = dealt.withColumn("__inside", inside).join(F.broadcast(before), "__range")
    return placed.withColumn(name, (F.col("__before") + F.col("__inside") + (first - 1)).cast("int")).drop("__range", "__inside", "__before")
