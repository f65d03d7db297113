"""CSV sources and sinks of benchmark reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The spellings that count as true.
TRUE_WORDS = ("true", "t", "1", "1.0", "yes", "y")

#: Columns of a runtime report before its times, whose names the caller gives.
RUNTIME_COLUMNS = "axis_name string, axis_value int, stage string, dataset_iteration int, true_k int, n int, p int, B int, n_jobs int, estimator string"
_INTEGERS = ("dataset_iteration", "true_k", "k", "n", "p")
_BOOLEANS = ("is_optimal", "is_correct")


def coerce_bool(c: Column) -> Column:
    """True for the usual spellings of true, else false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def coerce_number(c: Column, kind: str = "double") -> Column:
    """The number, or null where the text isn't one."""
    return c.cast("string").try_cast(kind)


def coerce_int(c: Column) -> Column:
    return F.round(coerce_number(c)).cast("long")


def load_results(spark: SparkSession, pattern: str) -> DataFrame:
    """All CSV files that match, with ``benchmark`` from the file's name and ``source_file``; integer and boolean columns are coerced."""
    raw = spark.read.option("header", True).csv(pattern).select("*", F.col("_metadata.file_name").alias("source_file"))
    raw = raw.withColumn("benchmark", F.regexp_replace(F.regexp_replace("source_file", r"\.csv$", ""), "^results_", ""))
    for c in raw.columns:
        if c in _INTEGERS:
            raw = raw.withColumn(c, coerce_int(F.col(c)))
        elif c in _BOOLEANS:
            raw = raw.withColumn(c, coerce_bool(F.col(c)))
        elif c.startswith(("metric_value", "metric_ari", "baseline_ari", "axis_value")):
            raw = raw.withColumn(c, coerce_number(F.col(c)))
    return raw


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def load_runtimes(spark: SparkSession, path: str, times: Sequence[str]) -> DataFrame:
    """A runtime report; ``times`` are its columns of seconds, in the file's order."""
    return load_csv(spark, path, ", ".join([RUNTIME_COLUMNS, *[f"`{t}` double" for t in times]]))


def read_block(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """(id, column, value): a matrix file in long form; numbers that can't be read are 0, of repeated ids the first stays.

    Compressed files are read as they are.
    """
    raw = spark.read.option("header", True).csv(path)
    columns = [c for c in raw.columns if c != id_col]
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(coerce_number(F.col(f"`{c}`")), F.lit(0.0)).alias("value")) for c in columns]))
    placed = raw.withColumn("__row", F.monotonically_increasing_id())
    first = placed.withColumn("__rn", F.row_number().over(Window.partitionBy(id_col).orderBy("__row"))).filter("__rn = 1")
    return first.select(F.col(id_col).alias("id"), entries.alias("e")).select("id", "e.column", "e.value")


def align_blocks(blocks: list[DataFrame]) -> DataFrame:
    """Blocks (id, column, value) side by side: every id has every column, 0 where a block lacks it."""
    long = blocks[0]
    for b in blocks[1:]:
        long = long.unionByName(b)
    ids, columns = long.select("id").distinct(), long.select("column").distinct()
    full = ids.crossJoin(F.broadcast(columns))
    return full.join(long, ["id", "column"], "left").select("id", "column", F.coalesce("value", F.lit(0.0)).alias("value"))


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Writes CSV unless it is there already, and reads what is there."""
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        df.write.option("header", True).mode("errorifexists").csv(path)
    return spark.read.schema(df.schema).option("header", True).csv(path)


def write_comparison(results: DataFrame, selections: DataFrame, path: str, name: str) -> None:
    """The metrics and the selections of a fit as ``metrics_<name>`` and ``selection_<name>`` CSV folders, for a comparison by other tools."""
    for kind, df in (("metrics", results), ("selection", selections)):
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{kind}_{name}")
