"""Shared working storage.

Intermediate tables go below ``spark.checkpoint.dir``, the one folder that the
driver and all executors share, so they outlive a lost executor.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kohesion.llm import _text


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` or the context names; a fresh temporary one only where executors are threads of the driver.

    A cluster without such a folder raises: executors can't read the driver's own disk.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kohesion-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here and its size is known."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filter_batches(df: DataFrame, column: str, make_keep) -> DataFrame:
    """The rows of ``df`` that stay, whatever its columns are called; ``make_keep()`` gives a task's function from a column's Arrow values to a mask."""
    at = df.columns.index(column)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def run(batches):
        keep = make_keep()
        for batch in _text.pieces(batches):
            yield batch.filter(pa.array(keep(batch.column(at))))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
