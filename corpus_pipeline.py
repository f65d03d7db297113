"""A training-data pipeline: quality, near duplicates, contamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which the
runner writes and reads again as the next stage's documents.  All but the last
return the columns of ``documents``, whatever other columns there are.

Null and empty texts fail the quality stage.  Rows with a null id pass the first
three stages by their text alone, are mixed under the id "null" and come first in
the token files.  Rows that repeat fail or pass the quality and contamination
stages together; of those that repeat an id and its text one passes the near-duplicate
stage.  An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kohesion.llm import decontaminate, mixing, quality, simhash, tokens
from kohesion.llm._store import save
from kohesion.llm.queries import END_ID, MIX_ALPHA, MIX_SEED, vocabulary


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.keep_good(docs, quality.fit_quality(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: texts of similarity 0.8 on shingles of five words."""
    return simhash.near_dedup(docs, words=5, similarity=0.8, keys=6, reach=18)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the sources' target weights, and shuffles them; a null source is a source."""
    return mixing.mix_sources(docs, alpha=MIX_ALPHA, seed=MIX_SEED).select("row.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files, which go by id again, and returns their index."""
    return tokens.token_round_trip(docs, vocabulary(), END_ID)


STAGES = [
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mix),
    ("token_output", token_files),
]

#: Stages 1, 2 and 5 can't be told in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
