"""Final labels from a configuration's consensus, and label tables on other tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohesion.functions.consensus import class_consensus, consensus_classes, consensus_matrix, dense_matrix
from kohesion.functions.ranking import numbered
from kohesion.operators.kernels import align_labels, cut_merges, leaf_order, linkage_merges
from kohesion.sources.state import settle

#: Samples up to which a consensus matrix, which has a number for each pair, is held at once; linkages need it whole.
MOST_SAMPLES = 20_000


def consensus_distance(consensus: DataFrame, ids: np.ndarray) -> np.ndarray:
    """One minus the consensus, of runs (resample, sample_id, label) or of pairs (i, j, p); 0.5 where two were never drawn together."""
    if len(ids) > MOST_SAMPLES:
        raise ValueError(f"a consensus matrix of {len(ids)} samples is too large; the limit is {MOST_SAMPLES}")
    return 1.0 - (consensus_matrix if "resample" in consensus.columns else dense_matrix)(consensus, ids)


def consensus_labels(consensus: DataFrame, ids: np.ndarray, k: int, reference: np.ndarray | None = None, clusterer: Callable | None = None) -> np.ndarray:
    """Average-linkage labels of the consensus distance, or a given clusterer's; renamed after ``reference`` if it has as many classes."""
    d = consensus_distance(consensus, ids)
    labels = np.asarray(clusterer(d)) if clusterer else cut_merges(linkage_merges(d, "average"), len(ids), k)
    if reference is not None and len(np.unique(reference)) == len(np.unique(labels)):
        labels = align_labels(np.asarray(reference), labels)
    return labels.astype(np.int32)


def consensus_label_table(runs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(sample_id, label): average-linkage labels of one configuration's consensus, for every row of ``ids(sample_id)``.

    Samples with equal draws are at distance 0 and merge first, so the linkage starts from
    classes with their sizes; only these come to the driver. Ties of heights go by the classes'
    smallest ids. Samples that no run drew are at 0.5 from all: k - 1 stand alone, the rest is one class.
    """
    spark = runs.sparkSession
    own, classes = consensus_classes(runs)
    unseen = settle(ids.join(own, "sample_id", "left_anti").select("sample_id"))
    alone = [r["sample_id"] for r in unseen.orderBy("sample_id").limit(k).collect()]
    rest = unseen.count() - max(0, k - 1)
    table = classes.orderBy("sample_id").toArrow()
    members = [(int(i), int(n)) for i, n in zip(table.column("sample_id").to_pylist(), table.column("size").to_pylist(), strict=True)]
    n, names = len(members), [i for i, _ in members] + alone
    if len(names) > MOST_SAMPLES:
        raise ValueError(f"a consensus matrix of {len(names)} classes of samples is too large; the limit is {MOST_SAMPLES}")
    if len(names) < k:
        raise ValueError(f"{len(names)} classes of samples can't make {k} clusters")
    size = np.array([c for _, c in members] + [1] * (len(alone) - (rest > 0)) + [rest] * (rest > 0), float)
    d = np.full((len(names), len(names)), 0.5)
    d[:n, :n] = 1.0 - class_consensus(table)
    np.fill_diagonal(d, 0.0)
    order = np.argsort(names, kind="stable")
    found = np.empty(len(names), np.int64)
    found[order] = cut_merges(linkage_merges(d[np.ix_(order, order)], "average", size[order]), len(names), k)
    named = spark.createDataFrame([(i, int(v)) for (i, _), v in zip(members, found, strict=False)], "rep long, label int")
    reps = classes.select("draws", F.col("sample_id").alias("rep")).join(F.broadcast(named), "rep").select("draws", "label")
    drawn = own.join(reps, "draws").select("sample_id", "label")
    if not alone:
        return drawn
    few = spark.createDataFrame([(i, int(v)) for i, v in zip(alone, found[n:], strict=True)], "sample_id long, few int")
    others = unseen.join(F.broadcast(few), "sample_id", "left").select("sample_id", F.coalesce("few", F.lit(int(found[-1]))).alias("label"))
    return drawn.union(others)


def consensus_leaf_order(consensus: DataFrame, ids: np.ndarray) -> list[int]:
    """The sample ids in dendrogram order."""
    return [int(ids[i]) for i in leaf_order(consensus_distance(consensus, ids))]


def attach_labels(df: DataFrame, labels: DataFrame, id_col: str, name: str = "cluster") -> DataFrame:
    """``df`` with a label column; every row needs a label and every label a row."""
    out = df.join(labels.select(F.col("sample_id").alias(id_col), F.col("label").alias(name)), id_col)
    if not df.count() == labels.count() == out.count():
        raise ValueError("labels and rows don't match")
    return out


def factorize(df: DataFrame, value: str, position: str, by_value: bool = False) -> DataFrame:
    """``df`` with ``code``: values numbered from 0 by first appearance, or in sorted order."""
    order = ["v"] if by_value else ["p", "v"]
    codes = numbered(df.groupBy(F.col(value).alias("v")).agg(F.min(position).alias("p")), order, "code", first=0)
    return df.join(codes.select(F.col("v").alias(value), "code"), value)
