"""Embedding near-duplicates through an inverted multi-index.

Unit vectors are cut into two halves with a codebook each; a vector's cell is
its pair of nearest codewords, so two codebooks of K words make a grid of K*K
cells.  A vector visits cells in the order of the multi-sequence algorithm, by
the sum of its halves' squared distances to the cell's codewords.  How many
cells it visits is set on the sample that the codebooks are fitted on: enough
that pairs at the threshold angle, and the sample's own near pairs, meet with
the target recall.  Every vector is indexed and every pair that meets is
verified in double precision.

Equal vectors are one point with a count.  Residents and visitors of a large
cell are dealt to blocks of bounded size, every block of one side against every
block of the other.  A block reports counts and a spanning forest of its links,
never its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohesion.llm._components import connected_components
from kohesion.llm._store import parallelism, save
from kohesion.llm.bktree import merge

#: Vectors that the index is fitted on, at most about this many.
SAMPLE = 8000
#: Points that a cell should hold on average, over all labels.
CELL_POINTS = 128
MOST_WORDS = 1024
#: Rows of one side that a block compares at once.
RESIDENTS, VISITORS = 2048, 4096


@dataclass
class MultiIndex:
    """Codebooks of the two halves, and the number of cells that a vector visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def _distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        halves = (unit[:, :cut], self.first), (unit[:, cut:], self.second)
        return tuple((x * x).sum(1)[:, None] - 2 * x @ w.T + (w * w).sum(1)[None] for x, w in halves)

    def traverse(self, unit: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The cells that each vector visits, nearest first; the first is its own.

        After sorting each half's codewords by distance, the cell at ranks
        (i, j) comes after all (i+1)(j+1) - 1 cells at smaller ranks, so the
        first T cells lie among those with (i+1)(j+1) <= T.
        """
        t = min(visits or self.visits, len(self.first) * len(self.second))
        d1, d2 = self._distances(unit)
        o1, o2 = np.argsort(d1, axis=1, kind="stable")[:, :t], np.argsort(d2, axis=1, kind="stable")[:, :t]
        i, j = np.array([(a, b) for a in range(o1.shape[1]) for b in range(min(o2.shape[1], t // (a + 1)))]).T
        total = np.take_along_axis(d1, o1, 1)[:, i] + np.take_along_axis(d2, o2, 1)[:, j]
        order = np.argsort(total, axis=1, kind="stable")[:, :t]
        cells = o1[:, i].astype(np.int64) * len(self.second) + o2[:, j]
        return np.take_along_axis(cells, order, 1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((words * words).sum(1)[None] - 2 * x @ words.T, axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words[count > 0] = total[count > 0] / count[count > 0, None]
    return words


def fit_index(sample: np.ndarray, label: np.ndarray, points: int, threshold: float, recall: float, seed: int = 11) -> MultiIndex:
    """Codebooks from unit vectors, and visits for the target recall on pairs at the threshold and on the sample's own."""
    rng = np.random.default_rng(seed)
    cut = max(1, sample.shape[1] // 2)
    k = int(np.clip(np.ceil(np.sqrt(points / CELL_POINTS)), 2, MOST_WORDS))
    index = MultiIndex(kmeans(sample[:, :cut], k, rng), kmeans(sample[:, cut:], k, rng), 1)
    a = sample[rng.choice(len(sample), min(1500, len(sample)), replace=False)]
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    length = np.linalg.norm(noise, axis=1, keepdims=True)
    near = threshold * a + np.sqrt(1 - threshold**2) * noise / np.where(length > 0, length, 1)
    tests = [(a, near)]
    own = []
    for value in np.unique(label):
        rows = np.flatnonzero(label == value)[:1500]
        x, y = np.nonzero(np.triu(sample[rows] @ sample[rows].T >= threshold, 1))
        own.append((rows[x][:500], rows[y][:500]))
    if sum(len(x) for x, _ in own):
        tests.append(tuple(sample[np.concatenate(side)] for side in zip(*own, strict=True)))
    most = len(index.first) * len(index.second)
    visits = 1
    while visits < most and any(_meet(index, x, y, visits) < recall for x, y in tests):
        visits = min(most, visits * 2 if visits < 8 else visits + visits // 4)
    index.visits = visits
    return index


def _meet(index: MultiIndex, x: np.ndarray, y: np.ndarray, visits: int) -> float:
    """The share of pairs of which one vector visits the other's cell."""
    cx, cy = index.traverse(x, visits), index.traverse(y, visits)
    return float(((cx == cy[:, :1]).any(1) | (cy == cx[:, :1]).any(1)).mean())


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, as squares of very small or large components leave the range of doubles.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare_block(rows: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """Links between the residents and the visitors of one block: (a, null, count) and forest links (a, b, null)."""
    visitor = rows.column("visitor").to_numpy(zero_copy_only=False)
    rep, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
    unit = _unit(_matrix(rows.column("embedding").combine_chunks()))
    seen = np.asarray(rows.column("visits").combine_chunks().flatten()).reshape(len(rep), -1)
    label = rows.column("l").to_numpy()
    res, vis = np.flatnonzero(~visitor), np.flatnonzero(visitor)
    if not len(res) or not len(vis):
        return None
    nodes, place = np.unique(rep, return_inverse=True)
    count, forest = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    for start in range(0, len(vis), 256):
        part = vis[start : start + 256]
        v, r = np.nonzero(unit[part] @ unit[res].T >= threshold)
        v, r = part[v], res[r]
        other = (rep[v] != rep[r]) & (label[v] == label[r])
        v, r = v[other], r[other]
        np.add.at(count, place[v], copies[r])
        # A resident that doesn't visit its visitor's cell learns of the link here only.
        back = ~(seen[r] == seen[v, :1]).any(1)
        np.add.at(count, place[r[back]], copies[v[back]])
        merge(forest, place[v], place[r])
    some, moved = np.flatnonzero(count), np.flatnonzero(forest != np.arange(len(nodes)))
    a = np.concatenate([nodes[some], nodes[moved]])
    if not len(a):
        return None
    b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(nodes[forest[moved]], pa.int64())])
    n = pa.concat_arrays([pa.array(count[some], pa.int64()), pa.nulls(len(moved), pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, n], ["a", "b", "n"])


def _blocks(batches, threshold: float):
    """Runs :func:`compare_block` on each run of rows with one block key; rows come sorted by it."""
    held: list[pa.RecordBatch] = []

    def close():
        return compare_block(pa.Table.from_batches(held), threshold) if held else None

    for batch in batches:
        keys = np.asarray(batch.column(batch.schema.get_field_index("block")))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == z:
                continue
            if held and held[-1].column(held[-1].schema.get_field_index("block"))[-1].as_py() != int(keys[a]):
                out = close()
                held = []
                if out is not None:
                    yield out
            held.append(batch.slice(a, z - a))
    out = close()
    if out is not None:
        yield out


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    recall: float = 0.99,
    sample: int = SAMPLE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component) per row of ``vectors``; links join equal, non-null labels at cosine >= ``threshold``.

    ``n_links`` counts the other rows that were found linked directly;
    ``component`` is the smallest id that links reach, itself included.  Null
    or zero vectors, vectors with null or non-finite components and rows with a
    null label or id have no links; vectors of different lengths have none with
    each other.  Equal rows link.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    # Single-precision components travel as such; they are widened where cosines are taken.
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast(kind).alias("embedding"), F.col(f"`{label_col}`").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = own.filter(usable)
    points = save(valid.groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vector-points")
    sizes = {r["d"]: r["count"] for r in points.groupBy(F.size("embedding").alias("d")).count().collect()}
    links = None
    for d, n in sorted(sizes.items()):
        found = _links(points.filter(F.size("embedding") == d), n, threshold, recall, sample)
        links = found if links is None else links.union(found)
    if links is None:
        return own.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    links = save(links, "vector-links")
    counts = links.filter("n is not null").groupBy(F.col("a").alias("counted")).agg(F.sum("n").alias("n"))
    classes = connected_components(links.filter("b is not null").select("a", "b"), "vector-classes")
    # An id on several points joins them.
    of_point = points.join(counts, F.col("rep") == F.col("counted"), "left").join(classes, F.col("rep") == F.col("node"), "left")
    of_point = save(
        of_point.select(
            F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
        ),
        "vector-results",
    )
    linked = valid.join(of_point, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("id", "n_links", "component")
    alone = own.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone)


def _links(points: DataFrame, n: int, threshold: float, recall: float, sample: int) -> DataFrame:
    """(a, b, n) rows of all blocks for points of one length."""
    spark = points.sparkSession
    grain = 1 << 30
    taken = points.filter(F.pmod(F.xxhash64("rep"), F.lit(grain)) < int(min(1.0, sample / n) * grain) + 1).select("rep", "embedding", F.xxhash64("label").alias("l")).orderBy("rep").collect()
    if not taken:
        taken = points.select("rep", "embedding", F.xxhash64("label").alias("l")).orderBy("rep").limit(1).collect()
    fitted = fit_index(_unit(np.array([r["embedding"] for r in taken], float)), np.array([r["l"] for r in taken]), n, threshold, recall)
    sent = spark.sparkContext.broadcast(fitted)

    def assign(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                cells = sent.value.traverse(_unit(_matrix(part.column(2))))
                lists = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32), pa.array(cells.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["rep", "copies", "embedding", "l", "visits"])

    cells = points.select("rep", "copies", "embedding", F.xxhash64("label").alias("l")).mapInArrow(assign, f"rep long, copies long, embedding {dict(points.dtypes)['embedding']}, l long, visits array<int>")
    cells = save(cells, "vector-cells")
    visitors = cells.select("l", F.explode("visits").alias("cell"), "rep").groupBy("l", "cell").agg(F.count("*").alias("v"))
    residents = cells.groupBy("l", F.element_at("visits", 1).alias("cell")).agg(F.count("*").alias("r"))
    # One row per cell that has residents; visits elsewhere end here.
    grid = save(residents.join(visitors, ["l", "cell"]).select(F.col("l").alias("gl"), F.col("cell").alias("gc"), F.ceil(F.col("r") / RESIDENTS).alias("nr"), F.ceil(F.col("v") / VISITORS).alias("nv")), "vector-grid")
    body = ["rep", "copies", "embedding", "visits"]
    home = cells.select("l", F.element_at("visits", 1).alias("cell"), F.lit(False).alias("visitor"), *body)
    away = cells.select("l", F.explode("visits").alias("cell"), F.lit(True).alias("visitor"), *body)
    dealt = home.union(away).join(grid, (F.col("l") == F.col("gl")) & (F.col("cell") == F.col("gc")))
    place = F.pmod(F.xxhash64("rep"), F.when(F.col("visitor"), F.col("nv")).otherwise(F.col("nr")))
    across = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("visitor"), F.col("nr")).otherwise(F.col("nv")) - 1))
    rows = dealt.withColumn("own", place).withColumn("across", across)
    r, v = F.when(F.col("visitor"), F.col("across")).otherwise(F.col("own")), F.when(F.col("visitor"), F.col("own")).otherwise(F.col("across"))
    # Should two cells share a key, their pairs are verified like any other.
    rows = rows.select(F.xxhash64("l", "cell", r, v).alias("block"), "visitor", "l", *body)
    sorted_rows = rows.repartition(parallelism(spark), "block").sortWithinPartitions("block")
    return sorted_rows.mapInArrow(lambda batches: _blocks(batches, threshold), "a long, b long, n long")
