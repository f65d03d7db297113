"""Classical validity indices of a labelled feature table (sample_id, x, label)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohesion.functions.features import squared_distance
from kohesion.sources.state import settle


def centroids(labelled: DataFrame) -> DataFrame:
    """(label, n, c)."""
    means = labelled.select("label", F.posexplode("x").alias("dim", "v")).groupBy("label", "dim").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return means.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda e: e["v"]).alias("c"))


def dispersion_by_label(labelled: DataFrame) -> DataFrame:
    """(label, n, within): the sum of squared distances to the centroid, dimension by dimension in one pass."""
    per = labelled.select("label", F.posexplode("x").alias("dim", "v")).groupBy("label", "dim").agg(F.count("v").alias("n"), F.var_pop("v").alias("var"))
    return per.groupBy("label").agg(F.max("n").alias("n"), F.sum(F.col("n") * F.col("var")).alias("within"))


def dispersion(labelled: DataFrame) -> DataFrame:
    return dispersion_by_label(labelled).agg(F.sum("within").alias("dispersion"))


def calinski_harabasz(labelled: DataFrame) -> DataFrame:
    """(calinski_harabasz): between over within dispersion, each by its degrees of freedom; null for one cluster, 1 without any within."""
    own = dispersion_by_label(labelled).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("within").alias("w"))
    total = labelled.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg((F.count("v") * F.var_pop("v")).alias("t")).agg(F.sum("t").alias("t"))
    k, n = F.col("k"), F.col("n")
    value = F.when((k < 2) | (k >= n), F.lit(None).cast("double")).when(F.col("w") == 0, F.lit(1.0)).otherwise((F.col("t") - F.col("w")) / F.nullif(F.col("w"), F.lit(0.0)) * (n - k) / F.nullif(k - 1, F.lit(0)))
    return own.crossJoin(F.broadcast(total)).select(value.alias("calinski_harabasz"))


def davies_bouldin_inverted(labelled: DataFrame) -> DataFrame:
    """(davies_bouldin_inverted): 1 / (1 + DB); null where DB isn't finite."""
    centers = centroids(labelled)
    spread = labelled.join(F.broadcast(centers), "label").groupBy("label").agg(F.avg(F.sqrt(squared_distance("x", "c"))).alias("s"))
    # One row per cluster; the pairs of clusters are few.
    side = centers.join(spread, "label").select("label", "c", "s")
    pairs = side.alias("a").join(side.alias("b"), F.col("a.label") != F.col("b.label"))
    gap = F.sqrt(squared_distance("a.c", "b.c"))
    ratio = pairs.select(F.col("a.label").alias("label"), F.when(gap > 0, (F.col("a.s") + F.col("b.s")) / F.nullif(gap, F.lit(0.0))).otherwise(F.lit(float("inf"))).alias("r"))
    db = ratio.groupBy("label").agg(F.max("r").alias("r")).agg(F.avg("r").alias("db"))
    return db.select(F.when(F.col("db") < float("inf"), 1.0 / (1.0 + F.col("db"))).alias("davies_bouldin_inverted"))


#: Rows of a block: a row travels once for each block on each side.
BLOCK = 16384
#: Rows of a tile, which is what matrix products inside a pair of blocks hold at once.
TILE = 512


def block_pairs(rows: DataFrame, compare: Callable, schema: str, block: int = BLOCK, key: str = "sample_id") -> DataFrame:
    """``compare(left, right)`` on every ordered pair of row blocks, as tables; memory is bounded by two blocks.

    Blocks are smaller where a cluster would have fewer pairs of them than cores.
    """
    size = rows.count()
    few = math.isqrt(max(1, rows.sparkSession.sparkContext.defaultParallelism))
    n = max(1, -(-size // block), min(few, -(-size // 1024)))
    own = rows.withColumn("__home", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn("__other", F.explode(F.array(*[F.lit(i) for i in range(n)])))
    left = own.select(F.col("__home").alias("r"), F.col("__other").alias("c"), *rows.columns)
    # The two sides come from one table, so the right one's columns get names of their own on the way.
    right = own.select(F.col("__other").alias("r"), F.col("__home").alias("c"), *[F.col(c).alias(f"{c}__right") for c in rows.columns])
    names = list(rows.columns)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return compare(a.select(names), b.select([f"{c}__right" for c in names]).rename_columns(names))

    return left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(run, schema)


def matrix(table: pa.Table, column: str = "x") -> np.ndarray:
    return np.asarray(table.column(column).combine_chunks().flatten(), float).reshape(table.num_rows, -1)


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances from differences, so that equal rows are at exactly zero."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def _fast_distances(a: np.ndarray, b: np.ndarray, b_norm: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product; off by rounding of the norms' size."""
    out = a @ b.T
    out *= -2
    out += (a * a).sum(1)[:, None]
    out += b_norm
    return out


def _rounding(a: np.ndarray, b_norm: np.ndarray) -> float:
    """What ``_fast_distances`` may be off by at most, with room."""
    return 1e-13 * a.shape[1] * float((a * a).sum(1).max(initial=0) + b_norm.max(initial=0)) + 1e-300


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of row i of ``a`` and row i of ``b``, summed as ``exact_distances`` does."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += (a[:, j] - b[:, j]) ** 2
    return out


def nearest_rows(a: np.ndarray, b: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``b``, squared distances), k a row: by distance from differences, then place; ``own`` are places that come first, -1 for none.

    A matrix product finds the rows that may be among the k; only those are compared exactly.
    """
    k = min(k, len(b))
    b_norm, off = (b * b).sum(1), 0.0
    place, d2 = np.empty((len(a), k), np.int64), np.empty((len(a), k))
    off = 2 * _rounding(a, b_norm) + 2 * _rounding(b, b_norm)
    for start in range(0, len(a), TILE):
        part = a[start : start + TILE]
        mine = np.full(len(part), -1) if own is None else own[start : start + TILE]
        has = np.flatnonzero(mine >= 0)
        limit = np.full(len(part), np.inf)
        least = np.zeros((len(part), 0))
        tiles = []
        for left in range(0, len(b), 8 * TILE):
            fast = _fast_distances(part, b[left : left + 8 * TILE], b_norm[left : left + 8 * TILE])
            here = has[(mine[has] >= left) & (mine[has] < left + 8 * TILE)]
            fast[here, mine[here] - left] = -np.inf
            if fast.shape[1] > k:
                # The k-th least bound so far only falls, so what is over it now is over it at the end.
                i, j = np.nonzero(fast <= limit[:, None] + off) if least.shape[1] == k else (None, None)
                if i is None or len(i) > 64 * len(part):
                    low = np.partition(fast, k - 1, axis=1)[:, :k]
                    least = np.partition(np.concatenate([least, low], 1), k - 1, axis=1)[:, :k]
                    limit = least[:, k - 1] if least.shape[1] == k else limit
                    i, j = np.nonzero(fast <= limit[:, None] + off)
                else:
                    least, limit = _lower(least, i, fast[i, j], k)
            else:
                i, j = np.nonzero(np.ones(fast.shape, bool))
                least = np.concatenate([least, fast], 1)
                if least.shape[1] > k:
                    least = np.partition(least, k - 1, axis=1)[:, :k]
                limit = least.max(1) if least.shape[1] == k else limit
            tiles.append((i, j + left, fast[i, j]))
        i, j, fast = (np.concatenate(v) for v in zip(*tiles, strict=True))
        kept = fast <= limit[i] + off
        i, j = i[kept], j[kept]
        exact = np.empty(len(i))
        for low in range(0, len(i), 1 << 16):
            exact[low : low + (1 << 16)] = pair_distances(part[i[low : low + (1 << 16)]], b[j[low : low + (1 << 16)]])
        order = np.lexsort((j, np.where(mine[i] == j, -1.0, exact), i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, np.arange(len(part)))
        take = first[:, None] + np.arange(k)
        place[start : start + TILE], d2[start : start + TILE] = j[take], exact[take]
    return place, d2


def _lower(least: np.ndarray, i: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least of every row after some rows ``i`` (ascending) got more ``values``."""
    if len(i):
        rows, first, count = np.unique(i, return_index=True, return_counts=True)
        more = np.full((len(rows), count.max()), np.inf)
        more[np.repeat(np.arange(len(rows)), count), np.arange(len(i)) - np.repeat(first, count)] = values
        least[rows] = np.partition(np.concatenate([least[rows], more], 1), k - 1, axis=1)[:, :k]
    return least, least.max(1)


def distance_sums(a: np.ndarray, b: np.ndarray, one_hot: np.ndarray) -> np.ndarray:
    """Euclidean distances of ``a``'s rows to ``b``'s, times ``one_hot``: their sums for each class.

    Distances too small for a matrix product's rounding are taken from differences.
    """
    b_norm = (b * b).sum(1)
    near = 1e-6 * (float((a * a).sum(1).max(initial=0)) + float(b_norm.max(initial=0)))
    out = np.zeros((len(a), one_hot.shape[1]))
    for start in range(0, len(a), TILE):
        part = a[start : start + TILE]
        for left in range(0, len(b), 4 * TILE):
            other = b[left : left + 4 * TILE]
            d2 = _fast_distances(part, other, b_norm[left : left + 4 * TILE])
            i, j = np.nonzero(d2 < near)
            for low in range(0, len(i), 1 << 16):
                s = slice(low, low + (1 << 16))
                d2[i[s], j[s]] = pair_distances(part[i[s]], other[j[s]])
            np.sqrt(d2, out=d2)
            out[start : start + TILE] += d2 @ one_hot[left : left + 4 * TILE]
    return out


def silhouette_samples(labelled: DataFrame, block: int = BLOCK) -> DataFrame:
    """(sample_id, label, silhouette) with Euclidean distances; 0 for a cluster of one."""

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        label = b.column("label").to_numpy()
        values, code = np.unique(label, return_inverse=True)
        total = distance_sums(matrix(a), matrix(b), np.eye(len(values))[code])
        n = a.num_rows
        return pa.table(
            {
                "sample_id": pa.array(np.repeat(a.column("sample_id").to_numpy(), len(values))),
                "label": pa.array(np.repeat(a.column("label").to_numpy(), len(values)).astype(np.int32)),
                "other": pa.array(np.tile(values, n).astype(np.int32)),
                "total": pa.array(total.ravel()),
            }
        )

    rows = labelled.select("sample_id", F.col("label").cast("int").alias("label"), "x")
    parts = block_pairs(rows, sums, "sample_id long, label int, other int, total double", block)
    sizes = rows.groupBy(F.col("label").alias("other")).agg(F.count("*").alias("n"))
    mean = parts.groupBy("sample_id", "label", "other").agg(F.sum("total").alias("total")).join(F.broadcast(sizes), "other")
    own = F.max(F.when((F.col("other") == F.col("label")) & (F.col("n") > 1), F.col("total") / F.nullif(F.col("n") - 1, F.lit(0))))
    near = F.min(F.when(F.col("other") != F.col("label"), F.col("total") / F.col("n")))
    ab = mean.groupBy("sample_id", "label").agg(own.alias("a"), near.alias("b"))
    most = F.greatest("a", "b")
    return ab.select("sample_id", "label", F.when(F.col("a").isNull() | (most == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(most, F.lit(0.0))).alias("silhouette"))


def silhouette(labelled: DataFrame, block: int = BLOCK) -> DataFrame:
    return silhouette_samples(labelled, block).agg(F.avg("silhouette").alias("silhouette"))


def gap_statistic(features: DataFrame, cluster: Callable[[DataFrame, int], DataFrame], k: int, n_null: int = 10, seed: int = 0) -> float | None:
    """mean ln W of ``n_null`` uniform tables minus ln W of the data; null where a W isn't positive.

    ``cluster(features, seed)`` returns (sample_id, label), and x if it has it at hand, which saves drawing a table again to join it.
    """
    from kohesion.functions.sampling import null_box

    def log_w(x: DataFrame, s: int) -> float | None:
        found = cluster(x, s)
        w = dispersion(found if "x" in found.columns else x.join(found, "sample_id")).first()["dispersion"]
        return float(np.log(w)) if w and w > 0 else None

    own = log_w(features, seed)
    null = [log_w(null_box(features, seed + b), seed + b) for b in range(n_null)]
    return None if own is None or None in null else float(np.mean(null)) - own


def knn(features: DataFrame, k: int = 7, block: int = BLOCK) -> DataFrame:
    """(i, j, rank, d2): the k nearest rows of each row, itself first; ties go to the smaller id."""

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        i, b = a.column("sample_id").to_numpy(), b.sort_by("sample_id")
        j = b.column("sample_id").to_numpy()
        at = np.minimum(np.searchsorted(j, i), len(j) - 1)
        take, d = nearest_rows(matrix(a), matrix(b), k, np.where(j[at] == i, at, -1))
        return pa.table({"i": pa.array(np.repeat(i, take.shape[1])), "j": pa.array(j[take].ravel()), "d2": pa.array(d.ravel())})

    parts = block_pairs(features.select("sample_id", "x"), nearest, "i long, j long, d2 double", block)
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.col("i") != F.col("j"), "d2", "j"))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= k)


def knn_sigma(neighbours: DataFrame, k: int = 7) -> DataFrame:
    """(sigma): the median distance to the k-th neighbour; the mean of the positive ones if that is zero, 1 without any."""
    kth = neighbours.filter(F.col("rank") == k).select(F.sqrt("d2").alias("d"))
    middle, positive = F.percentile("d", F.lit(0.5)), F.avg(F.when(F.col("d") > 0, F.col("d")))
    return kth.agg(F.when(middle > 0, middle).otherwise(F.coalesce(positive, F.lit(1.0))).alias("sigma"))


# The multiples of sigma that the gamma grid tries.
SIGMA_MULTIPLES = (0.5, 1.0, 2.0)


def gamma_grid(neighbours: DataFrame, k: int = 7) -> DataFrame:
    """(multiple, gamma): 1 / (2 (m sigma)^2)."""
    rows = F.explode(F.array(*[F.lit(m) for m in SIGMA_MULTIPLES])).alias("multiple")
    return knn_sigma(neighbours, k).select("sigma", rows).select("multiple", (1.0 / (2.0 * F.pow(F.col("multiple") * F.col("sigma"), F.lit(2.0)))).alias("gamma"))


def affinity_knn(neighbours: DataFrame) -> DataFrame:
    """(i, j, w): half a unit for each direction in which j is a neighbour of i; no self edges."""
    own = neighbours.filter("i <> j").select("i", "j")
    return own.union(own.select("j", "i")).groupBy("i", "j").agg((F.count("*") / 2.0).alias("w"))


def local_sigma(neighbours: DataFrame, k: int = 7) -> DataFrame:
    """(i, s): each row's distance to its k-th neighbour, or the median of the positive ones where that is zero."""
    kth = neighbours.filter(F.col("rank") == k).select("i", F.sqrt("d2").alias("s"))
    middle = kth.filter("s > 0").agg(F.coalesce(F.percentile("s", F.lit(0.5)), F.lit(1.0)).alias("m"))
    return kth.crossJoin(F.broadcast(middle)).select("i", F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("m")).alias("s"))


def affinity_self_tuning(neighbours: DataFrame, k: int = 7) -> DataFrame:
    """(i, j, w) on neighbour edges: exp(-d^2 / (s_i s_j)), made symmetric by the larger weight."""
    # Read four times, searched once.
    neighbours = settle(neighbours)
    sigma = local_sigma(neighbours, k)
    edges = neighbours.filter("i <> j").join(sigma, "i").join(sigma.select(F.col("i").alias("j"), F.col("s").alias("t")), "j")
    w = edges.select("i", "j", F.exp(-F.col("d2") / (F.col("s") * F.col("t"))).alias("w"))
    return w.union(w.select("j", "i", "w")).groupBy("i", "j").agg(F.max("w").alias("w"))


def affinity_rbf(neighbours: DataFrame, k: int = 7) -> DataFrame:
    """(i, j, w) on neighbour edges: exp(-gamma d^2) with the gamma of the median neighbour distance."""
    neighbours = settle(neighbours)
    gamma = knn_sigma(neighbours, k).select((1.0 / (2.0 * F.col("sigma") * F.col("sigma"))).alias("g"))
    return neighbours.filter("i <> j").crossJoin(F.broadcast(gamma)).select("i", "j", F.exp(-F.col("g") * F.col("d2")).alias("w"))


def graph_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.sum("w").alias("degree"), F.count("*").alias("n_edges"))
