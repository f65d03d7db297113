"""Synthetic clustered data.

Centres, sizes, covariances and the lift of two-dimensional shapes are small
and are planned on the driver; the rows are drawn on the executors, each task
from a generator seeded by the seed and its block, so the table is the same
under any partitioning.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohesion.functions.features import _as_row, column_stats, fourier_embed, poly_embed, rbf_embed
from kohesion.functions.sampling import half_up

BLOCK = 10_000

# ---------------------------------------------------------------- sizes and scales


def cluster_sizes(n: int, k: int, fractions: Sequence[float] | None = None, balanced: bool = True, concentration: float = 1.0, min_abs: int = 1, min_frac: float = 0.0, rng: np.random.Generator | None = None) -> list[int]:
    """Rows of each cluster: by fractions, balanced, or Dirichlet-multinomial above a floor."""
    if fractions is not None:
        if len(fractions) != k:
            raise ValueError("one fraction per cluster")
        share = np.asarray(fractions, float)
        if not math.isclose(share.sum(), 1.0):
            warnings.warn("fractions don't sum to 1; they are rescaled", RuntimeWarning, stacklevel=2)
            share = share / share.sum()
        sizes = np.floor(n * share).astype(int)
        for i in range(n - sizes.sum()):
            sizes[i % k] += 1
        return sizes.tolist()
    if balanced:
        return [n // k + (i < n % k) for i in range(k)]
    rng = rng or np.random.default_rng()
    floor = max(min_abs, math.ceil(min_frac * n), 1)
    if floor * k > n:
        raise ValueError(f"{k} clusters of at least {floor} rows don't fit in {n}")
    extra = rng.multinomial(n - floor * k, rng.dirichlet(np.full(k, concentration)))
    return (extra + floor).tolist()


def cluster_scales(scale: float | Sequence[float] | Callable[[int], float], k: int) -> list[float]:
    if callable(scale):
        return [float(scale(i)) for i in range(k)]
    if np.ndim(scale) == 0:
        return [float(scale)] * k
    if len(scale) != k:
        raise ValueError("one scale per cluster")
    return [float(s) for s in scale]


# ---------------------------------------------------------------- centres


def place_centers(method: str, k: int, p: int, box: tuple[float, float], rng: np.random.Generator, candidates: int = 100, tries: int = 200_000) -> np.ndarray:
    """``none`` uniform, ``best_candidate`` far from the earlier ones, ``lhs`` one in each slice of each axis, ``min_dist`` apart by 5 % of the diagonal."""
    low, high = box
    if method == "none":
        return rng.uniform(low, high, (k, p))
    if method == "lhs":
        slices = np.stack([rng.permutation(k) for _ in range(p)], axis=1)
        return low + (high - low) * (slices + rng.uniform(size=(k, p))) / k
    if method == "best_candidate":
        out = rng.uniform(low, high, (1, p))
        while len(out) < k:
            some = rng.uniform(low, high, (candidates, p))
            near = np.linalg.norm(some[:, None] - out[None], axis=2).min(1)
            out = np.concatenate([out, some[[near.argmax()]]])
        return out
    if method == "min_dist":
        apart, out = 0.05 * (high - low) * math.sqrt(p), []
        for _ in range(tries):
            c = rng.uniform(low, high, p)
            if all(np.linalg.norm(c - o) >= apart for o in out):
                out.append(c)
                if len(out) == k:
                    return np.array(out)
        raise ValueError("no room for centres at that distance")
    raise ValueError(f"unknown placement {method!r}")


# ---------------------------------------------------------------- covariance


def correlation(kind: str, p: int, rho: float = 0.0, block: int = 2) -> np.ndarray:
    """``none``, ``ar1`` (rho to the distance of the columns) or ``block`` (rho inside blocks of columns)."""
    i = np.arange(p)
    if kind == "none":
        return np.eye(p)
    if kind == "ar1":
        if not -1 < rho < 1:
            raise ValueError("rho must be inside (-1, 1)")
        return float(rho) ** np.abs(i[:, None] - i[None])
    if kind == "block":
        if not -1 / max(block - 1, 1) < rho < 1:
            raise ValueError("rho makes the blocks indefinite")
        return np.where(i[:, None] == i[None], 1.0, np.where(i[:, None] // block == i[None] // block, rho, 0.0))
    raise ValueError(f"unknown correlation {kind!r}")


def cholesky(cov: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        return np.linalg.cholesky(cov + 1e-10 * np.eye(len(cov)))


# ---------------------------------------------------------------- distributions

SHAPES = ("gaussian", "t", "uniform_ball", "circles", "moons", "swiss_roll")


def _shape(kind: str, n: int, rng: np.random.Generator, noise: float) -> np.ndarray:
    u = rng.uniform(size=n)
    if kind == "circles":
        radius = np.where(rng.uniform(size=n) < 0.5, 1.0, 0.5)
        flat = np.stack([radius * np.cos(2 * np.pi * u), radius * np.sin(2 * np.pi * u)], 1)
    elif kind == "moons":
        lower = rng.uniform(size=n) < 0.5
        a = np.pi * u
        flat = np.stack([np.where(lower, 1 - np.cos(a), np.cos(a)), np.where(lower, 0.5 - np.sin(a), np.sin(a))], 1)
    else:
        a = 1.5 * np.pi * (1 + 2 * u)
        flat = np.stack([a * np.cos(a), a * np.sin(a)], 1)
    return flat + noise * rng.normal(size=flat.shape)


# Mean and deviation of each flat shape's columns, by quadrature of its definition.
def _shape_moments(kind: str, noise: float) -> tuple[np.ndarray, np.ndarray]:
    sample = _shape(kind, 200_000, np.random.default_rng(0), noise)
    return sample.mean(0), sample.std(0)


def draw_cluster(kind: str, n: int, center: np.ndarray, root: np.ndarray, rng: np.random.Generator, df: float = 5.0, noise: float = 0.05, lift: np.ndarray | None = None, moments: tuple | None = None) -> np.ndarray:
    """``n`` rows of one cluster; ``root`` is the Cholesky factor of its covariance."""
    p = len(center)
    if kind in ("gaussian", "t", "uniform_ball"):
        z = rng.normal(size=(n, p))
        if kind == "t":
            z = z * np.sqrt(df / rng.chisquare(df, n))[:, None]
        elif kind == "uniform_ball":
            z = z / np.linalg.norm(z, axis=1, keepdims=True) * (rng.uniform(size=n) ** (1 / p) * math.sqrt(p + 2))[:, None]
        return center + z @ root.T
    if kind not in SHAPES:
        raise ValueError(f"unknown distribution {kind!r}; options: {', '.join(SHAPES)}")
    if p < 2:
        raise ValueError("shapes need at least two dimensions")
    mean, sd = moments
    return center + ((_shape(kind, n, rng, noise) - mean) / sd) @ lift.T @ root.T


def outlier_count(outliers: int | float, n: int) -> int:
    """A count, or a share inside (0, 1); 0 of either kind is none, anything else warns and is none."""
    if isinstance(outliers, (int, np.integer)) and not isinstance(outliers, bool) and outliers >= 0:
        return int(outliers)
    if isinstance(outliers, float) and (outliers == 0 or 0 < outliers < 1):
        return half_up(outliers * n)
    warnings.warn("outliers must be a count or a share inside (0, 1); none are made", RuntimeWarning, stacklevel=2)
    return 0


@dataclass(frozen=True)
class _Task:
    label: int
    block: int
    n: int
    first: int


def simulate_clusters(
    spark: SparkSession,
    n_samples: int = 300,
    n_clusters: int = 3,
    n_features: int = 2,
    *,
    distribution: str | Sequence[str] = "gaussian",
    fractions: Sequence[float] | None = None,
    balanced: bool = True,
    concentration: float = 1.0,
    min_cluster_size: int = 1,
    min_cluster_frac: float = 0.0,
    center_method: str = "best_candidate",
    center_box: tuple[float, float] = (-10.0, 10.0),
    centers: np.ndarray | None = None,
    scale: float | Sequence[float] | Callable[[int], float] = 1.0,
    corr: str = "none",
    rho: float = 0.0,
    corr_block: int = 2,
    df: float = 5.0,
    shape_noise: float = 0.05,
    outliers: int | float = 0,
    outlier_mode: str = "far_gaussian",
    outlier_scale: float = 3.0,
    embed: str | None = None,
    embed_dim: int | None = None,
    embed_gamma: float = 1.0,
    poly_degree: int = 2,
    post_scale: str = "none",
    post_scale_factor: float = 1.0,
    noise_dims: int = 0,
    noise_kind: str = "gaussian",
    noise_scale: float | str = "match",
    shuffle: bool = True,
    random_state: int = 0,
) -> DataFrame:
    """(sample_id, x, label): clustered rows; outliers have label -1."""
    n, k, p = half_up(n_samples), half_up(n_clusters), half_up(n_features)
    if min(n, k, p) < 1:
        raise ValueError("samples, clusters and features must be positive")
    rng = np.random.default_rng(random_state)
    n_out = outlier_count(outliers, n)
    sizes = cluster_sizes(n - n_out, k, fractions, balanced, concentration, min_cluster_size, min_cluster_frac, rng)
    middles = np.asarray(centers, float) if centers is not None else place_centers(center_method, k, p, center_box, rng)
    if middles.shape != (k, p):
        raise ValueError("centres must be one row per cluster")
    scales = cluster_scales(scale, k)
    base = correlation(corr, p, rho, corr_block)
    roots = [cholesky(s * s * base) for s in scales]
    kinds = [distribution] * k if isinstance(distribution, str) else list(distribution)
    if len(kinds) != k or any(d not in SHAPES for d in kinds):
        raise ValueError(f"distribution must be one of {', '.join(SHAPES)}, or one for each cluster")
    lifts = [np.linalg.qr(rng.normal(size=(p, 2)))[0] if p >= 2 else None for _ in range(k)]
    moments = {d: _shape_moments(d, shape_noise) for d in set(kinds) if d in ("circles", "moons", "swiss_roll")}
    if outlier_mode not in ("far_gaussian", "uniform_box"):
        raise ValueError("outlier_mode must be far_gaussian or uniform_box")
    spread = float(np.linalg.norm(middles - middles.mean(0), axis=1).max()) + max(scales)
    tasks, first = [], 0
    for label, size in [*enumerate(sizes), (-1, n_out)]:
        for b in range(-(-size // BLOCK)):
            rows = min(BLOCK, size - b * BLOCK)
            tasks.append(_Task(label, b, rows, first))
            first += rows

    def draw(batches):
        for batch in batches:
            for label, block, rows, start in batch.itertuples(index=False):
                own = np.random.default_rng([random_state, label + 1, block])
                if label >= 0:
                    x = draw_cluster(kinds[label], rows, middles[label], roots[label], own, df, shape_noise, lifts[label], moments.get(kinds[label]))
                elif outlier_mode == "far_gaussian":
                    z = own.normal(size=(rows, p))
                    x = middles.mean(0) + z / np.linalg.norm(z, axis=1, keepdims=True) * spread * outlier_scale
                else:
                    x = own.uniform(middles.min(0) - outlier_scale * max(scales), middles.max(0) + outlier_scale * max(scales), (rows, p))
                yield pd.DataFrame({"sample_id": np.arange(start, start + rows), "x": list(x), "label": np.full(rows, label, np.int32)})

    plan = spark.createDataFrame([(t.label, t.block, t.n, t.first) for t in tasks], "label int, block int, n int, first long").repartition(max(1, min(len(tasks), 512)))
    rows = plan.mapInPandas(draw, "sample_id long, x array<double>, label int")
    labels, x = rows.select("sample_id", "label"), rows.select("sample_id", "x")
    if embed is not None:
        if embed == "random_fourier" and not embed_dim:
            raise ValueError("random_fourier needs embed_dim")
        steps = {"random_fourier": lambda f: fourier_embed(f, embed_dim, embed_gamma, random_state), "poly": lambda f: poly_embed(f, poly_degree), "rbf": lambda f: rbf_embed(f, min(50, n), embed_gamma, random_state)}
        if embed not in steps:
            raise ValueError(f"unknown embedding {embed!r}")
        x = steps[embed](x)
    x = post_scaled(x, rows.select("sample_id", "x"), post_scale, post_scale_factor)
    if noise_dims:
        x = add_noise(x, noise_dims, noise_kind, noise_scale, random_state)
    out = x.join(labels, "sample_id").select("sample_id", "x", "label")
    return out.orderBy(F.md5(F.concat_ws(":", F.lit(random_state), F.col("sample_id").cast("string")))) if shuffle else out.orderBy("sample_id")


def _scatter(features: DataFrame):
    return column_stats(features).agg(F.sqrt(F.sum(F.pow("sd_pop", F.lit(2.0)))).alias("s"))


def post_scaled(x: DataFrame, before: DataFrame, mode: str, factor: float = 1.0) -> DataFrame:
    """``none``, ``standardize`` every column, ``preserve_global`` scatter of ``before``, or both in that order; times ``factor``."""
    from kohesion.functions.features import standardize

    if mode not in ("none", "standardize", "preserve_global", "standardize_preserve"):
        raise ValueError(f"unknown scaling {mode!r}")
    if mode in ("standardize", "standardize_preserve"):
        x = standardize(x)
    if mode in ("preserve_global", "standardize_preserve"):
        ratio = _scatter(before).select(F.col("s").alias("a")).crossJoin(F.broadcast(_scatter(x).select(F.col("s").alias("b")))).select(F.when(F.col("b") > 0, F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).otherwise(1.0).alias("r"))
        x = x.crossJoin(F.broadcast(ratio)).select("sample_id", F.transform("x", lambda v: v * F.col("r")).alias("x"))
    return x if factor == 1.0 else x.select("sample_id", F.transform("x", lambda v: v * factor).alias("x"))


NOISES = {"gaussian": lambda g, s, n: g.normal(0, s, n), "uniform": lambda g, s, n: g.uniform(-s, s, n), "laplace": lambda g, s, n: g.laplace(0, s, n), "t": lambda g, s, n: s * g.standard_t(5, n)}


def add_noise(x: DataFrame, dims: int, kind: str, scale: float | str, seed: int) -> DataFrame:
    """``dims`` more columns; the scale "match" is the mean of the columns' positive deviations."""
    if kind not in NOISES:
        raise ValueError(f"unknown noise {kind!r}; options: {', '.join(NOISES)}")
    if scale == "match":
        row = column_stats(x).agg(F.avg(F.when(F.col("sd_samp") > 0, F.col("sd_samp"))).alias("s")).first()
        scale = row["s"] or 1.0
    s = float(scale)

    def draw(batches):
        for batch in batches:
            more = [NOISES[kind](np.random.default_rng([seed, 1 << 20, int(i)]), s, dims) for i in batch["sample_id"]]
            yield pd.DataFrame({"sample_id": batch["sample_id"], "x": [np.concatenate([a, b]) for a, b in zip(batch["x"], more, strict=True)]})

    return x.mapInPandas(draw, "sample_id long, x array<double>")


def bounding_row(x: DataFrame) -> DataFrame:
    """One row of per-dimension lows and highs."""
    return _as_row(column_stats(x), "low", "high")


# ---------------------------------------------------------------- scenarios

# The overlap of the clusters by difficulty.
DIFFICULTIES = {"easy": {"scale": 1.0}, "medium": {"scale": 2.0}, "hard": {"scale": 3.5}}


def simulate_difficulty(spark: SparkSession, difficulty: str, seed: int = 0, **options) -> DataFrame:
    if difficulty not in DIFFICULTIES:
        raise ValueError(f"unknown difficulty {difficulty!r}; options: {', '.join(DIFFICULTIES)}")
    return simulate_clusters(spark, **{**options, **DIFFICULTIES[difficulty], "random_state": seed})


def simulate_axis(spark: SparkSession, axis: str, value: float, seed: int = 0, **options) -> DataFrame:
    """One point of a scaling axis: ``samples``, ``features``, ``clusters``, ``scale`` or ``noise``."""
    names = {"samples": "n_samples", "features": "n_features", "clusters": "n_clusters", "scale": "scale", "noise": "noise_dims"}
    if axis not in names:
        raise ValueError(f"unknown axis {axis!r}; options: {', '.join(names)}")
    return simulate_clusters(spark, **{**options, names[axis]: value if axis == "scale" else half_up(value), "random_state": seed})


def make_blobs(spark: SparkSession, n: int, centers: int, p: int, std: float = 1.0, seed: int = 0) -> DataFrame:
    return simulate_clusters(spark, n, centers, p, scale=std, center_method="none", random_state=seed)


def make_moons(spark: SparkSession, n: int, noise: float = 0.08, seed: int = 0) -> DataFrame:
    """Two interleaved half circles, labelled by half."""
    rng = np.random.default_rng(seed)
    half = np.arange(n) % 2
    a = rng.uniform(0, np.pi, n)
    x = np.stack([np.where(half == 1, 1 - np.cos(a), np.cos(a)), np.where(half == 1, 0.5 - np.sin(a), np.sin(a))], 1) + noise * rng.normal(size=(n, 2))
    return spark.createDataFrame([(i, [float(v) for v in row], int(h)) for i, (row, h) in enumerate(zip(x, half, strict=True))], "sample_id long, x array<double>, label int")
