"""Feature tables and their preprocessing, as column expressions and small aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def features_from_columns(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(sample_id, x) from numeric columns."""
    for c in columns:
        if not isinstance(df.schema[c].dataType, _NUMERIC):
            raise ValueError(f"column {c!r} is not numeric")
    return df.select(F.col(id_col).cast("long").alias("sample_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))


def features_from_array(df: DataFrame, id_col: str, array_col: str, first: int | None = None) -> DataFrame:
    """(sample_id, x) from an array column, or its first components."""
    if not isinstance(df.schema[array_col].dataType, T.ArrayType):
        raise ValueError(f"column {array_col!r} is not an array")
    x = F.col(array_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("sample_id"), (F.slice(x, 1, first) if first else x).alias("x"))


def features_from_matrix(spark, x) -> DataFrame:
    """(sample_id, x) from an in-memory matrix; a vector is one column, a flat list one row."""
    if hasattr(x, "to_numpy"):
        x = x.to_numpy()
    if isinstance(x, list):
        values = np.atleast_2d(np.asarray(x, dtype=float))
    elif isinstance(x, np.ndarray):
        if x.ndim not in (1, 2):
            raise ValueError("a matrix has one or two dimensions")
        values = x.reshape(len(x), -1).astype(float)
    else:
        raise ValueError("expected an array, a data frame or a list")
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(values)], "sample_id long, x array<double>")


def transpose(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """(sample_id, x): the components become samples and the rows, by ascending id, their features."""
    long = df.select(F.col(id_col).alias("r"), F.posexplode(array_col).alias("c", "v"))
    entry = F.sort_array(F.collect_list(F.struct("r", F.col("v").cast("double").alias("v"))))
    return long.groupBy(F.col("c").cast("long").alias("sample_id")).agg(F.transform(entry, lambda e: e["v"]).alias("x"))


def long_form(features: DataFrame) -> DataFrame:
    """(sample_id, dim, v), one row per component."""
    return features.select("sample_id", F.posexplode("x").alias("dim", "v"))


def column_stats(features: DataFrame, quantiles: Sequence[float] = ()) -> DataFrame:
    """(dim, n, mean, sd_pop, sd_samp, low, high, q): one row per dimension."""
    own = [F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd_pop"), F.stddev_samp("v").alias("sd_samp"), F.min("v").alias("low"), F.max("v").alias("high")]
    if quantiles:
        own.append(F.percentile("v", F.array(*[F.lit(float(q)) for q in quantiles])).alias("q"))
    return long_form(features).groupBy("dim").agg(*own)


def _as_row(stats: DataFrame, *columns: str) -> DataFrame:
    """The statistics as one row of arrays by dimension."""
    packed = F.sort_array(F.collect_list(F.struct("dim", *columns)))
    part = lambda c: F.transform("s", lambda e: e[c]).alias(f"__{c}")
    return stats.agg(packed.alias("s")).select(*[part(c) for c in columns])


def standardize(features: DataFrame) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes zero."""
    stats = _as_row(column_stats(features), "mean", "sd_pop")
    scaled = F.zip_with(F.zip_with("x", "__mean", lambda a, m: a - m), "__sd_pop", lambda a, s: a / F.when(s > 0, s).otherwise(F.lit(1.0)))
    return features.crossJoin(F.broadcast(stats)).select("sample_id", scaled.alias("x"))


def log1p(features: DataFrame) -> DataFrame:
    return features.select("sample_id", F.transform("x", F.log1p).alias("x"))


def asinh(features: DataFrame, cofactor: float = 5.0) -> DataFrame:
    return features.select("sample_id", F.transform("x", lambda v: F.asinh(v / cofactor)).alias("x"))


def robust_scale(features: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Minus the median, divided by the range between two quantiles; a zero range counts as one."""
    stats = column_stats(features, (0.5, low, high)).select("dim", F.col("q")[0].alias("mid"), (F.col("q")[2] - F.col("q")[1]).alias("width"))
    row = _as_row(stats, "mid", "width")
    scaled = F.zip_with(F.zip_with("x", "__mid", lambda a, m: a - m), "__width", lambda a, w: a / F.when(w > 0, w).otherwise(F.lit(1.0)))
    return features.crossJoin(F.broadcast(row)).select("sample_id", scaled.alias("x"))


def normalize_total(features: DataFrame, target: float = 1e4) -> DataFrame:
    """Every row scaled to the target sum; a row that sums to zero stays."""
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return features.select("sample_id", "x", total.alias("t")).select("sample_id", F.transform("x", lambda v: F.when(F.col("t") != 0, v / F.col("t") * target).otherwise(v)).alias("x"))


def top_variable(features: DataFrame, n_top: int, n_bins: int = 20) -> DataFrame:
    """(dim, dispersion, normalised): the ``n_top`` dimensions of highest dispersion relative to dimensions of like mean."""
    from pyspark.sql import Window

    stats = column_stats(features).select("dim", "mean", F.when(F.col("mean") > 0, F.pow("sd_samp", F.lit(2.0)) / F.col("mean")).alias("dispersion"))
    binned = stats.withColumn("bin", F.ntile(n_bins).over(Window.orderBy("mean", "dim")))
    own = Window.partitionBy("bin")
    spread = F.stddev_samp("dispersion").over(own)
    score = (F.col("dispersion") - F.avg("dispersion").over(own)) / F.when(spread > 0, spread).otherwise(F.lit(1.0))
    return binned.select("dim", "dispersion", score.alias("normalised")).orderBy(F.desc_nulls_last("normalised"), "dim").limit(n_top)


def top_variable_by_batch(features: DataFrame, batches: DataFrame, n_top: int, n_bins: int = 20) -> DataFrame:
    """(dim, n_batches, normalised): the dimensions that are among the ``n_top`` of most batches, then those of the highest mean score.

    ``batches`` has (sample_id, batch).  One pass makes the moments of all batches.
    """
    from pyspark.sql import Window

    long = features.join(batches, "sample_id").select("batch", F.posexplode("x").alias("dim", "v"))
    stats = long.groupBy("batch", "dim").agg(F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    scored = stats.select("batch", "dim", "mean", F.when(F.col("mean") > 0, F.col("var") / F.col("mean")).alias("dispersion"))
    scored = scored.withColumn("bin", F.ntile(n_bins).over(Window.partitionBy("batch").orderBy("mean", "dim")))
    own = Window.partitionBy("batch", "bin")
    spread = F.stddev_samp("dispersion").over(own)
    scored = scored.withColumn("score", (F.col("dispersion") - F.avg("dispersion").over(own)) / F.when(spread > 0, spread).otherwise(F.lit(1.0)))
    place = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc_nulls_last("score"), "dim"))
    ranked = scored.withColumn("top", (place <= n_top).cast("int"))
    return ranked.groupBy("dim").agg(F.sum("top").alias("n_batches"), F.avg("score").alias("normalised")).orderBy(F.desc("n_batches"), F.desc_nulls_last("normalised"), "dim").limit(n_top)


def poly_embed(features: DataFrame, degree: int = 2) -> DataFrame:
    """x, its powers, and the product of the first two components."""
    if not isinstance(degree, int) or degree < 1:
        raise ValueError("degree must be a positive integer")
    parts = [F.col("x"), F.transform("x", lambda v: F.pow(v, F.lit(float(degree))))]
    product = F.when(F.size("x") >= 2, F.array(F.get("x", F.lit(0)) * F.get("x", F.lit(1)))).otherwise(F.array().cast("array<double>"))
    return features.select("sample_id", F.concat(*parts, product).alias("x"))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, d: s + d)


def rbf_embed(features: DataFrame, m: int = 50, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """exp(-gamma d^2) to ``m`` prototypes, the rows with the smallest md5 of seed and id."""
    picked = features.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("sample_id").cast("string"))), "sample_id").limit(m)
    order = F.sort_array(F.collect_list(F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col("sample_id").cast("string"))).alias("key"), "sample_id", "x")))
    row = picked.agg(F.transform(order, lambda e: e["x"]).alias("__p"))
    return features.crossJoin(F.broadcast(row)).select("sample_id", F.transform("__p", lambda p: F.exp(-gamma * squared_distance("x", p))).alias("x"))


def fourier_embed(features: DataFrame, n_out: int, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """sqrt(2/D) cos(xW + b) with fixed random W and b."""
    p = len(features.select("x").first()["x"])
    rng = np.random.default_rng(seed)
    w, b = rng.normal(scale=np.sqrt(2 * gamma), size=(n_out, p)), rng.uniform(0, 2 * np.pi, n_out)
    planes = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in row]).alias("w"), F.lit(float(c)).alias("b")) for row, c in zip(w, b, strict=True)])
    dot = lambda e: F.aggregate(F.zip_with("x", e["w"], lambda u, v: u * v), F.lit(0.0), lambda s, d: s + d)
    return features.select("sample_id", F.transform(planes, lambda e: float(np.sqrt(2 / n_out)) * F.cos(dot(e) + e["b"])).alias("x"))


def pca(features: DataFrame, n_components: int) -> DataFrame:
    """Scores on the leading principal components of the centred features; a component's largest loading is positive.

    The covariance comes from one pass of partition sums; only a p x p matrix reaches the driver.
    """
    n, mean, cov = covariance(features)
    values, vectors = np.linalg.eigh(cov)
    lead = vectors[:, np.argsort(values)[::-1][:n_components]]
    lead = lead * np.where(lead[np.abs(lead).argmax(0), np.arange(lead.shape[1])] < 0, -1, 1)
    shift = mean @ lead
    planes = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in lead[:, j]]).alias("w"), F.lit(float(shift[j])).alias("b")) for j in range(lead.shape[1])])
    dot = lambda e: F.aggregate(F.zip_with("x", e["w"], lambda u, v: u * v), F.lit(0.0), lambda s, d: s + d)
    return features.select("sample_id", F.transform(planes, lambda e: dot(e) - e["b"]).alias("x"))


def covariance(features: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, population covariance)."""
    import pyarrow as pa

    def sums(batches):
        n, s, q = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
            n += len(x)
            s = x.sum(0) if s is None else s + x.sum(0)
            q = x.T @ x if q is None else q + x.T @ x
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    parts = features.select("x").mapInArrow(sums, "n long, s array<double>, q array<double>").collect()
    n = sum(r["n"] for r in parts)
    s = np.sum([r["s"] for r in parts], axis=0)
    q = np.sum([r["q"] for r in parts], axis=0).reshape(len(s), len(s))
    mean = s / n
    return n, mean, q / n - np.outer(mean, mean)


def explained_variance(features: DataFrame, n_components: int) -> list[float]:
    """Variances of the leading components, with denominator n - 1."""
    n, _, cov = covariance(features)
    return (np.linalg.eigvalsh(cov)[::-1][:n_components] * n / max(n - 1, 1)).tolist()


STEPS = {"identity": lambda f: f, "standardize": standardize, "log1p": log1p, "asinh": asinh, "robust": robust_scale, "pca": pca, "normalize_total": normalize_total}


def apply_step(features: DataFrame, kind: str, params: dict) -> DataFrame:
    """A registered preprocessing step, or a callable on the features table.  It is fitted on all rows."""
    step = kind if callable(kind) else STEPS.get(kind)
    if step is None:
        raise ValueError(f"unknown preprocessing {kind!r}; options: {', '.join(STEPS)}")
    return step(features, **params)
