"""The tables behind every plot; drawing is left to the reader's tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohesion.functions.ranking import numbered
from kohesion.functions.reports import config_label
from kohesion.plans.planner import resolve_measure


def metric_over_k(results: DataFrame, measure: str = "stability") -> DataFrame:
    """(method, label, n_clusters, value, se, upper, lower); methods are numbered m0, m1, ... by their first configuration."""
    column = resolve_measure(measure)
    params = [c for c in ("linkage", "affinity", "gamma") if c in results.columns]
    first = F.min("config_id").over(Window.partitionBy("estimator", *params))
    more = [(F.col(f"{column}_{s}") if f"{column}_{s}" in results.columns else F.lit(None).cast("double")).alias(s) for s in ("se", "upper", "lower")]
    numbered = results.withColumn("__first", first).withColumn("method", F.concat(F.lit("m"), (F.dense_rank().over(Window.orderBy("__first")) - 1).cast("string")))
    return numbered.select("method", config_label(columns=params).alias("label"), "n_clusters", F.col(column).alias("value"), *more)


def block_order(labels: DataFrame) -> DataFrame:
    """(sample_id, label, position, boundary): samples by label; a boundary is where the label changes."""
    by_label = Window.partitionBy("label").orderBy("sample_id")
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("label")) - F.col("n")).drop("n")
    place = labels.withColumn("inside", F.row_number().over(by_label)).join(F.broadcast(before), "label")
    return place.select("sample_id", "label", (F.col("before") + F.col("inside") - 1).alias("position"), ((F.col("inside") == 1) & (F.col("before") > 0)).alias("boundary"))


def heatmap(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """(row, col, p): the consensus matrix's cells in block order; 0.5 where a pair is unknown, 1 on the diagonal."""
    place = order.select("sample_id", "position")
    a = place.select(F.col("sample_id").alias("i"), F.col("position").alias("pi"))
    b = place.select(F.col("sample_id").alias("j"), F.col("position").alias("pj"))
    known = pairs.join(a, "i").join(b, "j").select(F.explode(F.array(F.struct(F.col("pi").alias("row"), F.col("pj").alias("col")), F.struct(F.col("pj").alias("row"), F.col("pi").alias("col")))).alias("c"), F.col("p").cast("double").alias("p"))
    cells = a.select(F.col("pi").alias("row")).crossJoin(b.select(F.col("pj").alias("col")))
    value = F.when(F.col("row") == F.col("col"), F.lit(1.0)).otherwise(F.coalesce("p", F.lit(0.5)))
    return cells.join(known.select("c.*", "p"), ["row", "col"], "left").select("row", "col", value.alias("p"))


def finite(scores: DataFrame, column: str) -> DataFrame:
    return scores.filter(F.col(column).isNotNull() & ~F.isnan(column))


def cluster_quartiles(scores: DataFrame, column: str, by: str = "label") -> DataFrame:
    """(by, n, q25, median, q75, mean, low, high) of finite scores per cluster."""
    return finite(scores, column).groupBy(by).agg(
        F.count("*").alias("n"),
        F.percentile(column, F.lit(0.25)).alias("q25"),
        F.percentile(column, F.lit(0.5)).alias("median"),
        F.percentile(column, F.lit(0.75)).alias("q75"),
        F.avg(column).alias("mean"),
        F.min(column).alias("low"),
        F.max(column).alias("high"),
    )


def axis_limits(scores: DataFrame, column: str) -> DataFrame:
    """(low, high): the scores' range, widened by 5 % and by 0.02 at least."""
    agg = finite(scores, column).agg(F.min(column).alias("a"), F.max(column).alias("b"))
    pad = F.greatest(F.lit(0.02), 0.05 * (F.col("b") - F.col("a")))
    return agg.select((F.col("a") - pad).alias("low"), (F.col("b") + pad).alias("high"))


def relabel_from_one(scores: DataFrame, by: str = "label") -> DataFrame:
    """Rows with ``display``, the labels numbered from 1 in numeric order."""
    return scores.join(numbered(scores.select(by).distinct(), [by], "display"), by)


def scatter_encoding(points: DataFrame, column: str, size: tuple[float, float] = (10.0, 80.0), alpha: tuple[float, float] = (0.25, 1.0)) -> DataFrame:
    """Points with the score scaled to 0..1, a size, an alpha and a draw order; a constant score takes the middle."""
    bounds = finite(points, column).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    width = F.col("__hi") - F.col("__lo")
    norm = F.when(F.col(column).isNull(), F.lit(0.0)).when(width > 0, (F.col(column) - F.col("__lo")) / F.nullif(width, F.lit(0.0))).otherwise(F.lit(0.5))
    scaled = points.crossJoin(F.broadcast(bounds)).withColumn("norm", norm)
    at = lambda r: F.lit(float(r[0])) + F.col("norm") * float(r[1] - r[0])
    return numbered(scaled.withColumn("size", at(size)).withColumn("alpha", at(alpha)).drop("__lo", "__hi"), ["alpha", "sample_id"], "draw_order")


def category_order(df: DataFrame, column: str, by: str = "label") -> DataFrame:
    """(column, n, position): categories by name, or by falling size with ``by="size_desc"``."""
    if by not in ("label", "size_desc"):
        raise ValueError("by must be label or size_desc")
    sizes = df.groupBy(column).agg(F.count("*").alias("n"))
    order = [F.col(column)] if by == "label" else [F.desc("n"), F.col(column)]
    return sizes.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def violin_points(scores: DataFrame, value: str = "score", label: str = "label") -> DataFrame:
    """(sample_id, label, score, share): every finite score with its rank in its cluster, from 0 to 1."""
    own = Window.partitionBy(label)
    known = scores.filter(F.col(value).isNotNull() & ~F.isnan(value))
    rank = (F.row_number().over(own.orderBy(value, "sample_id")) - 1) / F.greatest(F.count("*").over(own) - 1, F.lit(1))
    return known.select("sample_id", F.col(label).alias("label"), F.col(value).alias("score"), rank.alias("share"))


def cluster_means(scores: DataFrame, value: str = "score", label: str = "label") -> DataFrame:
    """(label, n, mean) of a scatter's clusters."""
    return scores.groupBy(F.col(label).alias("label")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def projection(features: DataFrame) -> DataFrame:
    """(sample_id, px, py): two principal components; fewer dimensions are padded with zero."""
    from kohesion.functions.features import pca

    p = len(features.select("x").first()["x"])
    flat = pca(features, 2) if p > 2 else features
    return flat.select("sample_id", F.get("x", F.lit(0)).alias("px"), F.coalesce(F.get("x", F.lit(1)), F.lit(0.0)).alias("py"))
