"""Benchmark reporting: relational summaries of long result rows, and small driver-side tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval, inside [0, 1]; null for n <= 0."""
    n = F.when(n > 0, n.cast("double"))
    p = successes.cast("double") / n
    z2 = F.lit(Z * Z)
    scale = 1.0 + z2 / n
    mid = (p + z2 / (2.0 * n)) / scale
    half = F.lit(Z) * F.sqrt(p * (1.0 - p) / n + z2 / (4.0 * n * n)) / scale
    # GREATEST and LEAST skip nulls, so an empty group has to stay null by itself.
    return F.when(n.isNotNull(), F.greatest(mid - half, F.lit(0.0))), F.when(n.isNotNull(), F.least(mid + half, F.lit(1.0)))


def summary_stats(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """(*by, n, mean, sd, median, q05, q25, q75, q95); the deviation of a single value is 0."""
    points = {"median": 0.5, "q05": 0.05, "q25": 0.25, "q75": 0.75, "q95": 0.95}
    n = F.count(column)
    return df.groupBy(*by).agg(
        n.alias("n"),
        F.avg(column).alias("mean"),
        F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(column)).alias("sd"),
        *[F.percentile(column, F.lit(q)).alias(name) for name, q in points.items()],
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(own)).filter("__rn = 1").drop("__rn")


def k_recovery(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group over selected rows: how often k is the true one, its error and bias, and the Wilson interval."""
    error = F.col("k") - F.col("true_k")
    hit = (error == 0).cast("int")
    agg = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(hit).alias("n_correct"),
        F.avg(hit.cast("double")).alias("accuracy"),
        F.avg(F.abs(error).cast("double")).alias("mae"),
        F.avg(error.cast("double")).alias("bias"),
        F.avg((error < 0).cast("double")).alias("p_under"),
        F.avg((error > 0).cast("double")).alias("p_over"),
    )
    low, high = wilson(F.col("n_correct"), F.col("n"))
    return agg.withColumn("ci_low", low).withColumn("ci_high", high)


def benchmark_winner(rows: DataFrame, benchmark: str = "benchmark", metric: str = "metric_name") -> DataFrame:
    """Per benchmark the metric of highest accuracy, then lowest error, then name."""
    summary = k_recovery(rows, [benchmark, metric])
    return first_per_key(summary, [benchmark], [F.desc("accuracy"), F.col("mae"), F.col(metric)]).select(benchmark, metric, "n", "accuracy", "mae", "ci_low", "ci_high")


def regime_summary(rows: DataFrame, level: str, metric: str = "metric_name") -> DataFrame:
    """Per level and metric, overall and by true_k, recovery, mean ARI and its distance to the baseline's mean ARI.

    ``true_k`` is null on the overall rows.  One pass makes both levels of detail.
    """
    error = F.col("k") - F.col("true_k")
    detail = F.explode(F.array(F.lit(None).cast("int"), F.col("true_k").cast("int"))).alias("group_k")
    both = rows.select(level, metric, "k", "true_k", "metric_ari", "baseline_ari", detail)
    agg = both.groupBy(level, metric, "group_k").agg(
        F.count("*").alias("n"),
        F.sum((error == 0).cast("int")).alias("n_correct"),
        F.avg("metric_ari").alias("mean_ari"),
        F.avg("baseline_ari").alias("mean_baseline"),
        F.avg(error.cast("double")).alias("k_bias"),
        F.avg((error < 0).cast("double")).alias("p_under"),
        F.avg((error > 0).cast("double")).alias("p_over"),
    )
    low, high = wilson(F.col("n_correct"), F.col("n"))
    return agg.withColumn("delta_to_baseline", F.col("mean_ari") - F.col("mean_baseline")).withColumn("ci_low", low).withColumn("ci_high", high)


def baseline_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per dataset for the baseline, which is repeated on every metric's row."""
    return rows.groupBy(*keys).agg(F.max("baseline_ari").alias("baseline_ari"))


def oracle_rows(rows: DataFrame, level: str, keys: Sequence[str]) -> DataFrame:
    """The baseline as a method of its own in a regime summary: what the right k reaches, overall and by true_k.

    It picks the true k always, and its distance to itself is 0; ``keys`` tell the datasets.
    """
    once = rows.groupBy(level, *keys).agg(F.max("baseline_ari").alias("baseline_ari"), F.first("true_k").alias("k"))
    detail = F.explode(F.array(F.lit(None).cast("int"), F.col("k").cast("int"))).alias("group_k")
    agg = once.select(level, "baseline_ari", detail).groupBy(level, "group_k").agg(F.count("*").alias("n"), F.avg("baseline_ari").alias("mean_ari"))
    return agg.select(level, F.lit("oracle").alias("metric_name"), F.col("group_k").alias("true_k"), "n", F.col("n").alias("n_correct"), "mean_ari", F.lit(0.0).alias("delta"))


def select_rows(rows: DataFrame, metrics: Sequence[str] | None = None, optimal: bool = False, true_k: bool = False, axis: str | None = None, value: float | None = None) -> DataFrame:
    """Rows of some metrics, of the chosen k, of a right k, at an axis value; a condition on a column that isn't there holds for all rows."""
    have, keep = set(rows.columns), F.lit(True)
    if metrics is not None:
        keep = keep & F.col("metric_name").isin(*metrics)
    if optimal and "is_optimal" in have:
        keep = keep & F.coalesce(F.col("is_optimal"), F.lit(False))
    if true_k and {"true_k", "k"} <= have:
        keep = keep & (F.col("true_k") == F.col("k"))
    if axis in have:
        keep = keep & is_close(F.col(axis).cast("double"), F.lit(value))
    return rows.filter(keep)


def metric_names(*tables: DataFrame, column: str = "metric_name") -> DataFrame:
    """The metrics that any of some tables has."""
    names = [t.select(column) for t in tables]
    return reduce(DataFrame.union, names).filter(F.col(column).isNotNull()).distinct()


def best_per_curve(curves: DataFrame, by: Sequence[str], method: str, value: str, k: str = "k") -> DataFrame:
    """The whole curves of each group's best method: the one of the highest value anywhere, the smallest k and then name on ties."""
    own = Window.partitionBy(*by).orderBy(F.desc_nulls_last(value), F.col(k), F.col(method))
    best = curves.withColumn("__rn", F.row_number().over(own)).filter((F.col("__rn") == 1) & F.col(value).isNotNull()).select(*by, method)
    return curves.join(best, [*by, method], "left_semi")


def snapshot_summary(rows: DataFrame, level: str, metric: str = "metric_name") -> DataFrame:
    """(level, metric, n, accuracy, ci_low, ci_high, quartiles and mean of the agreement, mean_baseline of the level's datasets)."""
    recovered = k_recovery(rows, [level, metric]).select(level, metric, "n", "accuracy", "ci_low", "ci_high")
    spread = summary_stats(rows, [level, metric], "metric_ari").select(level, metric, "q25", "median", "q75", "mean")
    base = rows.groupBy(level, "dataset_iteration", "true_k").agg(F.max("baseline_ari").alias("b")).groupBy(level).agg(F.avg("b").alias("mean_baseline"))
    return recovered.join(spread, [level, metric]).join(base, level)


def anchors(rows: DataFrame, column: str) -> list:
    """The three distinct levels, ascending; any other number is an error."""
    values = sorted(r[0] for r in rows.select(column).distinct().limit(4).collect())
    if len(values) != 3:
        raise ValueError(f"expected exactly three values of {column!r}")
    return values


def regime_pivot(rows: DataFrame, level: str, levels: Sequence, value: Column, metric: str = "metric_name") -> DataFrame:
    """(metric, true_k, one column per level): means of ``value``."""
    return rows.withColumn("__v", value).groupBy(metric, "true_k").pivot(level, list(levels)).agg(F.avg("__v"))


def axis_summary(rows: DataFrame, by: Sequence[str], column: str, median: bool = False) -> DataFrame:
    """(*by, n, center, se): mean or median, and sd / sqrt(n), 0 for one value."""
    n = F.count(column)
    center = F.percentile(column, F.lit(0.5)) if median else F.avg(column)
    return rows.groupBy(*by).agg(n.alias("n"), center.alias("center"), F.when(n <= 1, F.lit(0.0)).otherwise(F.stddev_samp(column) / F.sqrt(n.cast("double"))).alias("se"))


def best_and_second(rows: DataFrame, by: Sequence[str], column: str, order: str = "desc") -> DataFrame:
    """Rows with ``place``, the competition rank of the value: "desc", "asc", or "abs" for closest to zero."""
    key = {"desc": F.desc_nulls_last(column), "asc": F.asc_nulls_last(column), "abs": F.abs(F.col(column)).asc_nulls_last()}[order]
    return rows.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(key)))


def method_order(rows: DataFrame, metric: str, selected: Sequence[str], classical: Sequence[str], baseline: str, value: str) -> DataFrame:
    """Rows with ``position``: the baseline, the selected methods, the classical ones, then the others, each by falling mean."""
    group = F.when(F.col(metric) == baseline, 0).when(F.col(metric).isin(*selected), 1).when(F.col(metric).isin(*classical), 2).otherwise(3)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(group, F.desc_nulls_last(value), metric)))


def runtime_table(runtimes: DataFrame, axis: str, levels: Sequence, stages: Mapping[str, str]) -> DataFrame:
    """(stage, level columns of mean and sd): runtimes unpivoted by stage and pivoted by level."""
    pairs = ", ".join(f"'{name}', {column}" for name, column in stages.items())
    long = runtimes.select(axis, F.expr(f"stack({len(stages)}, {pairs}) as (stage, seconds)"))
    sd = F.when(F.count("seconds") <= 1, F.lit(0.0)).otherwise(F.stddev_samp("seconds"))
    return long.groupBy("stage").pivot(axis, list(levels)).agg(F.avg("seconds").alias("mean"), sd.alias("sd"))


def is_close(a: Column, b: Column) -> Column:
    """Equality within 1e-8 + 1e-5 |b|."""
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def tolerance_report(left: DataFrame, right: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: Mapping[str, float]) -> DataFrame:
    """(metric, n, mean_diff, max_diff, pass_rate) of two result tables joined on ``keys``."""
    a = left.select(*keys, *[F.col(m).alias(f"{m}_a") for m in metrics])
    b = right.select(*keys, *[F.col(m).alias(f"{m}_b") for m in metrics])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.abs(F.col(f"{m}_a") - F.col(f"{m}_b")).alias("d"), F.lit(float(tolerance[m])).alias("tol")) for m in metrics]))
    long = a.join(b, list(keys)).select(rows.alias("r")).select("r.*")
    return long.groupBy("metric").agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.max("d").alias("max_diff"), F.avg((F.col("d") <= F.col("tol")).cast("double")).alias("pass_rate"))


# ---------------------------------------------------------------- crosstabs


def crosstab(df: DataFrame, rows: str, cols: str, order: Sequence) -> DataFrame:
    """Counts with one column per value of ``order``, 0 where there are none."""
    return df.groupBy(rows).pivot(cols, list(order)).count().na.fill(0)


def purity(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    """(cluster, n, purity, dominant): the largest class's share, and that class, the smallest name on ties."""
    table = df.groupBy(cluster, truth).agg(F.count("*").alias("n"))
    total = F.sum("n")
    top = F.min(F.struct((-F.col("n")).alias("m"), F.col(truth).alias("t")))
    return table.groupBy(cluster).agg(total.alias("n"), (F.max("n") / F.greatest(total, F.lit(1))).alias("purity"), top["t"].alias("dominant"))


def merged_populations(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """(cluster, populations): classes whose dominant cluster is the same, where there are several."""
    dominant = purity(df, truth, cluster).select(F.col(truth), F.col("dominant").alias("cluster"))
    return dominant.groupBy("cluster").agg(F.sort_array(F.collect_list(truth)).alias("populations")).filter(F.size("populations") > 1)


def barycenter_order(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    """(cluster, barycenter, position): clusters by the weighted mean place of their classes."""
    place = df.select(truth).distinct().withColumn("place", F.row_number().over(Window.orderBy(truth)) - 1)
    table = df.groupBy(cluster, truth).agg(F.count("*").alias("n")).join(F.broadcast(place), truth)
    mean = table.groupBy(cluster).agg((F.sum(F.col("n") * F.col("place")) / F.sum("n")).alias("barycenter"))
    return mean.withColumn("position", F.row_number().over(Window.orderBy("barycenter", cluster)))


def alluvial_flows(df: DataFrame, left: str, middle: str, right: str) -> DataFrame:
    """(side, source, target, n): flows from ``left`` to ``middle`` and on to ``right``."""
    cast = lambda c: F.col(c).cast("string")
    a = df.groupBy(cast(left).alias("source"), cast(middle).alias("target")).count().withColumn("side", F.lit("left"))
    b = df.groupBy(cast(middle).alias("source"), cast(right).alias("target")).count().withColumn("side", F.lit("right"))
    return a.union(b).select("side", "source", "target", F.col("count").alias("n"))


def segment_stack(df: DataFrame, group: str, gap: float = 0.015) -> DataFrame:
    """(group, n, top, bottom): segments stacked from 1 downwards in group order, with gaps between them."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    every, ordered = Window.partitionBy(), Window.orderBy(group)
    room = F.greatest(1.0 - gap * (F.count("*").over(every) - 1), F.lit(0.0))
    height = F.col("n") / F.sum("n").over(every) * room
    below = F.sum("h").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    stacked = sizes.withColumn("h", height).withColumn("before", F.coalesce(below, F.lit(0.0)) + gap * (F.row_number().over(ordered) - 1))
    return stacked.select(group, "n", (1.0 - F.col("before")).alias("top"), (1.0 - F.col("before") - F.col("h")).alias("bottom"))


# ---------------------------------------------------------------- names and tables


def display_name(c: Column) -> Column:
    """Underscores as spaces, words with a capital."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def short_number(c: Column) -> Column:
    """A number with three significant digits and no zeros at the end; whole numbers as they are."""
    digits = F.greatest(F.lit(0), F.lit(2) - F.floor(F.log10(F.abs(c))).cast("int"))
    scaled = F.pow(F.lit(10.0), digits.cast("double"))
    fixed = F.regexp_replace(F.format_string("%.9f", F.round(c * scaled) / scaled), r"\.?0+$", "")
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(fixed)


def config_label(estimator: str = "estimator", columns: Sequence[str] = ("n_clusters", "linkage", "affinity", "gamma"), types: Mapping[str, str] | None = None, absent: str = "_NA_") -> Column:
    """``estimator, p=v, ...`` without the parameters that are null, NaN or ``absent``; ``types`` of columns, to shorten numbers with a fraction."""
    parts = []
    for c in columns:
        value, real = F.col(f"`{c}`"), (types or {}).get(c) in ("double", "float")
        there = value.isNotNull() & (~F.isnan(value) if real else value.cast("string") != absent)
        parts.append(F.when(there, F.concat(F.lit(f"{c}="), short_number(value) if real else value.cast("string"))))
    return F.concat_ws(", ", F.col(estimator), *parts)


_TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def tex_escape(text: str) -> str:
    return "".join(_TEX.get(c, c) for c in text)


def tex_table(rows: Sequence[Mapping], columns: Sequence[str], decimals: int = 3, caption: str = "", label: str = "", bold: Mapping[str, str] | None = None, group: str | None = None) -> str:
    """A LaTeX table of a few collected rows; the best value of each column in ``bold`` (column: "max", "min" or "abs") is bold, the second underlined."""
    marks: dict[tuple[int, str], str] = {}
    for column, how in (bold or {}).items():
        key = {"max": lambda v: -v, "min": lambda v: v, "abs": abs}[how]
        values = sorted({key(r[column]) for r in rows if r[column] is not None})
        for i, r in enumerate(rows):
            if r[column] is not None and key(r[column]) in values[:2]:
                marks[i, column] = r"\textbf" if key(r[column]) == values[0] else r"\underline"

    def cell(i: int, column: str) -> str:
        v = rows[i][column]
        text = "--" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else tex_escape(str(v))
        return f"{marks[i, column]}{{{text}}}" if (i, column) in marks else text

    shown = [c for c in columns if c != group]
    lines = [r"\begin{table}", r"\centering", rf"\begin{{tabular}}{{l{'r' * (len(shown) - 1)}}}", r"\toprule", " & ".join(tex_escape(c) for c in shown) + r" \\", r"\midrule"]
    last = object()
    for i, r in enumerate(rows):
        if group and r[group] != last:
            if i:
                lines.append(r"\midrule")
            lines.append(rf"\multicolumn{{{len(shown)}}}{{l}}{{{tex_escape(str(r[group]))}}} \\")
            last = r[group]
        lines.append(" & ".join(cell(i, c) for c in shown) + r" \\")
    lines += [r"\bottomrule", r"\end{tabular}"]
    if caption:
        lines.append(rf"\caption{{{tex_escape(caption)}}}")
    if label:
        lines.append(rf"\label{{{label}}}")
    return "\n".join([*lines, r"\end{table}"])
