"""Choice of a configuration from the results table, by window expressions."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from kohesion.plans.planner import resolve_measure, resolve_rule


def _first(df: DataFrame, *order: Column) -> DataFrame:
    """The first row by ``order``, then by config_id; a top-1, not a sort."""
    return df.orderBy(*order, F.col("config_id")).limit(1)


def select_max(results: DataFrame, column: str) -> DataFrame:
    """The row with the highest score; the first configuration on ties."""
    return _first(results.filter(F.col(column).isNotNull()), F.desc(column))


def _against_best(results: DataFrame, column: str, *more: str) -> DataFrame:
    best = select_max(results, column).select(F.col(column).alias("__best"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(more)])
    return results.crossJoin(F.broadcast(best))


def select_1se(results: DataFrame, column: str) -> DataFrame:
    """Of the rows within one standard error of the best score, the first with the most clusters."""
    near = _against_best(results, column, f"{column}_se").filter(F.col(column) >= F.col("__best") - F.col("__0"))
    return _first(near, F.desc("n_clusters")).select(*results.columns)


def select_quantile(results: DataFrame, column: str) -> DataFrame:
    """Of the rows between the best row's quantiles, the first with the most clusters; without any, the best row."""
    near = _against_best(results, column, f"{column}_lower", f"{column}_upper").filter(F.col(column).between(F.col("__0"), F.col("__1")))
    chosen = _first(near, F.desc("n_clusters")).select(*results.columns, F.lit(0).alias("__late"))
    fallback = select_max(results, column).withColumn("__late", F.lit(1))
    return chosen.union(fallback).orderBy("__late").limit(1).drop("__late")


def select_row(results: DataFrame, measure: str = "stability", rule: str = "1se", not_two: bool = False, k: int | None = None) -> DataFrame:
    """One row: the configuration that the rule picks by the measure.

    With ``k`` only configurations with k clusters stand; with ``not_two`` those with two fall out.
    """
    column = resolve_measure(measure)
    if k is not None:
        results = results.filter(F.col("n_clusters") == k)
        if results.isEmpty():
            raise ValueError(f"no configurations for k={k}")
    elif not_two:
        results = results.filter("n_clusters <> 2")
        if results.isEmpty():
            raise ValueError("no configurations are left without k=2")
    rule = resolve_rule(rule, column, results.columns)
    return {"max": select_max, "1se": select_1se, "quantile": select_quantile}[rule](results, column)


def chosen(results: DataFrame, measure: str = "stability", rule: str = "1se", not_two: bool = False, k: int | None = None) -> Row:
    """The selected row itself; warns if the quantile rule had nothing to choose from."""
    column = resolve_measure(measure)
    row = select_row(results, measure, rule, not_two, k).first()
    if row is None:
        raise ValueError(f"no configuration has a value of {column}")
    if rule == "quantile" and f"{column}_upper" in results.columns:
        best = select_max(results if k is None else results.filter(F.col("n_clusters") == k), column).first()
        low, high = best[f"{column}_lower"], best[f"{column}_upper"]
        if low is None or high is None or low > high:
            warnings.warn("no configuration lies within the quantiles; using the best one", RuntimeWarning, stacklevel=2)
    return row


#: What the names of result columns that are no parameters begin with.
_RESULT = ("ari_", "consensus_", "accuracy_", "config_id", "estimator", "method_id")


def parameter_columns(columns: Iterable[str]) -> list[str]:
    """The columns of a result table that are parameters: all that are no identifiers and no metrics."""
    return [c for c in columns if c != "params" and not c.startswith(_RESULT)]


def hyper_params(row: Row) -> dict:
    """The parameters of a result row, whatever their names, that have a value; ``params`` adds those that have no column."""
    values = {c: row[c] for c in parameter_columns(row.__fields__)}
    if "params" in row.__fields__ and row["params"]:
        values.update(json.loads(row["params"]))
    return {k: v for k, v in values.items() if v is not None and v == v}


def metric_optimum(curve: DataFrame, by: list[str], value: str = "metric_value", k: str = "k") -> DataFrame:
    """Per group the k of the highest value; the smallest k on ties; a group without values keeps a null row."""
    own = Window.partitionBy(*by).orderBy(F.desc_nulls_last(value), F.col(k))
    return curve.withColumn("__rn", F.row_number().over(own)).filter("__rn = 1").drop("__rn").withColumn(k, F.when(F.col(value).isNotNull(), F.col(k)))
