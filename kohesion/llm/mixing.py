"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated Poisson(r_s) times, where r_s is the target
number of rows of s divided by its present number.  The uniform variate behind
each count is a hash of the seed, the id and the row's place among equal ids,
so the draw depends on no partitioning and can be repeated.  The result is
dealt over all partitions by a hash of each copy and sorted by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohesion.llm._store import parallelism, save

#: md5 hexadecimal digits behind a uniform variate: 52 bits, exact in a double.
_DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from an md5 of the parts, joined by colons."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def poisson_table(rate: Column) -> Column:
    """P(N <= k) for k = 0, 1, ... far enough that the rest is below the grain of :func:`uniform`.

    Rates over 500 would underflow exp(-rate); callers split them.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    first = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), first, step)["cdf"]


def source_rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, alpha: float, total: float | None) -> DataFrame:
    """(source, n_rows, rate) over all rows.  Without ``weights`` a source weighs its row count to the power ``alpha``.

    Null is a source of its own.  Sources that ``weights`` doesn't name weigh 0.
    """
    counts = save(docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("source")).agg(F.count("*").alias("n_rows")), "mix-sources")
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n_rows").cast("double"), F.lit(float(alpha))))
    else:
        pairs = [x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))]
        given = F.create_map(*pairs)[F.col("source")] if pairs else F.lit(None)
        weighed = counts.withColumn("w", F.coalesce(given, F.lit(0.0)).cast("double"))
    sums = weighed.agg(F.sum("w").alias("w_all"), F.sum("n_rows").alias("n_all"))
    target = F.col("n_all").cast("double") if total is None else F.lit(float(total))
    rate = F.when(F.col("w_all") > 0, F.col("w") / F.col("w_all") * target / F.col("n_rows")).otherwise(F.lit(0.0))
    return weighed.crossJoin(F.broadcast(sums)).select("source", "n_rows", rate.alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    total: float | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """(row, copy, rate, order): the rows of ``docs``, each repeated by its Poisson count, shuffled; ``row`` has all columns, so no name can clash.

    ``total`` is the expected number of rows of the mix (default: as many as
    there are).  A row's variate hashes the seed and its id, so rows that share
    an id share their count; a null id counts as the text "null".  A null
    source is a source.  Texts aren't looked at, however long.  An empty table
    gives an empty mix.  Partitions and the rows inside go by ``order``.
    """
    rates = save(source_rates(docs, source_col, weights, alpha, total), "mix-rates")
    # Counts of up to 500 from one inversion; a larger rate is drawn as the sum of equal parts.
    parts = F.greatest(F.ceil(F.col("rate") / 500), F.lit(1)).cast("int")
    table = save(
        rates.withColumn("parts", parts).select(F.col("source").alias("of"), "rate", "parts", poisson_table(F.col("rate") / F.col("parts")).alias("cdf")),
        "mix-tables",
    )
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source_col}`").cast("string").alias("s"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("id")
    )
    drawn = own.join(table, F.col("s").eqNullSafe(F.col("of")))
    # One variate a part, made once; the count of a part is how many P(N <= k) don't exceed it.
    variates = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: uniform(F.lit(seed), F.col("id"), j))
    count = F.aggregate(F.transform(variates, lambda u: F.size(F.filter("cdf", lambda c: c <= u))), F.lit(0), lambda a, b: a + b)
    counted = drawn.withColumn("count", count).filter(F.col("count") > 0)
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), "id", F.col("copy").cast("string")))
    mixed = copies.select("row", "copy", "rate", order.alias("order"))
    # A hash is even, so its ranges are known without a pass over the rows.
    n = parallelism(docs.sparkSession)
    place = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * n).cast("int")
    return mixed.repartitionById(n, place).sortWithinPartitions("order")
