"""Line deduplication by site-relative frequency.

For each host, a line's frequency is the share of the host's pages that hold
it.  Lines above a ratio are boilerplate and go.  A host can have at most
(mean distinct lines a page) / ratio such lines, so the lines that go are few
and travel to the pages; the pages' lines never come back from an explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohesion.llm._store import save

# The HTML elements that begin a line of their own.
BLOCKS = (
    "address article aside blockquote body br caption dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "li main nav ol option p pre section table tbody td tfoot th thead title tr ul"
)
_CUT = rf"(?i)</?(?:{'|'.join(BLOCKS.split())})(?:[\s/][^>]*)?>|\n"
_TAG = "<[^>]*>"


def text_lines(text: Column) -> Column:
    """The lines of a text; null has one, an empty one."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def html_lines(html: Column) -> Column:
    """The texts between block-level tags and line ends, without other tags and empty ones; null has none."""
    parts = F.transform(F.split(F.coalesce(html.cast("string"), F.lit("")), _CUT, -1), lambda x: F.trim(F.regexp_replace(x, _TAG, "")))
    return F.filter(parts, lambda x: x != "")


def url_host(url: Column) -> Column:
    """The host of a URL in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url.cast("string"), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1)), F.lit(""))


def boilerplate(pages: DataFrame, host: Column, lines: Column, ratio: float, least: int, min_pages: int) -> DataFrame:
    """(host, lines): the lines in over ``ratio`` of a host's pages and at least ``least`` of them, for hosts of at least ``min_pages``."""
    base = pages.select(host.alias("host"), F.array_distinct(F.transform(lines, lambda x: F.trim(x))).alias("lines"))
    totals = save(pages.groupBy(host.alias("host")).agg(F.count("*").alias("n_pages")), "line-hosts")
    line = base.select("host", F.explode("lines").alias("line")).filter("line <> ''")
    # Two hashes stand for the line in the shuffle; the shortest text of a group stands for it afterwards.
    counts = line.groupBy("host", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")).agg(F.count("*").alias("n"), F.min("line").alias("line")).filter(F.col("n") >= least)
    often = (
        counts.join(totals, counts["host"].eqNullSafe(totals["host"]))
        .filter((F.col("n_pages") >= min_pages) & (F.col("n") > F.col("n_pages") * F.lit(float(ratio))))
        .select(totals["host"].alias("host"), "line")
    )
    return save(often.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines")), "line-boilerplate")


def drop_site_lines(pages: DataFrame, host: Column, lines: Column, ratio: float = 0.2, least: int = 2, min_pages: int = 10) -> DataFrame:
    """(row, host, clean, n_lines, n_dropped) of every page; ``row`` has all its columns, so no name can clash.

    ``lines`` makes a page's lines, as :func:`text_lines` and :func:`html_lines`
    do; ``clean`` joins those that stay by line ends.  A line goes if over
    ``ratio`` of its host's pages hold it, at least ``least`` do, and the host
    has at least ``min_pages`` pages.  Lines are compared without the spaces
    around them; empty lines stay.  Pages that repeat count each.  A null host
    is a host of its own; a null text has no words to lose; very long texts are
    cut whole; an empty table gives an empty result.
    """
    often = boilerplate(pages, host, lines, ratio, least, min_pages).toDF("often_host", "often")
    own = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), lines.alias("lines"))
    joined = own.join(often, F.col("host").eqNullSafe(F.col("often_host")), "left")
    kept = F.when(F.col("often").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("often"), F.trim(x))))
    return joined.select("row", "host", "lines", kept.alias("kept")).select(
        "row", "host", F.array_join("kept", "\n").alias("clean"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped")
    )
