"""Benchmark decontamination by size-partitioned MinHash containment search.

The search is for items of which a document holds at least ``threshold`` of the
distinct shingles, however long the document is.  A fixed-size MinHash of the
document would be filled by the rest of its text, so the items are sketched and
partitioned by shingle width and size class.  A class sets its sketches' length, a
few hashes more than what its largest item may lack (``q - ceil(threshold * q)`` of q),
and the number that a document has to meet, so documents below it are dropped
without loss, and the others are checked on the shingles themselves.

The items go to the workers in blocks of bounded size; a benchmark beyond one
block takes one pass over the documents for each.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohesion.llm import _text
from kohesion.llm._store import filter_batches, save

SHINGLE = 5
THRESHOLD = 0.8
#: Characters of item text that are sent to the workers at once.
BLOCK_CHARS = 16 << 20
_FILTER_BITS = 22


def item_shingles(text: str | None, k: int) -> tuple[int, set[bytes]]:
    """(words per shingle, distinct shingles): an item with fewer than ``k`` words is one shingle of all of them."""
    words = _text.split_words(text)
    width = min(k, len(words))
    return width, {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


def needed(size: int, threshold: float) -> int:
    """The least number of ``size`` shingles that makes up ``threshold`` of them."""
    return max(1, int(np.ceil(round(threshold * size, 9))))


@dataclass
class Partition:
    """The sketches of the items of one shingle width and size class.

    All have the class's length, or their whole set if it is shorter, and a text is a
    candidate if it meets ``least`` hashes of one.
    """

    width: int
    length: int
    least: int
    hashes: np.ndarray
    items: np.ndarray


@dataclass
class Index:
    #: Item id, words per shingle, distinct shingles, how often the item is there.
    items: list[tuple[int | None, int, set[bytes], int]]
    partitions: list[Partition]
    threshold: float


def build_index(items: list[tuple], k: int = SHINGLE, threshold: float = THRESHOLD, least_hits: int = 2) -> Index:
    """Sketches of the items (id, text[, times]), in partitions by shingle width and power of two of the number of shingles.

    A text with ``threshold`` of an item's shingles lacks at most so many of them.  A
    class's sketches are ``least_hits`` longer than what its largest item may lack, and
    its threshold is what the least favoured item still meets: no match is missed.
    """
    kept, classes = [], defaultdict(list)
    for item_id, text, *times in items:
        width, shingles = item_shingles(text, k)
        if not shingles:
            continue
        hashes = np.unique(_text.find_words([text or ""]).shingles(width)[0])
        missing = len(shingles) - needed(len(shingles), threshold)
        classes[width, len(shingles).bit_length()].append((len(kept), hashes, missing))
        kept.append((item_id, width, shingles, times[0] if times else 1))
    partitions = []
    for (width, _), rows in sorted(classes.items()):
        length = max(missing for _, _, missing in rows) + least_hits
        least = max(1, min(min(length, len(h)) - missing for _, h, missing in rows))
        hashes = np.concatenate([h[:length] for _, h, _ in rows])
        owner = np.repeat([i for i, _, _ in rows], [min(length, len(h)) for _, h, _ in rows])
        order = np.argsort(hashes)
        partitions.append(Partition(width, length, least, hashes[order], owner[order]))
    return Index(kept, partitions, threshold)


def candidates(index: Index, found: _text.Words) -> set[tuple[int, int]]:
    """(text, item) pairs whose sketch is met often enough."""
    out, words = set(), found.hashes()
    mask = np.uint64((1 << _FILTER_BITS) - 1)
    by_width = defaultdict(list)
    for p in index.partitions:
        by_width[p.width].append(p)
    for width, parts in by_width.items():
        hashes, doc = found.shingles(width, words)
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        for p in parts:
            maybe[p.hashes & mask] = True
        hit = maybe[hashes & mask]
        hashes, doc = hashes[hit], doc[hit]
        if not len(hashes):
            continue
        pairs = np.unique(np.rec.fromarrays([doc, hashes], names="doc,hash"))
        for p in parts:
            low, high = np.searchsorted(p.hashes, pairs.hash), np.searchsorted(p.hashes, pairs.hash, side="right")
            width_of = high - low
            if not width_of.any():
                continue
            at = np.repeat(low - np.cumsum(width_of) + width_of, width_of) + np.arange(width_of.sum())
            both, times = np.unique(np.stack([np.repeat(pairs.doc, width_of), p.items[at]]), axis=1, return_counts=True)
            enough = times >= p.least
            out.update(zip(both[0][enough].tolist(), both[1][enough].tolist(), strict=True))
    return out


def contained(index: Index, texts: list[str]) -> list[tuple[int, int, int]]:
    """(text, item, shared shingles) of each verified match."""
    todo = defaultdict(list)
    for t, i in candidates(index, _text.find_words(texts)):
        todo[t].append(i)
    out = []
    for t, items in sorted(todo.items()):
        words, sets = _text.split_words(texts[t]), {}
        for i in sorted(items):
            _, width, shingles, _ = index.items[i]
            if width not in sets:
                sets[width] = {b" ".join(words[j : j + width]) for j in range(len(words) - width + 1)}
            shared = len(shingles & sets[width])
            if shared >= needed(len(shingles), index.threshold):
                out.append((t, i, shared))
    return out


def _blocks(benchmark: DataFrame, id_col: str | None, text_col: str, block_chars: int) -> list[DataFrame]:
    """The distinct items (item_id, text, times) in blocks of at most ``block_chars`` characters and one item."""
    item_id = F.lit(None) if id_col is None else F.col(f"`{id_col}`")
    own = benchmark.select(item_id.cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).groupBy("item_id", "text").agg(F.count("*").alias("times"))
    own = save(own.withColumn("chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")), "benchmark-items")
    size = own.agg(F.sum("chars").alias("n")).first()["n"] or 0
    # Buckets of about a block by hash; inside, a block ends where the running sum passes its size.
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-size // block_chars))))
    before = F.sum("chars").over(Window.partitionBy("bucket").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars")
    dealt = save(own.withColumn("bucket", bucket).withColumn("block", F.floor(before / block_chars)), "benchmark-blocks")
    names = dealt.select("bucket", "block").distinct().orderBy("bucket", "block").collect()
    return [dealt.filter((F.col("bucket") == r["bucket"]) & (F.col("block") == r["block"])).select("item_id", "text", "times") for r in names]


def _collected(block: DataFrame, k: int, threshold: float) -> Index:
    return build_index([(r["item_id"], r["text"], r["times"]) for r in block.collect()], k, threshold)


def find_contained(
    docs: DataFrame,
    benchmark: DataFrame,
    k: int = SHINGLE,
    threshold: float = THRESHOLD,
    block_chars: int = BLOCK_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, shared, item_size, containment) of each document and item with enough in common.

    Words are runs outside white space with A-Z folded.  Null and empty texts
    match nothing; null ids are reported as null; repeated rows and items are
    reported each; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, shared long, item_size long, containment double"
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    results = []
    for block in _blocks(benchmark, id_col=item_id_col, text_col=item_text_col, block_chars=block_chars):
        sent = spark.sparkContext.broadcast(_collected(block, k, threshold))

        def run(batches, sent=sent):
            index = sent.value
            for batch in _text.pieces(batches):
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = []
                for first, part in _text.chunks(texts):
                    for t, i, shared in contained(index, part):
                        item_id, _, shingles, times = index.items[i]
                        rows += [(ids[first + t], item_id, shared, len(shingles), shared / len(shingles))] * times
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "shared", "item_size", "containment"])

        results.append(own.mapInArrow(run, schema))
    return reduce(DataFrame.union, results) if results else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item; columns are those of ``docs``.

    The decision is the row's own, so ids don't matter, and rows that repeat stay or
    go together.  Null and empty texts stay; very long texts are compared whole; an
    empty benchmark drops nothing and an empty table stays empty.
    """
    out = docs
    for block in _blocks(benchmark, None, item_text_col, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(_collected(block, k, threshold))

        def clean(texts, sent=sent):
            keep = np.ones(len(texts), bool)
            for first, part in _text.chunks(texts.cast(pa.string()).to_pylist()):
                for t, _, _ in contained(sent.value, part):
                    keep[first + t] = False
            return keep

        out = filter_batches(out, text_col, lambda clean=clean: clean)
    return out
