"""Token ids as Parquet list columns.

Documents are dealt by ranges of their id, encoded, and written by Spark's own
Parquet writer, one file per range in ascending order: ids as a list column
with dictionary or delta encoding, row groups and pages of a set size, and page
indexes, so a reader can take single columns, id ranges or pages.  Offsets are
not stored but summed from the files' own counts.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kohesion.llm import _text
from kohesion.llm._store import new_path, parallelism

#: Bytes of word forms and ids that an encoder remembers.
REMEMBERED_BYTES = 32 << 20
#: Bytes of text that are encoded at once, unless one text is longer.
GROUP_BYTES = 2 << 20
#: Texts whose letters aren't folded: combining marks follow them, or special tokens may stand there.
_UNFOLDED = "<\\||[\u0300-\u036f]"
#: A mark at the end of a part, behind a letter that stays one letter in normal form; see :class:`Encoder`.
_MARKED = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff][.,]$"
ENCODINGS = ("dictionary", "delta")


class Encoder:
    """A tokenizer whose ids are remembered by word form.

    Only for tokenizers that compose, fold case and drop white space before
    they cut letters from other characters and merge: parts between ASCII white
    space are then encoded independently, and a text's ids are those of its
    parts in order.  A last full stop or comma is cut off if a letter of Latin-1
    stands before it; other letters may have marks in normal form, which join with it.

    Arrow cuts texts, numbers parts and looks them up, so Python sees the unknown
    ones only.  Remembered forms and ids are kept in arrays of bounded size; when
    they are full, those used last stay.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks = [np.asarray(self.tokenizer.encode(mark, add_special_tokens=False).ids, "<i4") for mark in ".,"]
        self.remembered = remembered
        self.forms = pa.array([], pa.string())
        self.sizes = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)
        self.used = np.zeros(0, np.int32)
        self.turn = 0

    def _learn(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each part, ids); runs of letters are encoded together and told apart by the vocabulary's word ends."""
        found: list[np.ndarray | None] = [None] * len(forms)
        letters = [i for i, w in enumerate(forms) if w.isalpha()]
        for start in range(0, len(letters), 512):
            part = letters[start : start + 512]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join([forms[i] for i in part])], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            # Each part has one end at least, so equal numbers mean one each.
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                for i, a, z in zip(part, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                    found[i] = ids[a:z]
        others = [i for i, ids in enumerate(found) if ids is None]
        for start in range(0, len(others), 512):
            part = others[start : start + 512]
            for i, one in zip(part, self.tokenizer.encode_batch_fast([forms[i] for i in part], add_special_tokens=False), strict=True):
                found[i] = np.asarray(one.ids, np.int32)
        return np.fromiter(map(len, found), np.int32, len(found)), np.concatenate(found) if found else np.zeros(0, np.int32)

    def _look_up(self, forms: pa.Array) -> np.ndarray:
        """Places of distinct parts among the remembered ones, after the unknown are learned."""
        self._forget()
        self.turn += 1
        place = pc.index_in(forms, value_set=self.forms)
        unknown = forms.filter(pc.is_null(place))
        place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).copy()
        place[place < 0] = len(self.forms) + np.arange(len(unknown))
        if len(unknown):
            sizes, ids = self._learn(unknown.to_pylist())
            self.forms = pa.concat_arrays([self.forms, unknown])
            self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
            self.used = np.concatenate([self.used, np.zeros(len(unknown), np.int32)])
        self.used[place] = self.turn
        return place

    def _forget(self) -> None:
        size = np.asarray(pc.binary_length(self.forms)).astype(np.int64) + 4 * self.sizes + 16
        if size.sum() <= self.remembered:
            return
        order = np.argsort(-self.used, kind="stable")
        keep = np.sort(order[np.cumsum(size[order]) <= self.remembered // 2])
        table = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int32)), pa.array(self.ids))
        self.ids = np.asarray(table.take(pa.array(keep)).flatten())
        self.forms, self.sizes, self.used = self.forms.take(pa.array(keep)), self.sizes[keep], self.used[keep]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of some texts, null as empty; ``end`` is put behind the ids of each."""
        texts = pc.fill_null(texts, "")
        folded = pc.if_else(pc.match_substring_regex(texts, _UNFOLDED), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(folded)
        bounds = np.asarray(split.offsets).astype(np.int64)
        numbered = split.flatten().dictionary_encode()
        parts, place = numbered.dictionary, np.asarray(numbered.indices)
        marked = pc.match_substring_regex(parts, _MARKED)
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(parts, 0, -1), parts).dictionary_encode()
        at = self._look_up(stems.dictionary)[np.asarray(stems.indices)]
        # Behind the remembered parts stand the two marks and the end, each an entry of its own.
        more = [*self.marks, np.asarray([] if end is None else [end], np.int32)]
        known = len(self.sizes)
        sizes = np.concatenate([self.sizes, [len(m) for m in more]]).astype(np.int64)
        table = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([self.ids, *more])))
        marked = marked.to_numpy(zero_copy_only=False)
        mark = known + pc.ends_with(parts, ",").to_numpy(zero_copy_only=False).astype(np.int64)
        two = marked[place]
        entries = np.repeat(at[place], 1 + two)
        after = np.concatenate([[0], np.cumsum(1 + two)])
        entries[after[1:][two] - 1] = mark[place[two]]
        bounds = after[bounds - bounds[0]]
        entries = np.insert(entries, bounds[1:], known + 2)
        total = np.concatenate([[0], np.cumsum(sizes[entries])])
        return total[bounds + np.arange(len(bounds))], np.asarray(table.take(pa.array(entries)).flatten())

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        offsets, ids = self.encode(pa.array(texts, pa.string()))
        return [ids[a:z].astype("<u4").tobytes() for a, z in itertools.pairwise(offsets.tolist())]


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file; it is kept from task to task."""
    return _text.kept(f"tokens {path}", lambda: Encoder(path))


def _groups(texts: pa.Array):
    """(first row, row after the last) of groups of texts of about ``GROUP_BYTES``."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= GROUP_BYTES:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def encode_batches(batches: Iterable[pa.RecordBatch], path: str, end_id: int):
    own = encoder(path)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for first, after in _groups(texts):
            offsets, values = own.encode(texts.slice(first, after - first), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([ids.slice(first, after - first), pa.array(np.diff(offsets)), lists], ["doc_id", "n_tokens", "ids"])


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes (doc_id, n_tokens, ids) below ``path``, ascending by id over the files' names and rows.

    Null texts are empty and have the end id alone; null ids come first; rows
    that repeat an id are all written.  An empty table writes files without rows.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    dealt = own.repartitionByRange(parallelism(docs.sparkSession), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    encoded = dealt.mapInArrow(lambda batches: encode_batches(batches, vocabulary, end_id), "doc_id long, n_tokens long, ids array<int>")
    writer = encoded.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    if encoding == "delta":
        writer = writer.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "v2")
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids"), first: int | None = None, last: int | None = None) -> DataFrame:
    """Selected columns of the documents with ids from ``first`` to ``last``; row groups and pages outside are skipped."""
    table = spark.read.parquet(path)
    if first is not None:
        table = table.filter(F.col("doc_id") >= first)
    if last is not None:
        table = table.filter(F.col("doc_id") <= last)
    return table.select(*columns)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` counts the ids of all documents before it in file and row order;
    files go by their least ids.  The checksum is over the ids as little-endian
    unsigned 32-bit integers.  Spark reads the files, from any store it knows.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            raw = memoryview(np.ascontiguousarray(np.asarray(lists.values).astype("<i4", copy=False))).cast("B")
            offsets = np.asarray(lists.offsets).astype(np.int64)
            sums = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in itertools.pairwise(offsets.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets)), pa.array(sums, pa.int64())], ["doc_id", "file", "row", "n_tokens", "ids_crc32"])

    table = spark.read.parquet(path)
    place = (F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = table.select("doc_id", *place, "ids").mapInArrow(run, "doc_id long, file string, row long, n_tokens long, ids_crc32 long")
    # One row per file, from two columns of numbers; an id that goes on in the next file has the lesser name first.
    sizes = table.select("doc_id", "n_tokens", place[0]).groupBy("file").agg(F.sum("n_tokens").alias("size"), F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("least"))
    order = Window.orderBy("least", F.length("file"), "file")
    before = sizes.select(F.col("file").alias("name"), (F.sum("size").over(order) - F.col("size")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, F.col("file") == F.col("name")).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, vocabulary: str, end_id: int, **options) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and returns their index."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id, **options)
    return token_index(docs.sparkSession, path)
