"""WARC archives through a chunked record table.

A payload travels as rows (record id, chunk number, bytes), so no task holds a
whole record beyond the cell that it came from.  The writer streams the chunks
of one record after another into gzip members and keeps an incremental digest;
the reader streams members back through buffers of one chunk and yields chunk
rows, each with the digest of the payload up to its end.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kohesion.llm._store import new_path, parallelism, save

CHUNK = 64 * 1024
_DATE = "2000-01-01T00:00:00Z"
_URN = "urn:record:"
_MAX_HEADER = 1 << 20


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


# ---------------------------------------------------------------- records


def _bytes(payload_col: str) -> Column:
    """A text's own UTF-8 bytes, which are hashed and cut where they lie; null is empty."""
    return F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")


def record_types(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """(digest, refers_to) of the payloads of at least ``least`` bytes that several rows share; the largest id is the response."""
    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), _bytes(payload_col).alias("payload"))
    keyed = own.filter((F.octet_length("payload") >= least) & F.col("id").isNotNull()).select("id", F.sha1("payload").alias("digest"))
    return keyed.groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n")).filter("n > 1").select("digest", "response")


def chunk_table(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int, chunk: int) -> DataFrame:
    """One row per chunk, in record order inside each partition; a revisit has one chunk without bytes."""
    shared = save(record_types(pages, id_col, payload_col, least), "warc-shared")
    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), _bytes(payload_col).alias("payload"))
    own = own.select("*", F.sha1("payload").alias("own_digest"), F.octet_length("payload").cast("long").alias("bytes"))
    joined = own.join(shared, own["own_digest"] == shared["digest"], "left")
    revisit = F.col("response").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("response"))
    typed = joined.select(
        "id", "url", "bytes", F.col("own_digest").alias("digest"), F.when(revisit, F.col("response")).alias("refers_to"), F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload")
    )
    last = F.greatest(F.ceil(F.coalesce(F.octet_length("payload"), F.lit(0)) / chunk) - 1, F.lit(0)).cast("int")
    rows = typed.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return rows.select("id", "url", "bytes", "digest", "refers_to", "chunk", F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("data"))


def header(record_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 header block, up to and with its empty line."""
    clean = "".join(c for c in url or "" if c not in "\r\n")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <{_URN}{'' if record_id is None else record_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if refers_to is not None else size}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


class Writer:
    """Streams records into one archive; every record is a gzip member."""

    def __init__(self, sink):
        self.sink, self.left, self.expected, self.packer, self.digest, self.n = sink, 0, "", None, None, 0

    def begin(self, record_id, url, size, digest, refers_to) -> None:
        if self.packer:
            self.finish()
        self.packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.sink.write(self.packer.compress(header(record_id, url, size, digest, refers_to)))
        self.left, self.expected, self.digest = (0 if refers_to is not None else size), (None if refers_to is not None else digest), hashlib.sha1()
        self.n += 1

    def chunk(self, data: bytes) -> None:
        self.digest.update(data)
        self.left -= len(data)
        self.sink.write(self.packer.compress(data))

    def finish(self) -> None:
        if self.packer:
            if self.left or self.expected not in (None, self.digest.hexdigest()):
                raise ValueError("a record's chunks don't make up its payload")
            self.sink.write(self.packer.compress(b"\r\n\r\n") + self.packer.flush())
            self.packer = None


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, chunk: int = CHUNK) -> DataFrame:
    """Writes one archive per task below ``path`` and returns (file, records).

    A file gets its name when it is whole, so a repeated or lost task leaves no
    part of one; the table returned names the files that count.
    """

    def run(batches):
        task = TaskContext.get()
        files, folder = _filesystem(path)
        files.create_dir(folder, recursive=True)
        # A name of its own for every attempt: the listing that comes back decides.
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        target = posixpath.join(folder, name)
        records = 0
        with files.open_output_stream(target, compression=None, buffer_size=1 << 20) as sink:
            writer = Writer(sink)
            for batch in batches:
                cols = [batch.column(c) for c in batch.schema.names]
                for i in range(batch.num_rows):
                    number, data = cols[5][i].as_py(), cols[6][i].as_py()
                    if number == 0:
                        writer.begin(*(cols[j][i].as_py() for j in range(5)))
                    if data:
                        writer.chunk(data)
            writer.finish()
            records = writer.n
        if records:
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "records": [records]})
        else:
            files.delete_file(target)

    rows = chunk_table(pages, id_col, url_col, payload_col, least, chunk)
    return save(rows.mapInArrow(run, "file string, records long"), "warc-files")


# ---------------------------------------------------------------- reading


class _Members(io.RawIOBase):
    """The bytes of consecutive gzip members, by bounded reads."""

    def __init__(self, source, size: int):
        self.source, self.size, self.unpacker, self.rest, self.ready = source, size, None, b"", b""

    def read_some(self) -> bytes:
        while True:
            if self.unpacker is None:
                if not self.rest:
                    self.rest = self.source.read(self.size)
                if not self.rest:
                    return b""
                self.unpacker = zlib.decompressobj(31)
            packed = self.unpacker.unconsumed_tail or self.rest or self.source.read(self.size)
            self.rest = b""
            if not packed and not self.unpacker.eof:
                raise EOFError("an archive ends inside a record")
            out = self.unpacker.decompress(packed, self.size)
            if self.unpacker.eof:
                self.rest, self.unpacker = self.unpacker.unused_data, None
            if out:
                return out


def read_records(source, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, str, bool]]:
    """Yields (headers, chunk number, bytes, digest so far, whether it is the last) of each record, holding about two chunks."""
    members, held = _Members(source, chunk), b""

    def need(n: int) -> None:
        nonlocal held
        while len(held) < n:
            more = members.read_some()
            if not more:
                raise EOFError("an archive ends inside a record")
            held += more

    while True:
        if not held:
            held = members.read_some()
            if not held:
                return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if len(held) > _MAX_HEADER:
                raise ValueError("no end of a record's header")
            need(len(held) + 1)
        lines, held = held[:end].decode().split("\r\n"), held[end + 4 :]
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = {k: v for k, _, v in (line.partition(": ") for line in lines[1:])}
        left, number, digest = int(headers["Content-Length"]), 0, hashlib.sha1()
        while True:
            size = min(chunk, left)
            need(size)
            data, held = held[:size], held[size:]
            digest.update(data)
            left -= size
            yield headers, number, data, digest.hexdigest(), left == 0
            number += 1
            if not left:
                break
        need(4)
        if held[:4] != b"\r\n\r\n":
            raise ValueError("a record is longer than its length")
        held = held[4:]


def read_chunks(spark: SparkSession, listing: DataFrame, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunk table of the archives in ``listing(file)``.

    (id, type, url, refers_to, declared_digest, declared_bytes, chunk, data,
    n_bytes, digest, last); ``digest`` is the SHA-1 of the payload up to the
    chunk's end.  Without ``data`` the bytes are read and checked, not returned.
    """
    schema = "id long, type string, url string, refers_to long, declared_digest string, declared_bytes long, chunk int, data binary, n_bytes long, digest string, last boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def number(urn: str | None) -> int | None:
        digits = (urn or "").strip("<>").removeprefix(_URN)
        return int(digits) if digits else None

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                files, name = _filesystem(file)
                rows, held = [], 0
                with files.open_input_stream(name, compression=None, buffer_size=1 << 20) as source:
                    for h, i, piece, digest, last in read_records(source, chunk):
                        declared = h.get("WARC-Payload-Digest", "").partition(":")[2]
                        rows.append((number(h.get("WARC-Record-ID")), h.get("WARC-Type"), h.get("WARC-Target-URI"), number(h.get("WARC-Refers-To")), declared, int(h.get("X-Payload-Length", 0)), i, piece if data else None, len(piece), digest, last))
                        held += len(piece) if data else 100
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)

    return listing.select("file").repartition(parallelism(spark), "file").mapInArrow(run, schema)


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, chunk: int = CHUNK) -> DataFrame:
    """Writes ``pages`` as archives, reads them back, and returns a row per record from what was read.

    (id, payload_bytes, payload_digest, record_type, refers_to).  Null payloads
    are empty; a null id is archived as a response without an id.  Of equal
    payloads of at least ``least`` bytes the largest id is the response; rows
    that repeat that id are responses too.  An empty table gives no archive.
    """
    spark = pages.sparkSession
    listing = write_archives(pages, new_path(spark, "warc"), id_col, url_col, payload_col, least, chunk)
    last = read_chunks(spark, listing, chunk, data=False).filter("last")
    revisit = F.col("type") == "revisit"
    size = F.when(revisit, F.col("declared_bytes")).otherwise(F.col("chunk").cast("long") * chunk + F.col("n_bytes"))
    digest = F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest"))
    return last.select("id", size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
