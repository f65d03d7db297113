import gzip
import hashlib
import io
import random
from pathlib import Path

import pytest
from kohesion.llm import warc
from kohesion.llm._store import new_path
from pyspark.sql import types as T


def pages(spark, rows, extra=()):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), *[T.StructField(c, T.StringType()) for c in extra]])
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)


def brute(rows):
    top = {}
    for i, _, html in rows:
        if i is not None:
            top[html or ""] = max(i, top.get(html or "", i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = i is not None and len(data) >= 1000 and i != top[html or ""]
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[html or ""] if again else None))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(0)
    big = "é<p>" * 400
    rows = [(i, f"http://h/{i}", "".join(rnd.choice("ab\r\né🙂") for _ in range(rnd.choice([0, 10, 999, 1000, 5000])))) for i in range(60)]
    rows += [(100 + i, "u\r\nWARC-Type: evil", big) for i in range(30)] + [(200, None, None), (201, "", ""), (None, "u", big), (None, "u", None), (129, "u", big)]
    rows += [(300, "u", "WARC/1.1\r\n\r\n\r\n" * 200), (301, "u", "x" * 300_000), (302, "u", "x" * 300_000)]
    return rows


@pytest.mark.parametrize("chunk", [1, 777, warc.CHUNK])
def test_round_trip_matches_brute_force(spark, clashing, chunk):
    rows = corpus() if chunk > 1 else corpus()[:40]
    got = warc.archive_round_trip(pages(spark, rows, clashing), chunk=chunk).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_archives_are_plain_warc(spark):
    rows = corpus()
    path = new_path(spark, "warc-test")
    listing = warc.write_archives(pages(spark, rows), path)
    assert sum(r["records"] for r in listing.collect()) == len(rows)
    seen = 0
    for f in listing.collect():
        data = gzip.decompress(Path(f["file"].removeprefix("file://")).read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            size = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            data = rest[size + 4 :]
            seen += 1
    assert seen == len(rows)


def test_chunk_rows_hold_the_payload_and_running_digests(spark):
    rows = [(1, "u", "a" * 2500), (2, "v", "")]
    listing = warc.write_archives(pages(spark, rows), new_path(spark, "warc-test"))
    got = sorted(warc.read_chunks(spark, listing, 1000).collect(), key=lambda r: (r["id"], r["chunk"]))
    assert [(r["id"], r["chunk"], len(r["data"]), r["last"]) for r in got] == [(1, 0, 1000, False), (1, 1, 1000, False), (1, 2, 500, True), (2, 0, 0, True)]
    assert [r["digest"] for r in got[:3]] == [hashlib.sha1(b"a" * n).hexdigest() for n in (1000, 2000, 2500)]
    assert b"".join(r["data"] for r in got[:3]) == b"a" * 2500


def test_broken_archives_are_told():
    whole = gzip.compress(warc.header(1, "u", 5, "d", None) + b"hello\r\n\r\n")
    assert [r[2] for r in warc.read_records(io.BytesIO(whole + whole), 3)] == [b"hel", b"lo"] * 2
    for broken in (whole[:-12], gzip.compress(b"nonsense\r\n\r\n"), gzip.compress(warc.header(1, "u", 4, "d", None) + b"hello\r\n\r\n")):
        with pytest.raises((EOFError, ValueError)):
            list(warc.read_records(io.BytesIO(broken), 3))
    writer = warc.Writer(io.BytesIO())
    writer.begin(1, "u", 5, hashlib.sha1(b"hello").hexdigest(), None)
    writer.chunk(b"hellO")
    with pytest.raises(ValueError):
        writer.finish()


def test_empty_table(spark):
    assert warc.archive_round_trip(pages(spark, [])).count() == 0
