"""WARC archives: a writer, and a reader that splits gzip archives by byte ranges.

Writing: payloads that occur more than once, of at least ``min_revisit`` bytes, are stored once as a response; the others become revisit
records that name it. Every record is a gzip member of its own. Tasks write whole files under a temporary name in shared
storage and rename them, so that a task that runs twice leaves one file.

Reading: a task is given a range of bytes. It looks for the gzip magic inside, takes a place as a record's start only if what follows
inflates to a WARC header and is a whole member, and owns exactly the records that start inside its range, reading past the end to finish the last one.
Magic bytes inside compressed data fail that test, as do truncated members. Records that lie stored inside another record's payload pass it, though.
So ranges are searched first for where reading on from any place of theirs would leave them (``exits``), a row or two for each range; from the
beginning of a file these add up to where each range is really entered, and reading starts there. Archives read the same at every size of range.

Null payloads count as empty; equal payloads and repeated rows are distinct records; a null record id is written as such and read
back as null. Very long payloads are handled one at a time. Extra columns are not written. An empty table makes no archive and
reads back as an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import keep, scratch

MAGIC = b"\x1f\x8b\x08"
CRLF = b"\r\n"
HEAD_BYTES = 1 << 16
SPLIT_BYTES = 16 << 20
MOST_TASKS = 100_000
RECORD = (
    "record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long, "
    "payload binary, file string, at long"
)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def mark_revisits(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """(page_id, url, html as bytes, digest, first): first is the response's page_id where the payload is stored elsewhere.

    One partial aggregate by digest; only digests that occur twice are written and joined back, which moves no payload where Spark finds their table small. Where it
    is not, a digest with a third of all rows sits on the left side of an outer join, which Spark splits.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("key", F.unhex(F.sha2("html", 256)))
    groups = keep(
        rows.where(F.octet_length("html") >= min_revisit).groupBy("key")
        .agg(F.min("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("key", "response")
    )
    first = F.when(F.col("page_id") != F.col("response"), F.col("response"))
    return rows.join(groups, "key", "left").select("page_id", "url", "html", F.lower(F.hex("key")).alias("digest"), first.alias("first"))


def _member(kind: str, page_id: int | None, uri: str | None, payload: bytes, digest: str, size: int, refers: int | None, level: int) -> bytes:
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{uri}")
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(uri or '').translate({10: '%0A', 13: '%0D'})}", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers is not None:
        fields += [f"X-Refers-To-Page-Id: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    fields.append(f"Content-Length: {len(payload)}")
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = CRLF.join(f.encode() for f in fields) + CRLF + CRLF
    return pack.compress(head) + pack.compress(payload + CRLF + CRLF) + pack.flush()


def write(marked: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes rows as from mark_revisits() to ``folder``; returns (file, bytes, records), one row per archive, already run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, n, fs = TaskContext.get(), None, 0, None
        for batch in batches:
            for page, uri, html, digest, first in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    fs, base = open_fs(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"{base}/part-{context.partitionId():06d}.warc.gz"
                    temporary = f"{base}/_{uuid.uuid4().hex}.tmp"
                    out = fs.open_output_stream(temporary, buffer_size=1 << 20)
                payload, first, digest = html.as_py(), first.as_py(), digest.as_py()
                kind, body = ("response", payload) if first is None else ("revisit", b"")
                out.write(_member(kind, page.as_py(), uri.as_py(), body, digest, len(payload), first, level))
                n += 1
        if out is not None:
            out.close()
            fs.move(temporary, name)
            size = fs.get_file_info(name).size
            path = f"{folder.rstrip('/')}/{name.rpartition('/')[2]}"
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([n])], names=["file", "bytes", "records"])

    return keep(marked.select("page_id", "url", "html", "digest", "first").mapInArrow(run, "file string, bytes long, records long"))


def _inflate(file: pa.NativeFile, at: int, enough: int | None = None, chunk: int = 1 << 16) -> tuple[bytes, int] | None:
    """What the gzip member at ``at`` holds, or its first ``enough`` bytes, and where reading ended; None if it isn't a whole member."""
    unpack, out, size = zlib.decompressobj(31), [], 0
    while not unpack.eof and (enough is None or size < enough):
        data = file.read_at(chunk, at)
        if not data:
            return None
        at += len(data)
        try:
            out.append(unpack.decompress(data, 0 if enough is None else enough))
        except zlib.error:
            return None
        size += len(out[-1])
        if enough is not None and not unpack.eof and size == 0:
            continue
        chunk = min(2 * chunk, 1 << 22)
    return b"".join(out), at - len(unpack.unused_data)


def parse(member: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (names in lower case) and block of one record; None if it isn't a WARC record."""
    if not member.startswith(b"WARC/1."):
        return None
    head, sep, rest = member.partition(CRLF + CRLF)
    if not sep:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    size = int(fields.get("content-length", -1))
    return (fields, rest[:size]) if 0 <= size <= len(rest) else None


def _magics(file: pa.NativeFile, start: int, stop: int, window: int) -> Iterator[int]:
    """Places of the gzip magic in [start, stop); after one, a place to go on from may be sent, and what lies before it isn't read."""
    at = start
    while at < stop:
        data = file.read_at(min(window, stop - at) + len(MAGIC) - 1, at)
        found = data.find(MAGIC)
        while found >= 0 and at + found < stop:
            on = yield at + found
            after = max(found + 1, (on or 0) - at)
            found = data.find(MAGIC, after) if after < len(data) else -1
            if after > window:
                break
        else:
            after = window
        at += max(after, window)


def _record(file: pa.NativeFile, place: int) -> tuple[dict[str, str], bytes, int] | None:
    """(fields, block, end) of the record whose member starts at ``place``."""
    head = _inflate(file, place, 7, 256)
    if head is None or not head[0].startswith(b"WARC/1."):
        return None
    whole = _inflate(file, place)
    record = whole and parse(whole[0])
    return (*record, whole[1]) if record else None


def records_in(file: pa.NativeFile, size: int, start: int, stop: int, window: int = 1 << 22) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records that reading on from ``start`` meets before ``stop``, with where they start; what a record holds is not searched."""
    places = _magics(file, start, min(stop, size), window)
    place = next(places, None)
    while place is not None:
        record = _record(file, place)
        if record:
            yield place, *record[:2]
        try:
            place = places.send(record[2] if record else None)
        except StopIteration:
            return


def exits(file: pa.NativeFile, size: int, start: int, stop: int, window: int = 1 << 22) -> list[tuple[int, int]]:
    """(last, exit), ascending: reading on from any place up to ``last``, after the one before, leaves [start, stop) at ``exit``."""
    stop = min(stop, size)
    found = [(p, r[2]) for p in _magics(file, start, stop, window) if (r := _record(file, p))]
    out: list[tuple[int, int]] = [(stop, stop)]
    leave: list[int] = []
    places = [p for p, _ in found]
    for place, end in reversed(found):
        after = len(places) - bisect_left(places, end)  # records from the next one met to the last
        leave.append(end if end >= stop else leave[after - 1] if after else stop)
        if leave[-1] == out[-1][1]:
            continue
        out.append((place, leave[-1]))
    return out[::-1]


def _rows_in(fs: pafs.FileSystem, path: str, shown: str, size: int, start: int, stop: int, payload: bool) -> Iterator[tuple]:
    number = lambda x: int(x) if x else None
    with fs.open_input_file(path) as file:
        for at, fields, block in records_in(file, size, start, stop):
            kind = fields.get("warc-type")
            if kind == "revisit":
                length, digest = number(fields.get("x-payload-length")), fields.get("warc-payload-digest", "").rpartition(":")[2]
            else:
                length, digest = len(block), hashlib.sha256(block).hexdigest()
            refers = number(fields.get("x-refers-to-page-id"))
            yield kind, number(fields.get("x-page-id")), fields.get("warc-target-uri"), length, digest, refers, block if payload else None, shown, at


def entries(starts: list[int], last: list[list[int]], leaves: list[list[int]], split_bytes: int) -> list[int]:
    """Where each range of a file is entered, given its ``exits``; at or after its end if a record covers all of it."""
    at, out = 0, []
    for start, places, leave in zip(starts, last, leaves):
        out.append(max(at, start))
        if out[-1] < start + split_bytes:
            at = leave[bisect_left(places, out[-1])]
    return out


def _entered(ranges: DataFrame, split_bytes: int) -> DataFrame:
    """(file, bytes, start, entry): where reading from the beginning of the file enters each range; a row for each range goes to one task a file."""

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shown, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = open_fs(shown)
                with fs.open_input_file(path) as file:
                    out.append(exits(file, size, start, start + split_bytes))
            last = pa.array([[x for x, _ in o] for o in out], pa.list_(pa.int64()))
            leaves = pa.array([[x for _, x in o] for o in out], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, last, leaves], names=[*batch.schema.names, "last", "leaves"])

    def follow(group: pa.Table) -> pa.Table:
        group = group.sort_by("start")
        found = entries(*(group.column(c).to_pylist() for c in ("start", "last", "leaves")), split_bytes)
        return group.select(["file", "bytes", "start"]).append_column("entry", pa.array(found, pa.int64()))

    found = keep(ranges.mapInArrow(leave, "file string, bytes long, start long, last array<long>, leaves array<long>"))
    return found.groupBy("file").applyInArrow(follow, "file string, bytes long, start long, entry long")


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Records of the archives in ``files`` (file, bytes), read by ranges of ``split_bytes``."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    tasks = files.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(0)).alias("n")).first()["n"]
    # a given number isn't coalesced: the rows are small, the ranges aren't
    spread = lambda df: df.repartition(max(1, min(int(tasks), MOST_TASKS)), "file", "start")
    entered = _entered(spread(files.select("file", "bytes", F.explode(starts).alias("start"))), split_bytes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for f in frames:
            for shown, size, start, entry in f.itertuples(index=False):
                fs, path = open_fs(shown)
                rows, held = [], 0
                for row in _rows_in(fs, path, shown, size, entry, start + split_bytes, payload):
                    rows.append(row)
                    held += len(row[6] or b"") + 200
                    if held > 16 << 20:
                        yield _frame(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    return spread(entered).mapInPandas(run, RECORD)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=names)
    return f.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def list_archives(spark: SparkSession, folder: str, glob: str = "*.warc.gz") -> DataFrame:
    """(file, bytes) of the archives in a folder, from file metadata only."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def round_trip(pages: DataFrame, folder: str | None = None, min_revisit: int = 100, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Writes ``pages`` as archives (to shared scratch space unless told where) and reads them back."""
    folder = folder or scratch(pages.sparkSession)
    return read(write(mark_revisits(pages, min_revisit), folder), split_bytes, payload)
