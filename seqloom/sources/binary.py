"""Raw little-endian integer files and generated test sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.runtime import ship

#: Integer types of raw files by name.
TYPES = {"int8": "<i1", "uint8": "<u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "int64": "<i8", "uint64": "<u8"}
#: File systems that Python reads by itself; of others, Spark hands over whole files.
RANGED = ("file", "hdfs", "s3", "gs")
PIECE_BYTES = 8 << 20
HEAD_BYTES = 16
MOST_TASKS = 100_000
Layout = Callable[[bytes, int], tuple[int, int]]


def _files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def read(spark: SparkSession, path: str, kind: str = "int64", first_is_size: bool = True, max_size: int | None = None, glob: str | None = None) -> DataFrame:
    """(file, pos, value) of raw files, each with or without a leading 8-byte count; ``max_size`` keeps the first elements of each.

    Files are read by ranges of bytes, none beyond what is kept.
    """
    dtype = np.dtype(TYPES[kind])
    skip = 8 if first_is_size else 0

    def layout(head: bytes, length: int) -> tuple[int, int]:
        room = max(0, length - skip) // dtype.itemsize
        n = min(int.from_bytes(head[:8], "little"), room) if first_is_size else room
        return skip, n if max_size is None else min(n, max_size)

    return _decode(_files(spark, path, glob), dtype, layout, False)


def read_dataset(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, pos, value, decimals) of int64 files with a header told by the file's size: count and decimals, or count alone."""

    def layout(head: bytes, length: int) -> tuple[int, int]:
        n = int.from_bytes(head[:8], "little") if length >= 8 else 0
        return (16, n) if length == 16 + 8 * n else (8, min(n, max(0, length - 8) // 8))

    return _decode(_files(spark, path, glob), np.dtype("<i8"), layout, True)


def _open(path: str) -> pa.NativeFile:
    """A file by the path that Spark gives, in which nothing is quoted."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    fs, inner = pafs.FileSystem.from_uri(quote(path, safe=":/@"))
    return fs.open_input_file(inner)


def _heads(found: DataFrame, layout: Layout) -> DataFrame:
    """(file, skip, n, scale) from the first bytes of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(name) as f:
                    head = f.read_at(min(HEAD_BYTES, length), 0)
                skip, n = layout(head, length)
                rows.append((skip, n, int.from_bytes(head[8:16], "little", signed=True) if skip == 16 else 0))
            made = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["file", "skip", "n", "scale"])

    return found.select("path", "length").mapInArrow(run, "file string, skip long, n long, scale long")


def _piece(name: str, data: bytes, dtype: np.dtype, first: int, scale: int | None) -> pa.RecordBatch:
    v = np.frombuffer(data, dtype)
    values = pa.array(v).cast(pa.decimal128(20, 0)) if dtype == np.dtype("<u8") else pa.array(v.astype(np.int64))
    columns = {"file": pa.array([name] * len(v)), "pos": pa.array(np.arange(first, first + len(v))), "value": values}
    if scale is not None:
        columns["decimals"] = pa.array(np.full(len(v), scale))
    return pa.RecordBatch.from_pydict(columns)


def _decode(files: DataFrame, dtype: np.dtype, layout: Layout, decimals: bool) -> DataFrame:
    ship(files.sparkSession)
    kind = "decimal(20,0)" if dtype == np.dtype("<u8") else "bigint"
    schema = f"file string, pos long, value {kind}" + (", decimals long" if decimals else "")
    step = PIECE_BYTES // dtype.itemsize

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(data.as_buffer())
                skip, n = layout(bytes(data[:HEAD_BYTES]), len(data))
                scale = int.from_bytes(data[8:16], "little", signed=True) if skip == 16 else 0
                for i in range(0, n, step):
                    at = skip + i * dtype.itemsize
                    yield _piece(name, data[at : at + min(step, n - i) * dtype.itemsize], dtype, i, scale if decimals else None)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, skip, n, scale, i in zip(*(c.to_pylist() for c in batch.columns)):
                with _open(name) as f:
                    data = f.read_at(min(step, n - i) * dtype.itemsize, skip + i * dtype.itemsize)
                yield _piece(name, data, dtype, i, scale if decimals else None)

    schemes = [r["s"] for r in files.select(F.regexp_extract("path", "^([a-z0-9]+):", 1).alias("s")).distinct().collect()]
    if not set(schemes) <= set(RANGED):
        return files.select("path", "content").mapInArrow(whole, schema)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("i")
    ranges = _heads(files, layout).where("n > 0").select("file", "skip", "n", "scale", starts)
    tasks = files.agg(F.sum(F.ceil(F.col("length") / PIECE_BYTES)).alias("n")).first()["n"] or 1
    return ranges.repartition(max(1, min(int(tasks), MOST_TASKS)), "file", "i").mapInArrow(pieces, schema)


def write(values: np.ndarray, path: str, decimals: int | None = None) -> None:
    """A raw int64 file with its header; for fixtures."""
    head = [len(values)] if decimals is None else [len(values), decimals]
    fs, path = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(np.array(head, "<u8").tobytes() + values.astype("<i8").tobytes())


def drift(spark: SparkSession, n: int) -> DataFrame:
    """A walk by 0, 1 and -1 in which every 13th value is 42; a function of the position, so the same anywhere."""
    walk = F.floor(F.col("id") / 3) - 2 * F.floor(F.col("id") / 7)
    return spark.range(n).select(F.col("id").alias("pos"), F.when(F.col("id") % 13 == 0, 42).otherwise(walk).cast("bigint").alias("value"))


def random_runs(spark: SparkSession, n: int, low: int, high: int, duplicates: float = 0.0, longest: int = 1, seed: int = 42) -> DataFrame:
    """Uniform values of which about a share ``duplicates`` repeats the one before, in runs up to ``longest``; from digests of the position and the seed."""
    digest = lambda key, salt: F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(str(salt)))), 1, 7)
    uniform = lambda key, salt: F.conv(digest(key, salt), 16, 10).cast("double") / float(1 << 28)
    head: Column = F.col("id")
    for back in range(longest - 1):
        again = (head > 0) & (uniform(head, 1) < duplicates) & (F.col("id") - head == back)
        head = F.when(again, head - 1).otherwise(head)
    return spark.range(n).select(F.col("id").alias("pos"), (F.floor(uniform(head, 2) * (high - low + 1)) + low).cast("bigint").alias("value"))
