"""Packed blocks as a Parquet table whose properties say how to read it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import packed
from seqloom.operators.blocks import DEFAULT_SIZE


def save(seq: DataFrame, path: str, variant: str = "bstar", size: int = DEFAULT_SIZE, mode: str = "error", strategy: str = "optimal") -> None:
    """Encodes (pos, value) and writes block rows, sorted by part within files so that a point or range reads few of them."""
    rows = packed.encode(seq, variant, size, strategy).sortWithinPartitions("part")
    told = [F.lit(variant).alias("variant"), F.lit(size).cast("bigint").alias("size"), F.lit(packed.is_unsigned(seq)).alias("unsigned")]
    rows.select("*", *told).write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, str, int]:
    """(block rows, variant, block size)."""
    rows = spark.read.parquet(path)
    head = rows.select("variant", "size").first()
    variant, size = (head["variant"], head["size"]) if head else ("bstar", DEFAULT_SIZE)
    return rows.select(*packed.NAMES), variant, size


def is_unsigned(spark: SparkSession, path: str) -> bool:
    head = spark.read.parquet(path).select("unsigned").first()
    return bool(head and head["unsigned"])


def read(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """(pos, value) of [start, end); the filter on part reaches the scan."""
    rows, variant, size = load(spark, path)
    rows = rows.where(F.col("part") >= start // size)
    if end is not None:
        rows = rows.where(F.col("part") <= max(0, end - 1) // size)
    out = packed.decode(rows, variant, size, is_unsigned(spark, path)).where(F.col("pos") >= start)
    return out if end is None else out.where(F.col("pos") < end)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(n, blocks, empty, split_point) of a stored sequence; a sequence in blocks has no split point of its own, which is 0."""
    rows = spark.read.parquet(path).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), F.count("*").alias("blocks"))
    return rows.select("n", "blocks", (F.col("n") == 0).alias("empty"), F.lit(0).alias("split_point"))
