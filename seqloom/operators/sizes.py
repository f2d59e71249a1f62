"""Sizes, ratios and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a sequence's own fields: its length and its number of blocks.
SEQUENCE_FIELDS = 16


def total(choice: DataFrame) -> DataFrame:
    """(n, blocks, total_bytes) of a sequence from its blocks."""
    return choice.agg(
        F.sum("n").cast("bigint").alias("n"), F.count("*").alias("blocks"), (F.sum("theoretical_bytes") + SEQUENCE_FIELDS).cast("bigint").alias("total_bytes")
    )


def ratios(n: Column, size: Column) -> dict[str, Column]:
    return {"bits_per_int": F.round(size * 8 / n, 6), "ratio": F.round(size / (n * 8), 6), "megabytes": F.round(size / 2**20, 6)}


def build_metrics(choice: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """Blocks, elements, exceptions and split points over all blocks; the average is 0 without a block."""
    rows = choice if exceptions is None else choice.join(exceptions.select("part", "highs"), "part")
    return rows.agg(
        F.count("*").alias("partitions"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("elements"),
        F.coalesce(F.sum("highs"), F.lit(0)).cast("bigint").alias("exceptions") if exceptions is not None else F.lit(0).cast("bigint").alias("exceptions"),
        F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("sum_split"), F.min("b").alias("min_split"), F.max("b").alias("max_split"),
        F.coalesce(F.round(F.avg("b"), 6), F.lit(0.0)).alias("avg_split"),
    )


def speedup(throughput: DataFrame) -> DataFrame:
    """(threads, avg_throughput, speedup, efficiency) from (dataset, threads, throughput): against one thread."""
    by = throughput.groupBy("threads").agg(F.avg("throughput").alias("avg_throughput"))
    one = by.where("threads = 1").select(F.col("avg_throughput").alias("_one"))
    return by.crossJoin(F.broadcast(one)).select(
        "threads", F.round("avg_throughput", 6).alias("avg_throughput"), F.round(F.col("avg_throughput") / F.col("_one"), 6).alias("speedup"),
        F.round(F.col("avg_throughput") / F.col("_one") / F.col("threads") * 100, 6).alias("efficiency"),
    )


def benchmark_means(results: DataFrame) -> DataFrame:
    """(compressor, partition_size, n_runs, ratio, speed) from rows (name, ratio, speed) whose name is dataset/compressor/size/mode; runs without random access and malformed names don't count."""
    parts = F.split("name", "/")
    rows = results.where((F.size(parts) >= 4) & ~F.contains(F.get(parts, F.lit(3)), F.lit("RA_Disabled"))).select(
        F.get(parts, 1).alias("compressor"), F.expr("try_cast(get(split(name, '/'), 2) as bigint)").alias("partition_size"), "ratio", "speed"
    )
    return rows.where("partition_size is not null").groupBy("compressor", "partition_size").agg(
        F.count("*").alias("n_runs"), F.round(F.avg("ratio"), 6).alias("ratio"), F.round(F.avg("speed"), 6).alias("speed")
    )
