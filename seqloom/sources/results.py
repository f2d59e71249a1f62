"""Benchmark results as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a result file that the report uses.
SCHEMA = "benchmarks array<struct<name:string,CompressionRatio:double,bytes_per_second:double>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, ratio, speed) of every benchmark in the JSON files of a folder: ratio in per cent, speed in MiB/s; those without a ratio are left out."""
    files = spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    rows = files.select(F.explode("benchmarks").alias("b"))
    return rows.where("b.CompressionRatio is not null").select("b.name", (F.col("b.CompressionRatio") * 100).alias("ratio"), (F.coalesce("b.bytes_per_second", F.lit(0.0)) / 2**20).alias("speed"))
