"""Ordered sequences, and the blocks they are cut into.

A sequence is a DataFrame of (pos, value), pos counting from 0 without gaps. Blocks hold ``size`` consecutive elements and are the unit of distribution: one
shuffle brings a block's elements together, and every window, aggregate and choice after that is by block and reuses that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import bitmath as bm
from seqloom.functions.runtime import scratch

DEFAULT_SIZE = 32000


def sequence(df: DataFrame, pos: Column, value: Column) -> DataFrame:
    """(pos, value) from a column that already counts 0, 1, 2, ...; null values are refused."""
    checked = F.when(value.isNull(), F.raise_error(F.lit("a sequence holds no nulls"))).otherwise(value)
    return df.select(pos.cast("bigint").alias("pos"), checked.alias("value"))


def scaled(value: Column, decimals: int) -> Column:
    """A decimal or floating number as an integer of 10**-decimals."""
    return F.round(value * 10**decimals).cast("bigint")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with pos, the rank of each row by ``order``, written once.

    Rows are ranged over partitions by all of ``order`` and numbered within them; counts of the partitions before are added. A value of the first column that
    a third of all rows share is cut by the next column, and no window runs over all rows. Rows equal in all of ``order`` come in any order.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    path = scratch(spark)
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    rows = rows.withColumn("_p", F.shiftright("_id", 33)).withColumn("_k", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(offsets, "_p").withColumn("pos", (F.col("_offset") + F.col("_k")).cast("bigint")).drop("_id", "_p", "_k", "_offset")


def stats(seq: DataFrame, size: int = DEFAULT_SIZE) -> DataFrame:
    """(part, n, base, max, total_bits): one partial aggregate by block."""
    part = F.expr(f"pos div {size}").alias("part")
    g = seq.groupBy(part).agg(F.count("*").alias("n"), F.min("value").alias("base"), F.max("value").alias("max"))
    return g.withColumn("total_bits", bm.total_bits(F.col("base"), F.col("max")).cast("bigint"))


def frame(seq: DataFrame, size: int = DEFAULT_SIZE) -> DataFrame:
    """(part, pos, i, value, n, base, max, total_bits, x, prev): x is above the block's minimum, prev the x before, 0 at first.

    One exchange and one sort serve all of it.
    """
    return framed(seq.withColumn("part", F.expr(f"pos div {size}")).withColumn("i", F.expr(f"pos % {size}")))


#: Positions that are ordered together, and elements of one task, where a sequence is cut into blocks of several sizes.
CHUNK = 1 << 14
TASK_ELEMENTS = 1 << 19


def frames(seq: DataFrame, sizes: list[int]) -> DataFrame:
    """The frames of several block sizes at once; part is the size's place in ``sizes`` times 2**40, plus the block. _up and _down are a block's variation.

    Elements are exchanged and sorted once, not once for each size: by chunks of positions, in as many tasks as their number asks for, so that what a task
    holds does not grow with the sequence. Each element meets its blocks in a table of the blocks of every chunk; the last element of a chunk is sent to the
    next as well, as its first one's predecessor. Rows are not partitioned by part: aggregates by block are partial before their exchange.
    """
    tasks = max(seq.sparkSession.sparkContext.defaultParallelism, -(-seq.count() // TASK_ELEMENTS))
    chunk = F.expr(f"pos div {CHUNK}")
    rows = seq.select("pos", "value", chunk.alias("_chunk"))
    lasts = rows.groupBy("_chunk").agg(F.max("pos").alias("pos"), F.max_by("value", "pos").alias("value"))
    lasts = lasts.withColumn("_chunk", F.lead("_chunk").over(W.orderBy("_chunk"))).where("_chunk is not null")  # a row for each chunk
    order = W.partitionBy("_chunk").orderBy("pos")
    rows = rows.unionByName(lasts).repartition(tasks, "_chunk")
    rows = rows.select("*", F.lag("pos").over(order).alias("_at"), F.lag("value").over(order).alias("before")).where(chunk == F.col("_chunk"))

    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).cast("bigint").alias("n")) for k, n in enumerate(sizes)))).alias("_s")
    block = F.expr("pos div _s.n")
    before = F.when(F.expr("_at div _s.n") == block, F.col("before")).alias("before")  # null for the first of a block
    cut = rows.select("*", each).select("pos", "value", before, F.col("_s.k").alias("k"), block.alias("block"))
    step = (F.col("value") - F.col("before")).cast("bigint")
    totals = cut.groupBy("k", "block").agg(
        F.count("*").alias("n"), F.min("value").alias("base"), F.max("value").alias("max"), F.max(F.when(F.col("before").isNull(), F.col("value"))).alias("first"),
        F.sum(F.greatest(step, F.lit(0))).alias("up"), F.sum(F.greatest(-step, F.lit(0))).alias("down"), F.min("pos").alias("from"), F.max("pos").alias("to"),
    )
    many = F.col("n") >= 2
    facts = F.struct(
        "n", "base", "max", bm.total_bits(F.col("base"), F.col("max")).cast("bigint").alias("total_bits"),
        F.when(many, F.col("up") + (F.col("first") - F.col("base")).cast("bigint")).otherwise(0).alias("_up"), F.when(many, F.col("down")).otherwise(0).alias("_down"),
    )
    table = totals.select("k", F.struct("block", facts).alias("entry"), F.explode(F.expr(f"sequence(from div {CHUNK}, to div {CHUNK})")).alias("_chunk"))
    entries = (F.map_from_entries(F.collect_list(F.when(F.col("k") == k, F.col("entry")))) for k in range(len(sizes)))
    table = table.repartition(tasks, "_chunk").groupBy("_chunk").agg(F.array(*entries).alias("_blocks"))
    rows = rows.join(table.hint("merge"), "_chunk").select("*", each)
    facts = F.get("_blocks", F.col("_s.k"))[block].alias("facts")
    part = F.col("_s.k").cast("bigint") * (1 << 40) + block
    rows = rows.select(part.alias("part"), "pos", F.expr("pos % _s.n").alias("i"), "value", before, facts)
    return _above(rows.select("*", "facts.*"), "total_bits", "_up", "_down")


def framed(rows: DataFrame) -> DataFrame:
    """A frame of (part, pos, i, value)."""
    block, order = W.partitionBy("part"), W.partitionBy("part").orderBy("pos")
    rows = rows.select(
        "part", "pos", "i", "value", F.count("*").over(block).alias("n"), F.min("value").over(block).alias("base"),
        F.max("value").over(block).alias("max"), F.lag("value").over(order).alias("before"),
    )
    return _above(rows, bm.total_bits(F.col("base"), F.col("max")).cast("bigint").alias("total_bits"))


def _above(rows: DataFrame, bits: Column | str, *more: str) -> DataFrame:
    """A frame from each element's block and the value before it in its block."""
    x = (F.col("value") - F.col("base")).cast("bigint")
    prev = F.coalesce(F.col("before") - F.col("base"), F.lit(0)).cast("bigint")
    return rows.select("part", "pos", "i", "value", "n", "base", "max", bits, x.alias("x"), prev.alias("prev"), *more)
