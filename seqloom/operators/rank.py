"""Rank and select on bit sequences (part, pos, bit): ranks are exclusive, selects count from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranks(bits: DataFrame) -> DataFrame:
    """(part, pos, bit, rank1, rank0): ones and zeros before each place."""
    before = W.partitionBy("part").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    one = F.coalesce(F.sum("bit").over(before), F.lit(0)).cast("bigint")
    place = F.row_number().over(W.partitionBy("part").orderBy("pos")) - 1
    rows = bits.select("part", "pos", "bit", one.alias("rank1"), place.cast("bigint").alias("p"))
    return rows.select("part", "pos", "bit", "rank1", (F.col("p") - F.col("rank1")).alias("rank0"))


def rank_range(bits: DataFrame, start: int, end: int) -> DataFrame:
    """(part, ones, zeros) of places [start, end)."""
    if start > end:
        raise IndexError("range out of bounds")
    inside = (F.col("pos") >= start) & (F.col("pos") < end)
    ones = F.count_if(inside & (F.col("bit") == 1))
    return bits.groupBy("part").agg(ones.cast("bigint").alias("ones"), F.count_if(inside & (F.col("bit") == 0)).cast("bigint").alias("zeros"))


def select(bits: DataFrame, which: int) -> DataFrame:
    """(part, k, pos): where the k-th bit that is ``which`` stands."""
    k = F.row_number().over(W.partitionBy("part").orderBy("pos"))
    return bits.where(F.col("bit") == which).select("part", k.cast("bigint").alias("k"), "pos")


def cumulative_gap(bits: DataFrame) -> DataFrame:
    """(part, k, cumgap): ones before the k-th zero, which is what the first k unary codes add up to."""
    return select(bits, 0).select("part", "k", (F.col("pos") - (F.col("k") - 1)).cast("bigint").alias("cumgap"))


def unary_bits(encoded: DataFrame, way: int) -> DataFrame:
    """(part, pos, bit): the unary gap bits of a block, upward (1) or downward (-1) gaps, as rows."""
    size = F.greatest(F.col("gap") * way, F.lit(0))
    coded = encoded.where("gap is not null").select("part", "i", F.explode(F.concat(F.array_repeat(F.lit(1), size.cast("int")), F.array(F.lit(0)))).alias("bit"), size.alias("s"))
    before = F.row_number().over(W.partitionBy("part").orderBy("i", F.desc("bit")))
    return coded.select("part", (before - 1).cast("bigint").alias("pos"), F.col("bit").cast("bigint").alias("bit"))


def get(bits: DataFrame, pos: int, n: int) -> DataFrame:
    """(part, bit) at one place of vectors of n bits."""
    if not 0 <= pos < n:
        raise IndexError("place out of bounds")
    return bits.where(F.col("pos") == pos).select("part", "bit")


def set_bits(bits: DataFrame, start: int, value: int, width: int, n: int) -> DataFrame:
    """``bits`` with ``width`` places from ``start`` on set to the bits of ``value``, least significant first."""
    if not 0 <= width <= 64:
        raise ValueError("at most 64 bits at once")
    if start < 0 or start + width > n:
        raise IndexError("range out of bounds")
    if value >= 1 << 63:
        value -= 1 << 64
    inside = (F.col("pos") >= start) & (F.col("pos") < start + width)
    own = F.call_function("shiftrightunsigned", F.lit(value).cast("bigint"), F.greatest(F.col("pos") - start, F.lit(0)).cast("int")).bitwiseAND(F.lit(1))
    return bits.select("part", "pos", F.when(inside, own).otherwise(F.col("bit")).cast("bigint").alias("bit"))


def set_range(bits: DataFrame, start: int, end: int, bit: int, n: int) -> DataFrame:
    """``bits`` with places [start, end) set to ``bit``."""
    if not 0 <= start <= end <= n:
        raise IndexError("range out of bounds")
    inside = (F.col("pos") >= start) & (F.col("pos") < end)
    return bits.select("part", "pos", F.when(inside, F.lit(bit)).otherwise(F.col("bit")).cast("bigint").alias("bit"))


def from_packed(blocks: DataFrame, column: str, n: str) -> DataFrame:
    """(part, pos, bit) of a packed bit column; bits are numbered from the least significant of the first byte on. Rows carry a byte, never the vector."""
    place = F.sequence(F.lit(1), F.octet_length(column))
    numbers = F.transform(place, lambda i: F.conv(F.hex(F.substring(F.col(column), i, F.lit(1))), 16, 10).cast("int"))
    rows = blocks.where((F.col(n) > 0) & (F.octet_length(column) > 0)).select("part", F.col(n).alias("n"), F.posexplode(numbers).alias("at", "byte"))
    rows = rows.select("part", "n", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    pos, bit = (F.col("at") * 8 + F.col("k")).cast("bigint"), F.call_function("shiftright", F.col("byte"), F.col("k")).bitwiseAND(F.lit(1))
    return rows.select("part", pos.alias("pos"), bit.cast("bigint").alias("bit"), "n").where(F.col("pos") < F.col("n")).drop("n")


def pack(bits: DataFrame) -> DataFrame:
    """(part, n, bytes) of (part, pos, bit), places counting from 0 in each vector: what from_packed() reads."""
    byte = F.sum(F.call_function("shiftleft", F.col("bit").cast("int"), F.pmod("pos", F.lit(8)).cast("int"))).alias("byte")
    rows = bits.groupBy("part", F.floor(F.col("pos") / 8).alias("at")).agg(F.count("*").alias("c"), byte)
    made = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "byte"))), lambda x: F.lpad(F.hex(x["byte"]), 2, "0")), "")
    return rows.groupBy("part").agg(F.sum("c").alias("n"), F.unhex(made).alias("bytes"))
