"""Point, range and batch access with defined bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators import codec


def route(pos: Column, size: int) -> tuple[Column, Column]:
    """(block, place in the block)."""
    return F.floor(pos / size).cast("bigint"), F.pmod(pos, F.lit(size)).cast("bigint")


def point(encoded: DataFrame, pos: int, size: int) -> DataFrame:
    """(pos, value): decodes the one block that holds it; the filter on part prunes a stored table."""
    one = encoded.where(F.col("part") == pos // size)
    return codec.decode(one).where(F.col("i") == pos % size).select(F.lit(pos).cast("bigint").alias("pos"), "value")


def at(encoded: DataFrame, positions: DataFrame, size: int, n: int) -> DataFrame:
    """(pos, status, value) for (pos): status is ok or out_of_range."""
    part, i = route(F.col("pos"), size)
    inside = F.col("pos").between(0, n - 1)
    asked = positions.select("pos", F.when(inside, part).alias("part"), F.when(inside, i).alias("i"))
    wanted = encoded.join(asked.where("part is not null").select("part").distinct(), "part", "left_semi")
    found = asked.join(codec.decode(wanted), ["part", "i"], "left")
    return found.select("pos", F.when(F.col("part").isNull(), "out_of_range").otherwise("ok").alias("status"), "value")


def lookup(encoded: DataFrame, positions: DataFrame, size: int) -> DataFrame:
    """(pos, value) for every row of positions (pos), repeated ones too. Only blocks asked for are decoded."""
    part, i = route(F.col("pos"), size)
    asked = positions.select("pos", part.alias("part"), i.alias("i"))
    wanted = encoded.join(asked.select("part").distinct(), "part", "left_semi")
    return asked.join(codec.decode(wanted), ["part", "i"]).select("pos", "value")


def elements(encoded: DataFrame, start: int, count: int, n: int, size: int, buffer: int | None = None) -> DataFrame:
    """(pos, value) of [start, start + count) clamped to n. Nothing if count is 0 or start is past the end; a buffer that is too small is refused."""
    end = min(start + count, n)
    empty = count == 0 or start >= n
    if not empty and buffer is not None and buffer < count:
        raise ValueError("the buffer is smaller than the count")
    if empty:
        end = start
    some = encoded.where(F.col("part").between(start // size, max(start, end - 1) // size))
    pos = F.col("part") * size + F.col("i")
    return codec.decode(some).select(pos.alias("pos"), "value").where((F.col("pos") >= start) & (F.col("pos") < end))


def written(start: int, count: int, n: int) -> int:
    return max(0, min(count, n - start))


def between(encoded: DataFrame, start: int, end: int, n: int, size: int) -> DataFrame:
    """[start, end), not clamped: an empty range or one past the end is refused."""
    if start >= end or end > n:
        raise IndexError("range out of bounds")
    return elements(encoded, start, end - start, n, size)


def prefix(encoded: DataFrame, part: int, start: int, count: int) -> DataFrame:
    """(i, value) of a slice of one block, decoded from the block's beginning without any index."""
    some = encoded.where((F.col("part") == part) & (F.col("i") < start + count))
    return codec.decode(some).where(F.col("i") >= start).select("i", "value")
