"""Gap statistics of high parts, for one split point or for many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import bitmath as bm

COUNTERS = (
    "positive_gaps", "negative_gaps", "zero_gaps", "positive_exceptions", "negative_exceptions",
    "sum_pos", "sum_neg", "sum_pos_no_exc", "sum_neg_no_exc",
)


def gap(b: Column) -> Column:
    """The signed difference of high parts to the element before; the first element's is to zero."""
    return bm.high(F.col("x"), b) - bm.high(F.col("prev"), b)


def exception(rule: str, g: Column, b: Column) -> Column:
    """Whether an element is stored in full: never (none), both ways (two) or one way (one)."""
    room = F.greatest(F.col("total_bits") - b, F.lit(0))
    if rule == "none":
        return F.lit(False)
    if rule == "two":
        return (F.col("i") == 0) | (F.abs(g) + 2 > room)
    if rule == "one":
        return (F.col("i") == 0) | (F.abs(g) + 1 > room)
    raise ValueError(f"no such rule: {rule}")


def _counters(g: Column, exc: Column) -> list[Column]:
    pos, neg = g >= 0, g < 0
    count = lambda c: F.count_if(c)
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    made = (
        count(pos), count(neg), count((g == 0) & (F.col("i") > 0)), count(pos & exc), count(neg & exc),
        total(pos, g), total(neg, -g), total(pos & ~exc, g), total(neg & ~exc, -g),
    )
    return [c.cast("bigint").alias(name) for c, name in zip(made, COUNTERS)]


def variation_original(frame: DataFrame) -> DataFrame:
    """Per block, gaps of the values themselves; all zero for blocks of one element."""
    g, some = F.col("x") - F.col("prev"), F.col("n") >= 2
    kept = ("positive_gaps", "negative_gaps", "zero_gaps", "sum_pos", "sum_neg")
    made = [c for c, name in zip(_counters(g, F.lit(False)), COUNTERS) if name in kept]
    out = frame.groupBy("part", "n", "total_bits").agg(*made)
    return out.select("part", "n", "total_bits", *(F.when(some, F.col(c)).otherwise(0).alias(c) for c in kept))


def variation_shifted(frame: DataFrame, b: Column, rule: str) -> DataFrame:
    """All nine counters per block for one split point (a literal or a column that is constant in a block)."""
    rows = frame.withColumn("b", b.cast("bigint"))
    g = gap(F.col("b"))
    return rows.groupBy("part", "n", "total_bits", "b").agg(*_counters(g, exception(rule, g, F.col("b"))))


def variation_many(frame: DataFrame, rule: str, first: Column, last: Column) -> DataFrame:
    """The counters for every split point from ``first`` to ``last``, which may differ by block; zeros for blocks of one element.

    Candidates are generated from the block's own bounds, so none is made only to be filtered out. Grouping by (part, b) keeps the frame's
    partitioning by part: no further exchange.
    """
    rows = frame.where(first <= last).withColumn("b", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    g = gap(F.col("b"))
    out = rows.groupBy("part", "n", "total_bits", "b").agg(*_counters(g, exception(rule, g, F.col("b"))))
    return out.select("part", "n", "total_bits", "b", *(F.when(F.col("n") >= 2, F.col(c)).otherwise(0).alias(c) for c in COUNTERS))


def prefix_histogram(frame: DataFrame) -> DataFrame:
    """(part, lcp, n_pairs): how many neighbours share how many first bits, at the run variant's width."""
    bits = bm.total_bits_runs(F.col("base"), F.col("max")).cast("bigint")
    rows = frame.where("i > 0").withColumn("lcp", bm.common_prefix(F.col("x"), F.col("prev"), bits).cast("bigint"))
    return rows.groupBy("part", "lcp").agg(F.count("*").alias("n_pairs"))
