"""Where to split values into low and high bits: costs, and the cheapest choice with exact ties.

Every chooser returns one row per block: (part, n, total_bits, b, h, reversed, theoretical_bytes). Ties are settled by a rank that goes into
the minimum with the cost, so a choice is one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import bitmath as bm
from seqloom.operators import gaps



def _plain(variant: str) -> Column:
    """Bytes without any splitting."""
    return bm.to_bytes(F.col("n") * F.col("total_bits")) + bm.ELEMENT_BYTES + bm.BLOCK_FIELDS[variant]


def cost_two_way(c: str = "") -> Column:
    """Gaps both ways, exceptions in full."""
    n, b, h = F.col("n"), F.col("b"), F.col("total_bits") - F.col("b")
    exc = F.col("positive_exceptions") + F.col("negative_exceptions")
    split = (
        bm.to_bytes(n * b) + bm.to_bytes(exc * h) + bm.to_bytes(n) + bm.to_bytes(F.col("sum_pos_no_exc") + n - exc)
        + bm.to_bytes(F.col("sum_neg_no_exc") + n - exc) + bm.ELEMENT_BYTES + bm.BLOCK_FIELDS["b"]
    )
    return F.when((b >= F.col("total_bits")) | (exc == 0) | (exc > n), _plain("b")).otherwise(split)


def cost_one_way(reverse: bool) -> Column:
    """Gaps one way, upwards or, reversed, downwards; elements that go the other way are exceptions."""
    n, b, h = F.col("n"), F.col("b"), F.col("total_bits") - F.col("b")
    if reverse:
        exc, total = F.col("positive_gaps") - F.col("zero_gaps") + F.col("negative_exceptions"), F.col("sum_neg_no_exc")
    else:
        exc, total = F.col("positive_exceptions") + F.col("negative_gaps"), F.col("sum_pos_no_exc")
    split = bm.to_bytes(n * b) + bm.to_bytes(exc * h) + bm.to_bytes(n) + bm.to_bytes(total + n - exc) + bm.ELEMENT_BYTES + bm.BLOCK_FIELDS["u"]
    return F.when((b >= F.col("total_bits")) | (exc == 0) | (exc > n), _plain("u")).otherwise(split)


def cost_all_gaps() -> Column:
    """Gaps both ways for every element, no exceptions."""
    n, b = F.col("positive_gaps") + F.col("negative_gaps"), F.col("b")
    fields = bm.ELEMENT_BYTES + bm.BLOCK_FIELDS["bstar"]
    both = bm.to_bytes(F.col("sum_pos") + n) + bm.to_bytes(F.col("sum_neg") + n)
    return F.when(n == 0, F.lit(fields)).otherwise(bm.to_bytes(n * b) + fields + F.when(b < F.col("total_bits"), both).otherwise(0))


def _choose(costs: DataFrame, variant: str) -> DataFrame:
    """From (part, n, total_bits, b, reversed, cost, rank), the least cost, then the least rank."""
    best = F.min(F.struct("cost", "rank", "b", "reversed")).alias("best")
    out = costs.groupBy("part", "n", "total_bits").agg(best)
    b, tb = F.col("best.b"), F.col("total_bits")
    return out.select("part", "n", "total_bits", b.cast("bigint").alias("b"), (tb - b).cast("bigint").alias("h"), F.col("best.reversed").alias("reversed"), F.col("best.cost").cast("bigint").alias("theoretical_bytes"))


def _entries(stats: DataFrame, entries: list[tuple[Column, Column, Column, Column]]) -> DataFrame:
    """One row per candidate (applies, b, reversed, cost) of each row of ``stats``; rank is b, then direction."""
    made = F.array(*(
        F.when(applies, F.struct(b.cast("bigint").alias("b"), rev.alias("reversed"), cost.cast("bigint").alias("cost"), rank.cast("bigint").alias("rank")))
        for applies, b, rev, cost, rank in entries
    ))
    return stats.select("part", "n", "total_bits", F.inline(F.filter(made, lambda e: e.isNotNull())))


def _optimal(frame: DataFrame, rule: str, variant: str, costs: list[tuple[bool, Column]]) -> DataFrame:
    """Split points 1 .. total_bits - 1 against no splitting at all, which wins ties."""
    stats = gaps.variation_many(frame, rule, F.lit(1).cast("bigint"), F.col("total_bits"))
    whole = F.col("b") == F.col("total_bits")
    entries = [(whole, F.col("b"), F.lit(False), _plain(variant), F.lit(-1))]
    entries += [(~whole, F.col("b"), F.lit(rev), cost, 2 * F.col("b") + int(rev)) for rev, cost in costs]
    return _choose(_entries(stats, entries), variant)


def two_way_optimal(frame: DataFrame) -> DataFrame:
    return _optimal(frame, "two", "b", [(False, cost_two_way())])


def one_way_optimal(frame: DataFrame) -> DataFrame:
    return _optimal(frame, "one", "u", [(False, cost_one_way(False)), (True, cost_one_way(True))])


def _bounds(frame: DataFrame, low: Column, high: Column) -> DataFrame:
    """``frame`` with _lo and _hi from the block's own variation, by windows over the partitioning that is there, where the frame doesn't bring it along."""
    from pyspark.sql import Window as W

    rows = frame
    if "_up" not in frame.columns:
        w = W.partitionBy("part")
        g = F.col("x") - F.col("prev")
        many = F.col("n") >= 2
        rows = rows.withColumn("_up", F.when(many, F.sum(F.when(g >= 0, g).otherwise(0)).over(w)).otherwise(0))
        rows = rows.withColumn("_down", F.when(many, F.sum(F.when(g < 0, -g).otherwise(0)).over(w)).otherwise(0))
    return rows.withColumn("_lo", low.cast("bigint")).withColumn("_hi", high.cast("bigint"))


def _estimate() -> Column:
    """log2(ln 2 * variation / n); null without variation."""
    v = F.col("_up") + F.col("_down")
    return F.when(v > 0, F.log2(F.log(F.lit(2.0)) * v / F.col("n")))


def _ladder(frame: DataFrame, rule: str) -> DataFrame:
    """Counters at _lo and _hi only, one row per block and candidate."""
    rows = frame.withColumn("b", F.explode(F.array_distinct(F.array("_lo", "_hi"))))
    g = gaps.gap(F.col("b"))
    made = gaps._counters(g, gaps.exception(rule, g, F.col("b")))
    out = rows.groupBy("part", "n", "total_bits", "b", "_lo", "_hi").agg(*made)
    return out.select("part", "n", "total_bits", "b", "_lo", "_hi", *(F.when(F.col("n") >= 2, F.col(c)).otherwise(0).alias(c) for c in gaps.COUNTERS))


def two_way_approximate(frame: DataFrame) -> DataFrame:
    """The rounded estimate and the split point above it; the lower wins ties, no splitting only if cheaper than both."""
    tb = F.col("total_bits")
    rows = _bounds(frame, bm.clamp_split(_estimate(), tb), bm.clamp_split(_estimate() + 1, tb))
    stats = _ladder(rows, "two")
    low = F.col("b") == F.col("_lo")
    entries = [
        (F.lit(True), F.col("b"), F.lit(False), cost_two_way(), F.when(low, 0).otherwise(1)),
        (low, tb, F.lit(False), _plain("b"), F.lit(2)),
    ]
    return _choose(_entries(stats, entries), "b")


def one_way_approximate(frame: DataFrame) -> DataFrame:
    """As above, from the upward variation only, both directions; if no splitting beats the lower candidate, the upper one isn't looked at."""
    tb = F.col("total_bits")
    whole = F.expr("cast(_up div n as bigint)")
    x = F.when(whole > 0, F.log2(whole))
    rows = _bounds(frame, F.lit(0), F.lit(0)).withColumn("_lo", bm.clamp_split(x, tb).cast("bigint")).withColumn("_hi", bm.clamp_split(x + 1, tb).cast("bigint"))
    stats = _ladder(rows, "one").withColumn("_f", cost_one_way(False)).withColumn("_r", cost_one_way(True))
    at = lambda which, c: F.max(F.when(F.col("b") == F.col(which), F.col(c)))
    wide = stats.groupBy("part", "n", "total_bits", "_lo", "_hi").agg(at("_lo", "_f").alias("lf"), at("_lo", "_r").alias("lr"), at("_hi", "_f").alias("hf"), at("_hi", "_r").alias("hr"))
    plain = _plain("u")
    early = plain < F.least("lf", "lr")
    entries = [
        (~early, F.col("_lo"), F.lit(False), F.col("lf"), F.lit(0)), (~early, F.col("_lo"), F.lit(True), F.col("lr"), F.lit(1)),
        (~early, F.col("_hi"), F.lit(False), F.col("hf"), F.lit(2)), (~early, F.col("_hi"), F.lit(True), F.col("hr"), F.lit(3)),
        (F.lit(True), tb, F.lit(False), plain, F.lit(4)),
    ]
    return _choose(_entries(wide, entries), "u")


def all_gaps_optimal(frame: DataFrame) -> DataFrame:
    """A window of split points around the estimate, 0 among them; no splitting only if strictly cheaper."""
    tb = F.col("total_bits")
    x = _estimate()
    low = F.when(x.isNotNull(), F.greatest(F.lit(0), F.floor(x) - 1)).otherwise(0)  # least and greatest would pass over a null
    high = F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(tb, F.ceil(x) + 3))).otherwise(0)
    return _all_gaps(_bounds(frame, F.least(low, tb), high))


def all_gaps_approximate(frame: DataFrame) -> DataFrame:
    """The two split points next to the estimate; an integral estimate, or none, is taken as it is."""
    tb = F.col("total_bits")
    x = _estimate()
    low = F.when(x.isNotNull(), F.least(tb, F.greatest(F.lit(0), F.floor(x)))).otherwise(0)
    high = F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(tb, F.ceil(x)))).otherwise(0)
    rows = _bounds(frame, low, high)
    sure = x.isNull() | (F.ceil(x) == F.floor(x))
    return _all_gaps(rows, sure)


def _all_gaps(rows: DataFrame, sure: Column | None = None) -> DataFrame:
    tb = F.col("total_bits")
    rows = rows.withColumn("_sure", F.lit(False) if sure is None else sure)
    rows = rows.withColumn("b", F.explode(F.sequence(F.col("_lo"), F.greatest("_lo", "_hi"))))
    g = gaps.gap(F.col("b"))
    out = rows.groupBy("part", "n", "total_bits", "b", "_lo", "_sure").agg(*gaps._counters(g, F.lit(False)))
    # a block of one element has no counters in a search over many split points, but has them where one is sure
    out = out.select("part", "n", "total_bits", "b", "_lo", "_sure", *(F.when((F.col("n") >= 2) | F.col("_sure"), F.col(c)).otherwise(0).alias(c) for c in gaps.COUNTERS))
    entries = [
        (F.lit(True), F.col("b"), F.lit(False), cost_all_gaps(), F.col("b")),
        ((F.col("b") == F.col("_lo")) & ~F.col("_sure"), tb, F.lit(False), _plain("bstar"), F.lit(1000)),
    ]
    return _choose(_entries(out, entries), "bstar")


def runs_optimal(frame: DataFrame) -> DataFrame:
    """Runs of equal high parts, from a histogram of shared prefixes; costs are compared in bits, and no splitting, then the larger b, wins ties."""
    bits = bm.total_bits_runs(F.col("base"), F.col("max")).cast("bigint")
    rows = frame.withColumn("total_bits", bits).withColumn("lcp", F.when(F.col("i") > 0, bm.common_prefix(F.col("x"), F.col("prev"), bits)))
    rows = rows.groupBy("part", "n", "total_bits", "lcp").agg(F.count("*").alias("pairs"))  # some 64 rows a block
    rows = rows.withColumn("h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total_bits"))))
    runs = rows.groupBy("part", "n", "total_bits", "h").agg((1 + F.sum(F.when(F.col("lcp") < F.col("h"), F.col("pairs")).otherwise(0))).alias("runs"))
    n, h, tb = F.col("n"), F.col("h"), F.col("total_bits")
    cost = F.when(h == 0, n * tb).otherwise(n * (tb - h + 1) + F.col("runs") * h)
    best = runs.groupBy("part", "n", "total_bits").agg(F.min(F.struct(cost.alias("cost"), "h", "runs")).alias("best"))
    h, b = F.col("best.h"), F.col("total_bits") - F.col("best.h")
    fields = bm.ELEMENT_BYTES + bm.BLOCK_FIELDS["rle"]
    split = bm.to_bytes(F.col("n") * b) + bm.to_bytes(F.col("best.runs") * h) + bm.to_bytes(F.col("n")) + fields
    size = F.when(h == 0, bm.to_bytes(F.col("n") * F.col("total_bits")) + fields).otherwise(split)
    return best.select("part", "n", "total_bits", b.cast("bigint").alias("b"), h.cast("bigint").alias("h"), F.lit(False).alias("reversed"), size.cast("bigint").alias("theoretical_bytes"))


def classic(stats: DataFrame) -> DataFrame:
    """The textbook split of a monotone block: log2 of the mean gap."""
    tb = F.col("total_bits")
    mean = F.expr("cast((max - base + 1) div n as bigint)")
    b = F.when(mean <= 1, F.lit(0)).otherwise(F.least(tb, (bm.bit_length(mean) - 1).cast("bigint"))).cast("bigint")
    chosen = stats.withColumn("b", b)
    # one bit for each element, one for each step of the high part, and a word of padding
    unary = F.col("n") + bm.high(F.col("max") - F.col("base"), F.col("b")) + 64
    size = bm.to_bytes(F.col("n") * F.col("b")) + bm.to_bytes(unary) + bm.ELEMENT_BYTES + bm.BLOCK_FIELDS["classic"]
    return chosen.select("part", "n", "total_bits", "b", (tb - F.col("b")).alias("h"), size.cast("bigint").alias("theoretical_bytes"))


CHOOSERS = {
    ("rle", "optimal"): runs_optimal,
    ("u", "optimal"): one_way_optimal,
    ("u", "approximate"): one_way_approximate,
    ("b", "optimal"): two_way_optimal,
    ("b", "approximate"): two_way_approximate,
    ("bstar", "optimal"): all_gaps_optimal,
    ("bstar", "approximate"): all_gaps_approximate,
}
