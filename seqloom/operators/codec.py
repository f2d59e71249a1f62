"""Encoding into low parts, explicit high parts and gaps, and decoding them, one row per element.

Encoded rows: (part, i, n, base, b, h, reversed, low, high, gap, is_exception). high is set where an element is stored in full (or starts a run), gap where it is not;
blocks with h = 0 hold low parts only. The packed tier stores the same components as bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import bitmath as bm
from seqloom.operators import gaps, split

COLUMNS = ("part", "i", "n", "base", "b", "h", "reversed", "low", "high", "gap", "is_exception")


def _exceptions(variant: str):
    g, h, first = F.col("g"), F.col("h"), F.col("i") == 0
    if variant == "rle":
        return first | (g != 0)
    if variant == "u":
        way = F.when(F.col("reversed"), -g).otherwise(g)
        return first | (way < 0) | (way >= h)
    if variant == "b":
        return first | (F.abs(g) + 2 > h)
    return F.lit(False)


def encode(frame: DataFrame, choice: DataFrame, variant: str) -> DataFrame:
    """``choice``: one row per block, joined on part; both sides are already partitioned by it."""
    chosen = choice.select("part", "b", "h", *(["reversed"] if "reversed" in choice.columns else [F.lit(False).alias("reversed")]))
    rows = frame.join(chosen, "part").withColumn("g", gaps.gap(F.col("b")))
    split_ = F.col("h") > 0
    exc = split_ & _exceptions(variant)
    rows = rows.withColumn("is_exception", exc)
    high = F.when(F.col("is_exception"), bm.high(F.col("x"), F.col("b")))
    way = F.when(F.col("reversed"), -F.col("g")).otherwise(F.col("g"))
    gap = F.when(split_ & ~F.col("is_exception") & F.lit(variant != "rle"), way)
    return rows.select(
        "part", "i", "n", "base", "b", "h", "reversed", bm.low(F.col("x"), F.col("b")).alias("low"), high.alias("high"), gap.alias("gap"), "is_exception"
    )


def decode(encoded: DataFrame) -> DataFrame:
    """(part, i, value) by prefix sums: since the last element in full, the gaps add up. One window by block, no loop. Decimal values stay decimal."""
    order = W.partitionBy("part").orderBy("i")
    step = F.when(F.col("reversed"), -F.col("gap")).otherwise(F.col("gap"))
    rows = encoded.withColumn("sofar", F.sum(F.coalesce(step, F.lit(0))).over(order))
    anchor = F.last(F.col("high") - F.when(F.col("high").isNotNull(), F.col("sofar")), ignorenulls=True).over(order)
    hi = F.coalesce(anchor, F.lit(0)) + F.col("sofar")
    value = F.when(F.col("h") == 0, F.col("base") + F.col("low")).otherwise(bm.recombine(F.col("base"), hi, F.col("low"), F.col("b")))
    return rows.select("part", "i", value.cast(_kind(encoded)).alias("value"))


def _kind(encoded: DataFrame) -> T.DataType:
    kind = encoded.schema["base"].dataType
    return kind if isinstance(kind, T.DecimalType) else T.LongType()


def components(encoded: DataFrame, variant: str) -> DataFrame:
    """(part, n, b, h, low_bits, highs, flag_bits, up_bits, down_bits, theoretical_bytes): what each block's parts come to."""
    g = F.col("gap")
    none = F.lit(0).cast("bigint")
    plain = F.count_if(~F.col("is_exception"))
    up = F.coalesce(F.sum(F.when(g > 0, g)), none) + plain
    down = F.coalesce(F.sum(F.when(g < 0, -g)), none) + plain
    made = encoded.groupBy("part", "n", "b", "h").agg(F.count_if("is_exception").alias("highs"), up.alias("up"), down.alias("down"))
    split_ = F.col("h") > 0
    flags = F.when(split_ & F.lit(variant in ("rle", "u", "b")), F.col("n")).otherwise(0)
    up_bits = F.when(split_ & F.lit(variant != "rle"), F.col("up")).otherwise(0)
    down_bits = F.when(split_ & F.lit(variant in ("b", "bstar")), F.col("down")).otherwise(0)
    out = made.select(
        "part", "n", "b", "h", (F.col("n") * F.col("b")).alias("low_bits"), "highs", flags.cast("bigint").alias("flag_bits"),
        up_bits.cast("bigint").alias("up_bits"), down_bits.cast("bigint").alias("down_bits"),
    )
    size = (
        bm.to_bytes(F.col("low_bits")) + bm.to_bytes(F.col("highs") * F.col("h")) + bm.to_bytes(F.col("flag_bits")) + bm.to_bytes(F.col("up_bits"))
        + bm.to_bytes(F.col("down_bits")) + bm.ELEMENT_BYTES + bm.BLOCK_FIELDS[variant]
    )
    return out.withColumn("theoretical_bytes", size.cast("bigint"))


def compress(frame: DataFrame, variant: str = "bstar", strategy: str = "optimal") -> DataFrame:
    """Chooses and encodes. variant: rle, u, b, bstar; strategy: optimal or approximate (rle has the first only)."""
    if (variant, strategy) not in split.CHOOSERS:
        raise ValueError(f"no {strategy} choice for the variant {variant}")
    return encode(frame, split.CHOOSERS[variant, strategy](frame), variant)


def encode_classic(frame: DataFrame, stats: DataFrame) -> DataFrame:
    """Monotone blocks only: (part, i, b, low, gap) with non-negative gaps of high parts; a descent is refused."""
    chosen = split.classic(stats).select("part", "b")
    g = gaps.gap(F.col("b"))
    checked = F.when(g < 0, F.raise_error(F.lit("the classic variant takes monotone blocks"))).otherwise(g)
    return frame.join(chosen, "part").select("part", "i", "base", "b", bm.low(F.col("x"), F.col("b")).alias("low"), checked.cast("bigint").alias("gap"))


def decode_classic(encoded: DataFrame) -> DataFrame:
    hi = F.sum("gap").over(W.partitionBy("part").orderBy("i"))
    return encoded.select("part", "i", bm.recombine(F.col("base"), hi, F.col("low"), F.col("b")).cast(_kind(encoded)).alias("value"))
