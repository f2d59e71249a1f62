"""The registered queries: every operator on a sequence of the test tables, with the SQL that checks it in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import bitmath as bm
from seqloom.functions.runtime import scratch, ship
from seqloom.operators import access, blocks, codec, gaps, packed, rank, sizes, split
from seqloom.plans import oracles
from seqloom.sources import binary, results, store

SIZE = 4096


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark, sf_dir):
    return blocks.sequence(_read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey"))


def cents(spark, sf_dir):
    return blocks.sequence(_read(spark, sf_dir, "events"), F.col("event_id"), blocks.scaled(F.col("value"), 2))


def times(spark, sf_dir):
    return blocks.sequence(_read(spark, sf_dir, "events"), F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp")))


def balances(spark, sf_dir):
    return blocks.sequence(_read(spark, sf_dir, "customer"), F.col("c_custkey"), blocks.scaled(F.col("c_acctbal"), 2))


def ship_days(spark, sf_dir):
    """Ship dates of line items by the five columns that order them."""
    order = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"]
    rows = blocks.numbered(_read(spark, sf_dir, "lineitem").select(*order), order)
    return blocks.sequence(rows, F.col("pos"), F.unix_date(F.col("l_shipdate").cast("date")))


def order_keys(spark, sf_dir):
    """Order keys of line items in order: long runs, small steps."""
    rows = blocks.numbered(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
    return blocks.sequence(rows, F.col("pos"), F.col("l_orderkey"))


def _frame(spark, sf_dir, of=cents, size=SIZE):
    return blocks.frame(of(spark, sf_dir), size)


def flagship(spark: SparkSession, sf_dir: str, size: int = 256) -> DataFrame:
    """One row per block: the optimal two-way split of the events' times and what its parts come to."""
    frame = blocks.frame(times(spark, sf_dir), size)
    choice = split.two_way_optimal(frame)
    parts = codec.components(codec.encode(frame, choice, "b"), "b").select("part", "highs", "up_bits", "down_bits", F.col("theoretical_bytes").alias("encoded_bytes"))
    return choice.join(parts, "part").drop("reversed")


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[f.__name__] = f
    return f


Q["flagship"] = flagship


@query
def seq_block_minmax(s, d):
    return blocks.stats(balances(s, d), 512).select("part", "n", "base", "max")


@query
def seq_total_bits(s, d):
    return blocks.stats(balances(s, d), 512).select("part", "total_bits")


@query
def seq_total_bits_rle(s, d):
    rows = blocks.numbered(_read(s, d, "labels").select("doc_id", "quality"), ["doc_id"])
    st = blocks.stats(blocks.sequence(rows, F.col("pos"), F.col("quality")), 64)
    return st.select("part", bm.total_bits_runs(F.col("base"), F.col("max")).cast("bigint").alias("total_bits"))


@query
def seq_high_low_split(s, d):
    f = _frame(s, d)
    return f.select("pos", bm.high(F.col("x"), F.lit(5)).alias("high"), bm.low(F.col("x"), F.lit(5)).alias("low"))


@query
def seq_recombine(s, d):
    f = _frame(s, d, balances)
    b = F.lit(7)
    return f.select("pos", bm.recombine(F.col("base"), bm.high(F.col("x"), b), bm.low(F.col("x"), b), b).cast("bigint").alias("value"))


@query
def seq_high_gaps(s, d):
    return _frame(s, d).select("pos", gaps.gap(F.lit(6)).cast("bigint").alias("gap"))


@query
def seq_lcp(s, d):
    f = _frame(s, d).where("i > 0")
    bits = bm.total_bits_runs(F.col("base"), F.col("max")).cast("bigint")
    return f.select("pos", bm.common_prefix(F.col("x"), F.col("prev"), bits).cast("bigint").alias("lcp"))


@query
def seq_lcp_histogram(s, d):
    return gaps.prefix_histogram(_frame(s, d))


@query
def seq_runs_by_h(s, d):
    from pyspark.sql import Window

    h = gaps.prefix_histogram(_frame(s, d))
    w = Window.partitionBy("part").orderBy("lcp")
    return h.select("part", (F.col("lcp") + 1).alias("h"), (1 + F.sum("n_pairs").over(w)).cast("bigint").alias("runs"))


@query
def seq_variation_original(s, d):
    return gaps.variation_original(_frame(s, d)).drop("n", "total_bits")


def _gap_stats(rule):
    def run(s, d):
        return gaps.variation_shifted(_frame(s, d), F.lit(8), rule).drop("n", "total_bits")

    return run


Q["seq_gap_stats_none"] = _gap_stats("none")
Q["seq_gap_stats_two_way"] = _gap_stats("two")
Q["seq_gap_stats_one_way"] = _gap_stats("one")


@query
def seq_gap_stats_all_b(s, d):
    return gaps.variation_many(_frame(s, d), "two", F.lit(0).cast("bigint"), F.col("total_bits")).drop("n", "total_bits")


def _split(variant, strategy, of):
    def run(s, d):
        return split.CHOOSERS[variant, strategy](_frame(s, d, of))

    return run


for _name, _variant, _strategy in (
    ("rle", "rle", "optimal"), ("u_optimal", "u", "optimal"), ("u_approx", "u", "approximate"), ("b_optimal", "b", "optimal"),
    ("b_approx", "b", "approximate"), ("bstar_optimal", "bstar", "optimal"), ("bstar_approx", "bstar", "approximate"),
):
    Q[f"split_{_name}"] = _split(_variant, _strategy, cents)
    Q[f"split_{_name}_times"] = _split(_variant, _strategy, times)


@query
def split_ship_days(s, d):
    return split.all_gaps_optimal(_frame(s, d, ship_days))


@query
def split_classic(s, d):
    return split.classic(blocks.stats(times(s, d), SIZE))


def _sweep(rule, cost):
    def run(s, d):
        st = gaps.variation_many(_frame(s, d), rule, F.lit(0).cast("bigint"), F.col("total_bits"))
        return st.select("part", "b", cost().cast("bigint").alias("cost"))

    return run


Q["cost_sweep_bstar"] = _sweep("none", split.cost_all_gaps)
Q["cost_sweep_b"] = _sweep("two", split.cost_two_way)
Q["cost_sweep_u"] = _sweep("one", lambda: F.least(split.cost_one_way(False), split.cost_one_way(True)))


def _encoded(s, d, variant, of=cents):
    return codec.compress(_frame(s, d, of), variant)


@query
def enc_rle_runs(s, d):
    return _encoded(s, d, "rle").select("part", "i", "b", "low", "high", "is_exception")


@query
def enc_u_components(s, d):
    return _encoded(s, d, "u", times).select("part", "i", "b", "reversed", "low", "high", "gap", "is_exception")


@query
def enc_b_components(s, d):
    return _encoded(s, d, "b").select("part", "i", "b", "low", "high", "gap", "is_exception")


@query
def enc_bstar_gaps(s, d):
    return _encoded(s, d, "bstar").select("part", "i", "b", "low", "gap")


@query
def enc_classic_gaps(s, d):
    f = times(s, d)
    return codec.encode_classic(blocks.frame(f, SIZE), blocks.stats(f, SIZE)).select("part", "i", "b", "low", "gap")


@query
def unary_bits(s, d):
    e = _encoded(s, d, "bstar", times).where("gap is not null and gap >= 0")
    return e.select("part", "i", bm.unary(F.col("gap")).alias("code"), bm.unary_inverted(F.col("gap")).alias("inverted"))


@query
def size_by_variant(s, d):
    f = _frame(s, d)
    out = None
    for (variant, strategy), choose in split.CHOOSERS.items():
        one = sizes.total(choose(f)).select(F.lit(f"{variant}_{strategy}").alias("variant"), "n", "blocks", "total_bytes")
        out = one if out is None else out.unionByName(one)
    return out


@query
def bpi_ratio(s, d):
    t = sizes.total(split.all_gaps_optimal(_frame(s, d)))
    return t.select("n", "total_bytes", *(c.alias(k) for k, c in sizes.ratios(F.col("n"), F.col("total_bytes")).items()))


@query
def approx_vs_optimal(s, d):
    f = _frame(s, d)
    a = split.all_gaps_approximate(f).select("part", F.col("b").alias("b_approx"), F.col("theoretical_bytes").alias("bytes_approx"))
    return split.all_gaps_optimal(f).select("part", F.col("b").alias("b_optimal"), F.col("theoretical_bytes").alias("bytes_optimal")).join(a, "part")


#: The block sizes that the sweep compares.
SWEEP = [8000, 10000, 16000, 24000, 32000, 40000, 48000, 56000, 64000, 100000, 250000, 500000]


@query
def partition_size_sweep(s, d):
    """Every choice over every block size. Sizes do not depend on whether there is random access."""
    f = blocks.frames(cents(s, d), SWEEP)
    out = None
    for (variant, strategy), choose in split.CHOOSERS.items():
        by = choose(f).groupBy(F.shiftright("part", 40).alias("k")).agg(F.count("*").alias("blocks"), (F.sum("theoretical_bytes") + sizes.SEQUENCE_FIELDS).cast("bigint").alias("total_bytes"))
        size = F.get(F.array(*(F.lit(n).cast("bigint") for n in SWEEP)), F.col("k").cast("int"))
        one = by.select(F.lit(f"{variant}_{strategy}").alias("variant"), size.alias("partition_size"), "blocks", "total_bytes")
        out = one if out is None else out.unionByName(one)
    return out


@query
def build_metrics(s, d):
    f = _frame(s, d)
    choice = split.two_way_optimal(f)
    return sizes.build_metrics(choice, codec.components(codec.encode(f, choice, "b"), "b"))


@query
def encoded_sizes(s, d):
    f = _frame(s, d)
    choice = split.two_way_optimal(f)
    return codec.components(codec.encode(f, choice, "b"), "b")


def _decoded(variant, of):
    def run(s, d):
        return codec.decode(_encoded(s, d, variant, of)).select((F.col("part") * SIZE + F.col("i")).alias("pos"), "value")

    return run


for _v, _of in (("rle", cents), ("u", times), ("b", cents), ("bstar", times)):
    Q[f"decode_{_v}"] = _decoded(_v, _of)


@query
def decode_unsigned(s, d):
    """Values beyond 63 bits, through both tiers."""
    big = times(s, d).select("pos", (F.col("value") + F.lit(Decimal(1 << 63))).cast("decimal(20,0)").alias("value"))
    logical = codec.decode(codec.compress(blocks.frame(big, SIZE), "b")).select((F.col("part") * SIZE + F.col("i")).alias("pos"), "value")
    packed_ = packed.decode(packed.encode(big, "u", SIZE), "u", SIZE, unsigned=True)
    return logical.join(packed_.withColumnRenamed("value", "packed"), "pos")


@query
def decode_classic(s, d):
    f = times(s, d)
    e = codec.encode_classic(blocks.frame(f, SIZE), blocks.stats(f, SIZE))
    return codec.decode_classic(e).select((F.col("part") * SIZE + F.col("i")).alias("pos"), "value")


@query
def point_get(s, d):
    return access.point(_encoded(s, d, "b"), 777, SIZE)


@query
def at_checked(s, d):
    ask = s.createDataFrame([(0,), (5,), (999,), (10**9,), (-1,)], "pos long")
    n = cents(s, d).count()
    return access.at(_encoded(s, d, "b"), ask, SIZE, n)


@query
def get_elements(s, d):
    return access.elements(_encoded(s, d, "u"), 100, 250, cents(s, d).count(), SIZE)


@query
def get_elements_clamped(s, d):
    n = cents(s, d).count()
    return access.elements(_encoded(s, d, "rle"), n - 10, 20, n, SIZE)


@query
def get_range(s, d):
    return access.between(_encoded(s, d, "bstar"), 40, 90, cents(s, d).count(), SIZE)


@query
def batch_lookup(s, d):
    n = cents(s, d).count()
    ask = s.range(2000).select(((F.col("id") * 7919) % n).alias("pos"))
    return access.lookup(_encoded(s, d, "bstar"), ask, SIZE)


@query
def no_ra_prefix(s, d):
    return access.prefix(_encoded(s, d, "b"), 0, 300, 64)


def _prefix(variant, of):
    def run(s, d):
        return access.prefix(_encoded(s, d, variant, of), 0, 300, 64)

    return run


for _v, _of in (("rle", cents), ("u", times), ("bstar", cents)):
    Q[f"no_ra_prefix_{_v}"] = _prefix(_v, _of)


@query
def block_route(s, d):
    part, i = access.route(F.col("pos"), 1000)
    return cents(s, d).select("pos", part.alias("part"), i.alias("i"))


def _bits(s, d):
    return _frame(s, d).select("part", "pos", (F.col("x") % 2).cast("bigint").alias("bit"))


@query
def bv_rank1(s, d):
    return rank.ranks(_bits(s, d)).select("part", "pos", "rank1")


@query
def bv_rank0(s, d):
    return rank.ranks(_bits(s, d)).select("part", "pos", "rank0")


@query
def bv_rank_range(s, d):
    return rank.rank_range(_bits(s, d), 100, 700)


@query
def bv_select1(s, d):
    return rank.select(_bits(s, d), 1)


@query
def bv_select0(s, d):
    return rank.select(_bits(s, d), 0)


@query
def bv_cumgap(s, d):
    return rank.cumulative_gap(rank.unary_bits(_encoded(s, d, "bstar"), 1))


@query
def bv_get(s, d):
    return rank.get(_bits(s, d), 77, cents(s, d).count())


@query
def bv_set(s, d):
    n = cents(s, d).count()
    return rank.set_range(rank.set_bits(_bits(s, d), 8, 2741, 12, n), 100, 150, 1, n)


@query
def bv_from_packed(s, d):
    return rank.from_packed(packed.encode(cents(s, d), "b", SIZE).where("h > 0"), "flags", "n")


@query
def bv_pack(s, d):
    """Bits written as bytes and read back."""
    whole = _frame(s, d).select("part", F.col("i").alias("pos"), (F.col("x") % 2).cast("bigint").alias("bit"))
    return rank.from_packed(rank.pack(whole), "bytes", "n")


@query
def packed_sizes(s, d):
    """Bytes of the packed blocks by component, for every variant and strategy."""
    out = None
    for variant, strategy in (*split.CHOOSERS, ("classic", "optimal")):
        rows = packed.encode(times(s, d), variant, SIZE, strategy)
        parts = [F.sum(F.octet_length(c)).cast("bigint").alias(f"{c}_bytes") for c in ("low", "high", "flags", "up", "down")]
        one = rows.agg(F.sum("n").cast("bigint").alias("n"), *parts).withColumn("variant", F.lit(f"{variant}_{strategy}"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def stored_metadata(s, d):
    path = scratch(s)
    store.save(cents(s, d), path, "bstar", SIZE)
    return store.metadata(s, path)


@query
def limit_read(s, d):
    return cents(s, d).where(F.col("pos") < 500)


@query
def numbered_positions(s, d):
    return ship_days(s, d)


@query
def drift_source(s, d):
    return binary.drift(s, 1000)


@query
def bench_json_mean(s, d):
    """Result files written as JSON, a thousand runs to a file, read and averaged."""
    rows = _read(s, d, "orders").select(
        F.concat_ws("/", F.concat(F.lit("set"), F.col("o_orderkey") % 3), F.concat(F.lit("variant"), F.col("o_orderkey") % 2),
                    F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise((1000 * (1 + F.col("o_orderkey") % 4)).cast("string")),
                    F.when(F.col("o_orderkey") % 5 == 0, "RA_Disabled").otherwise("RA_Enabled")).alias("name"),
        (F.col("o_orderkey") / 128).cast("double").alias("CompressionRatio"), (F.col("o_custkey") * 2.0**20).cast("double").alias("bytes_per_second"),
        F.floor(F.col("o_orderkey") / 1000).alias("file"))
    path = scratch(s)
    rows.groupBy("file").agg(F.collect_list(F.struct("name", "CompressionRatio", "bytes_per_second")).alias("benchmarks")).write.partitionBy("file").json(path)
    return sizes.benchmark_means(results.read(s, path))


@query
def speedup_efficiency(s, d):
    rows = _read(s, d, "orders").select((F.col("o_orderkey") % 3).alias("dataset"), F.pow(F.lit(2), F.col("o_orderkey") % 4).cast("bigint").alias("threads"), F.col("o_custkey").cast("double").alias("throughput"))
    return sizes.speedup(rows)


@query
def packed_roundtrip(s, d):
    return packed.decode(packed.encode(cents(s, d), "b", SIZE), "b", SIZE)


@query
def packed_choice(s, d):
    return packed.encode(cents(s, d), "u", SIZE).select("part", "n", F.col("b").cast("bigint").alias("b"), F.col("h").cast("bigint").alias("h"), "reversed")


@query
def packed_lookup(s, d):
    n = cents(s, d).count()
    ask = s.range(2000).select(((F.col("id") * 104729) % n).alias("pos"))
    return packed.lookup(packed.encode(cents(s, d), "bstar", SIZE), ask, "bstar", SIZE)


@query
def binary_source(s, d):
    ship(s)
    folder = scratch(s)
    binary.write(np.arange(1000) * 3 - 500, f"{folder}/a.bin", 2)
    binary.write(np.arange(100)[::-1].copy(), f"{folder}/b.bin")
    return binary.read_dataset(s, folder, "*.bin").select(F.element_at(F.split("file", "/"), -1).alias("file"), "pos", "value", "decimals")


@query
def random_source(s, d):
    return binary.random_runs(s, 5000, -500, 500, 0.3, 3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in Q}
