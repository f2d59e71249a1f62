"""Shapes with known answers, choices against a scalar model, round trips, bounds and refusals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from scalar_model import optimal

from seqloom.operators import access, blocks, codec, gaps, packed, rank, sizes, split
from seqloom.sources import binary, results, store
from seqloom.streaming import append

SHAPES = {
    "ten": [1, 3, 7, 11, 15, 23, 31, 20, 10, 5],
    "same": [42] * 100,
    "alternating": [10, 20] * 50,
    "linear": list(range(1000)),
    "steps": [i // 10 for i in range(1000)],
    "descending": list(range(999, -1, -1)),
    "negative": [-5, -3, -100, 7, 0, 0, 0],
    "one": [17],
}
#: (b, bytes) by variant, one block, optimal.
KNOWN = {
    "ten": {"rle": (5, 17), "u": (5, 18), "b": (5, 17), "bstar": (5, 17)},
    "same": {"rle": (1, 23), "u": (1, 24), "b": (1, 23), "bstar": (1, 23)},
    "alternating": {"rle": (4, 60), "u": (4, 61), "b": (4, 60), "bstar": (4, 60)},
    "linear": {"rle": (3, 620), "u": (1, 451), "b": (1, 575), "bstar": (0, 385)},
    "steps": {"rle": (0, 223), "u": (1, 393), "b": (1, 517), "bstar": (0, 273)},
    "descending": {"rle": (3, 620), "u": (1, 451), "b": (1, 575), "bstar": (0, 510)},
    "negative": {"rle": (0, 16), "u": (1, 17), "b": (7, 17), "bstar": (7, 17)},
}


def make(spark, values):
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "pos long, value long")


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_known_choices(spark, name):
    f = blocks.frame(make(spark, SHAPES[name]), 4096)
    for variant, (b, size) in KNOWN[name].items():
        row = split.CHOOSERS[variant, "optimal"](f).first()
        assert (row["b"], row["theoretical_bytes"]) == (b, size), variant
    if name == "descending":
        assert split.one_way_optimal(f).first()["reversed"]


def test_choices_match_scalar_model(spark):
    rng = random.Random(5)
    parts = []
    for k in range(24):
        top = rng.choice([1, 3, 50, 1000, 10**6])
        v = [rng.randint(0, top) for _ in range(64)]
        parts.append(sorted(v) if k % 3 == 0 else sorted(v, reverse=True) if k % 3 == 1 else [x + rng.randint(0, 3) for x in sorted(v)])
    f = blocks.frame(make(spark, [v for p in parts for v in p]), 64).cache()
    for variant in ("rle", "u", "b"):
        got = {r["part"]: (r["b"], r["reversed"], r["theoretical_bytes"]) for r in split.CHOOSERS[variant, "optimal"](f).collect()}
        assert got == {k: optimal(p, variant) for k, p in enumerate(parts)}
    own = {k: packed.choose(np.array(p) - min(p), v)[1:] for v in ("b",) for k, p in enumerate(parts)}
    assert {k: (r[0], r[1]) for k, r in own.items()} == {k: optimal(p, "b")[:2] for k, p in enumerate(parts)}


@pytest.mark.parametrize("variant,strategy", sorted(split.CHOOSERS))
@pytest.mark.parametrize("size", [8, 1000])
def test_round_trip(spark, variant, strategy, size):
    values = [v for k in ("ten", "negative", "steps", "descending", "one") for v in SHAPES[k]]
    seq = make(spark, values)
    e = codec.compress(blocks.frame(seq, size), variant, strategy)
    got = {r["part"] * size + r["i"]: r["value"] for r in codec.decode(e).collect()}
    assert got == dict(enumerate(values))


@pytest.mark.parametrize("variant", ["rle", "u", "b", "bstar"])
def test_packed_equals_logical(spark, variant):
    rng = random.Random(9)
    values = [rng.randint(-500, 500) for _ in range(300)] + [7] * 100 + list(range(0, 90_000, 300)) + [rng.choice([0, 2**40]) for _ in range(50)]
    seq = make(spark, values)
    rows = packed.encode(seq, variant, 128)
    assert {r["pos"]: r["value"] for r in packed.decode(rows, variant, 128).collect()} == dict(enumerate(values))
    choice = split.CHOOSERS[variant, "optimal"](blocks.frame(seq, 128))
    pick = lambda d: sorted((r["part"], r["n"], int(r["b"]), int(r["h"]), r["reversed"]) for r in d.collect())
    assert pick(rows) == pick(choice)
    # packed components are as long as the size says, but for the fields
    parts = ("low", "high", "flags", "up", "down")
    size = {r["part"]: sum(len(r[c]) for c in parts) + (11 if variant == "u" else 10) for r in rows.collect()}
    assert size == {r["part"]: r["theoretical_bytes"] for r in choice.collect()}


def test_window_of_no_exceptions_is_the_least_on_the_shapes(spark):
    for name in KNOWN:
        f = blocks.frame(make(spark, SHAPES[name]), 4096)
        stats = gaps.variation_many(f, "none", F.lit(0), F.col("total_bits"))
        least = stats.select(F.min(split.cost_all_gaps()).alias("c")).first()["c"]
        best, near = split.all_gaps_optimal(f).first(), split.all_gaps_approximate(f).first()
        assert best["theoretical_bytes"] == least <= near["theoretical_bytes"]


def test_one_element_blocks(spark):
    f = blocks.frame(make(spark, [17]), 8)
    got = {v: (r["b"], r["h"], r["theoretical_bytes"]) for v, s in split.CHOOSERS for r in [split.CHOOSERS[v, s](f).first()] if s == "optimal"}
    assert got["b"] == (1, 0, 11) and got["u"] == (1, 0, 12) and got["bstar"] == (0, 1, 10)


def test_counters_of_known_sequence(spark):
    f = blocks.frame(make(spark, SHAPES["ten"]), 4096)
    row = lambda b: tuple(gaps.variation_shifted(f, F.lit(b), "two").select(*gaps.COUNTERS).first())
    assert row(0) == (7, 3, 0, 6, 3, 30, 26, 2, 0)
    assert row(2) == (7, 3, 1, 3, 2, 7, 6, 3, 1)


def test_empty_sequence(spark):
    f = blocks.frame(make(spark, []), 8)
    assert split.two_way_optimal(f).count() == 0
    assert packed.decode(packed.encode(make(spark, []), "b", 8), "b", 8).count() == 0


def test_nulls_are_refused(spark):
    df = spark.createDataFrame([(0, None)], "pos long, value long")
    with pytest.raises(Exception, match="no nulls"):
        blocks.sequence(df, F.col("pos"), F.col("value")).collect()


def test_descents_are_refused_by_the_classic_variant(spark):
    seq = make(spark, [3, 2, 1, 9])
    with pytest.raises(Exception, match="monotone"):
        codec.encode_classic(blocks.frame(seq, 8), blocks.stats(seq, 8)).collect()


def test_bounds(spark):
    n, size = 100, 8
    e = codec.compress(blocks.frame(make(spark, range(n)), size), "b")
    values = lambda df: sorted(r["value"] for r in df.collect())
    assert values(access.elements(e, 90, 20, n, size)) == list(range(90, 100))
    assert values(access.elements(e, 5, 0, n, size)) == [] == values(access.elements(e, 100, 5, n, size, buffer=0))
    assert (access.written(90, 20, n), access.written(200, 5, n), access.written(3, 4, n)) == (10, 0, 4)
    with pytest.raises(ValueError):
        access.elements(e, 0, 10, n, size, buffer=5)
    for start, end in ((4, 4), (5, 3), (90, 101)):
        with pytest.raises(IndexError):
            access.between(e, start, end, n, size)
    assert values(access.prefix(e, 1, 3, 4)) == [11, 12, 13, 14]


def test_rank_and_select(spark):
    bits = spark.createDataFrame([(0, i, b) for i, b in enumerate([1, 0, 0, 1, 1, 0])], "part long, pos long, bit long")
    rows = {r["pos"]: (r["rank1"], r["rank0"]) for r in rank.ranks(bits).collect()}
    assert rows == {0: (0, 0), 1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (2, 2), 5: (3, 2)}
    assert sorted((r["k"], r["pos"]) for r in rank.select(bits, 1).collect()) == [(1, 0), (2, 3), (3, 4)]
    assert rank.rank_range(bits, 1, 5).first()[1:] == (2, 2)
    with pytest.raises(IndexError):
        rank.rank_range(bits, 3, 2)


def test_positions_without_a_global_window(spark):
    rows = [(k % 7000, k) for k in range(20_000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    got = [r["v"] for r in blocks.numbered(df, ["k", "v"]).orderBy("pos").collect()]
    assert got == [v for _, v in sorted(rows)]


def test_store_and_range_read(spark, tmp_path):
    values = list(range(0, 5000, 5))
    store.save(make(spark, values), str(tmp_path / "t"), "bstar", 64)
    rows, variant, size = store.load(spark, str(tmp_path / "t"))
    assert (variant, size, rows.count()) == ("bstar", 64, 16)
    assert sorted((r["pos"], r["value"]) for r in store.read(spark, str(tmp_path / "t"), 60, 70).collect()) == [(i, i * 5) for i in range(60, 70)]
    ask = spark.createDataFrame([(5,), (5,), (999,)], "pos long")
    assert sorted((r["pos"], r["value"]) for r in packed.lookup(rows, ask, variant, size).collect()) == [(5, 25), (5, 25), (999, 4995)]


def test_raw_files(spark, tmp_path):
    np.array([3, 1, 2], "<u2").tofile(tmp_path / "plain.bin")
    got = binary.read(spark, str(tmp_path / "plain.bin"), "uint16", first_is_size=False, max_size=2)
    assert [r["value"] for r in got.orderBy("pos").collect()] == [3, 1]
    np.array([2, 2**64 - 1, 5], "<u8").tofile(tmp_path / "big.bin")
    assert [int(r["value"]) for r in binary.read(spark, str(tmp_path / "big.bin"), "uint64").orderBy("pos").collect()] == [2**64 - 1, 5]
    binary.write(np.array([7, 8]), str(tmp_path / "d1.bin"), 3)
    binary.write(np.array([9]), str(tmp_path / "d2.bin"))
    rows = binary.read_dataset(spark, str(tmp_path), "d*.bin").orderBy("file", "pos").collect()
    assert [(r["value"], r["decimals"]) for r in rows] == [(7, 3), (8, 3), (9, 0)]


def test_random_source_repeats_itself(spark):
    a = binary.random_runs(spark, 500, -3, 3, 0.5, 4).orderBy("pos").collect()
    assert a == binary.random_runs(spark, 500, -3, 3, 0.5, 4).orderBy("pos").collect()
    assert all(-3 <= r["value"] <= 3 for r in a) and len({r["value"] for r in a}) == 7


def test_stream_appends_blocks(spark, tmp_path):
    make(spark, range(200)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pos long, value long").parquet(str(tmp_path / "in"))
    append.append_blocks(stream, str(tmp_path / "out"), str(tmp_path / "check"), "b", 50).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["value"] for r in packed.decode(rows, "b", 50).collect()) == list(range(200))


def test_totals(spark):
    choice = split.two_way_optimal(blocks.frame(make(spark, range(1000)), 4096))
    assert sizes.total(choice).first() == (1000, 1, 575 + 16)


def test_benchmark_files(spark, tmp_path):
    import json

    runs = [("a/x/1000/RA_Enabled", 0.5, 2), ("b/x/1000/RA_Enabled", 0.7, 4), ("c/x/1000/RA_Enabled", None, 9), ("a/x/1000/RA_Disabled_x", 9, 9), ("a/x/many/RA_Enabled", 9, 9), ("short", 9, 9)]
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"context": {}, "benchmarks": [{"name": n, "CompressionRatio": c, "bytes_per_second": s * 2**20} for n, c, s in runs[i::2]]}, indent=1))
    (tmp_path / "other.txt").write_text("no json")
    assert [tuple(r) for r in sizes.benchmark_means(results.read(spark, str(tmp_path))).collect()] == [("x", 1000, 2, 60.0, 3.0)]


def test_setting_bits(spark):
    bits = spark.createDataFrame([(0, i, 0) for i in range(70)], "part long, pos long, bit long")
    read = lambda df: [r["bit"] for r in df.orderBy("pos").collect()]
    assert read(rank.set_bits(bits, 3, 2**64 - 1, 64, 70)) == [0] * 3 + [1] * 64 + [0] * 3
    assert read(rank.set_range(bits, 1, 4, 1, 70))[:5] == [0, 1, 1, 1, 0]
    assert rank.get(bits, 69, 70).first()["bit"] == 0
    for wrong in (lambda: rank.set_bits(bits, 10, 1, 61, 70), lambda: rank.set_range(bits, 5, 71, 1, 70), lambda: rank.get(bits, 70, 70)):
        with pytest.raises(IndexError):
            wrong()
    with pytest.raises(ValueError):
        rank.set_bits(bits, 0, 1, 65, 70)


@pytest.mark.parametrize("variant", ["u", "b", "bstar"])
def test_packed_approximate_choices_equal_logical_ones(spark, variant):
    rng = random.Random(19)
    values = [v for k in ("ten", "negative", "steps", "descending", "same", "alternating") for v in SHAPES[k]]
    for top in (1, 3, 70, 5000, 2**40):
        values += sorted(rng.randint(0, top) for _ in range(128)) + [rng.randint(0, top) for _ in range(128)]
    values += [3]  # a block of one
    values = values[: len(values) - len(values) % 64 + 1]
    seq = make(spark, values)
    rows = packed.encode(seq, variant, 64, "approximate")
    assert {r["pos"]: r["value"] for r in packed.decode(rows, variant, 64).collect()} == dict(enumerate(values))
    pick = lambda d: sorted((r["part"], r["n"], int(r["b"]), int(r["h"]), r["reversed"]) for r in d.collect())
    assert pick(rows) == pick(split.CHOOSERS[variant, "approximate"](blocks.frame(seq, 64)))


def test_packed_classic_blocks(spark):
    values = [v // 3 for v in range(0, 9000, 7)] + [10**12]
    rows = packed.encode(make(spark, values), "classic", 200)
    assert [r["value"] for r in packed.decode(rows, "classic", 200).orderBy("pos").collect()] == values
    choice = {r["part"]: r["b"] for r in split.classic(blocks.stats(make(spark, values), 200)).collect()}
    assert {r["part"]: r["b"] for r in rows.collect()} == choice
    with pytest.raises(Exception, match="monotone"):
        packed.encode(make(spark, [3, 1]), "classic", 200).collect()


@pytest.mark.parametrize("variant,strategy", [("rle", "approximate"), ("b", "best"), ("c", "optimal")])
def test_choices_that_do_not_exist_are_refused(spark, variant, strategy):
    with pytest.raises(ValueError):
        packed.encode(make(spark, [1, 2]), variant, 64, strategy)
    with pytest.raises(ValueError):
        codec.compress(blocks.frame(make(spark, [1, 2]), 64), variant, strategy)


def test_split_points_and_ranges_beyond_64_bits_are_refused(spark):
    row = packed.encode(make(spark, [1, 2, 3]), "b", 64).first().asDict()
    for b in (65, -1):
        with pytest.raises(ValueError):
            packed.decode_block(row | {"b": b}, "b")
    with pytest.raises(OverflowError):
        packed.encode_block(np.array([-(2**63), 2**63 - 1]), "b")


@pytest.mark.parametrize("variant", ["rle", "u", "b", "bstar"])
def test_unsigned_values_in_both_tiers(spark, tmp_path, variant):
    values = [2**63 + 10**6, 2**63 + 5, 2**63 - 1, 2**63, 2**63 + 7] * 30
    np.array([len(values), *values], "<u8").tofile(tmp_path / "big.bin")
    seq, want = binary.read(spark, str(tmp_path / "big.bin"), "uint64").select("pos", "value"), dict(enumerate(values))
    got = {r["part"] * 64 + r["i"]: int(r["value"]) for r in codec.decode(codec.compress(blocks.frame(seq, 64), variant)).collect()}
    assert got == want
    store.save(seq, str(tmp_path / "t"), variant, 64)
    assert {r["pos"]: int(r["value"]) for r in store.read(spark, str(tmp_path / "t")).collect()} == want
    assert store.metadata(spark, str(tmp_path / "t")).first() == (150, 3, False, 0)


def test_raw_files_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "PIECE_BYTES", 4096)
    rng = np.random.default_rng(3)
    values = rng.integers(-(2**62), 2**62, 10_001)
    binary.write(values, str(tmp_path / "a b.bin"), 2)
    binary.write(values[:0], str(tmp_path / "none.bin"))
    rows = binary.read_dataset(spark, str(tmp_path), "*.bin")
    assert [r["value"] for r in rows.orderBy("pos").collect()] == values.tolist()
    (tmp_path / "cut.raw").write_bytes(np.array([5, 1, 2], "<i8").tobytes() + b"xyz")
    assert [r["value"] for r in binary.read(spark, str(tmp_path / "cut.raw")).orderBy("pos").collect()] == [1, 2]
    assert binary.read(spark, str(tmp_path / "a b.bin"), first_is_size=False, max_size=700).count() == 700


def test_numbers_of_a_key_that_most_rows_share(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 9 > 0, 5).otherwise(F.col("id") % 11).alias("k"), F.xxhash64("id").alias("v"))
    rows = blocks.numbered(df, ["k", "v"])
    got = [(r["k"], r["v"]) for r in rows.orderBy("pos").collect()]
    assert got == sorted((r["k"], r["v"]) for r in df.collect()) and [r["pos"] for r in rows.select("pos").orderBy("pos").collect()] == list(range(30_000))


def test_bits_are_packed_and_read(spark):
    bits = [(p, i, (i * 7 + p) % 3 % 2) for p, n in ((0, 1), (1, 8), (2, 77)) for i in range(n)]
    packed_bits = rank.pack(spark.createDataFrame(bits, "part long, pos long, bit long"))
    rows = {r["part"]: (r["n"], bytes(r["bytes"])) for r in packed_bits.collect()}
    for p in range(3):
        own = [b for q, _, b in bits if q == p]
        assert rows[p] == (len(own), np.packbits(own, bitorder="little").tobytes())
    assert sorted(tuple(r) for r in rank.from_packed(packed_bits, "bytes", "n").collect()) == bits


def test_registered_sequences_are_split(spark, sf_dir):
    """Queries that would hold nothing but whole values say nothing about gaps."""
    from seqloom.plans import registry

    assert registry.flagship(spark, sf_dir).where("h > 0").count() > 0
    assert registry.queries()["unary_bits"](spark, sf_dir).count() > 500
    assert registry._encoded(spark, sf_dir, "bstar", registry.times).where("gap <> 0").count() > 0


def test_shared_space_has_to_be_named_on_a_cluster():
    from types import SimpleNamespace

    from seqloom.functions.runtime import scratch

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError):
        scratch(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="yarn")))


def test_frames_of_several_sizes_in_tasks_of_bounded_size(spark, monkeypatch):
    """As one frame for each size, also where positions are left out, and no task holds more for a longer sequence."""
    monkeypatch.setattr(blocks, "CHUNK", 16, raising=False)
    monkeypatch.setattr(blocks, "TASK_ELEMENTS", 64, raising=False)
    rng = random.Random(7)
    seq = spark.createDataFrame([(p, rng.randint(-50, 10**6) if p % 300 > 40 else p) for p in range(3001) if p % 37 and not 420 <= p < 570], "pos long, value long")
    block_sizes = [1, 24, 40, 700]
    alone = None
    for k, n in enumerate(block_sizes):
        one = blocks.frame(seq, n).withColumn("part", F.col("part") + F.lit(k << 40))
        alone = one if alone is None else alone.unionByName(one)
    alone, together = alone.cache(), blocks.frames(seq, block_sizes)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(together.select(*alone.columns)) == rows(alone)
    for choose in split.CHOOSERS.values():
        assert rows(choose(together)) == rows(choose(alone))
    held = together.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("pos").alias("n"))
    assert max(r["n"] for r in held.collect()) <= 4 * 64
    assert blocks.frames(make(spark, []), block_sizes).count() == 0
