"""The packed tier: one row per block, its components as bit-packed binaries, encoded and decoded in Arrow batches.

A block is a row of fixed bound, so tasks hold one block's elements at a time. Bits are numbered from the least significant of the first byte on. Unsigned 64-bit
values, as decimal(20,0), are held less 2**63; whoever decodes says that they are unsigned, as ``store`` does.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.runtime import ship
from seqloom.operators.blocks import DEFAULT_SIZE

FIELDS = "part long, n long, base long, total_bits int, b int, h int, reversed boolean, low binary, high binary, flags binary, up binary, down binary"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def pack_ints(x: np.ndarray, width: int) -> bytes:
    if width == 0 or len(x) == 0:
        return b""
    bits = (x.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ints(data: bytes, width: int, n: int) -> np.ndarray:
    if width == 0 or n == 0:
        return np.zeros(n, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.int64)


def pack_unary(gaps: np.ndarray) -> bytes:
    """Each gap as so many ones and a zero."""
    if len(gaps) == 0:
        return b""
    bits = np.ones(int(gaps.sum()) + len(gaps), np.uint8)
    bits[np.cumsum(gaps + 1) - 1] = 0
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_unary(data: bytes, n: int) -> np.ndarray:
    zeros = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little") == 0)[:n]
    return np.diff(zeros, prepend=-1) - 1


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.array([int(v).bit_length() for v in np.atleast_1d(x)])


def _bytes(bits):
    return (bits + 7) // 8


def statistics(x: np.ndarray, splits: np.ndarray, bits: int, rule: str) -> dict[str, np.ndarray]:
    """Counters for all split points at once; one pass for each split point over a contiguous block, no rows multiplied."""
    names = ("pos", "neg", "zero", "pe", "ne", "up", "down", "upx", "downx")
    out = {k: np.zeros(len(splits), np.int64) for k in names}
    if len(x) < 2:
        return out
    for at, b in enumerate(splits):
        hi = x >> b
        g = np.diff(hi, prepend=0)
        size = np.abs(g)
        room = bits - b
        exc = size + 2 > room if rule == "two" else size + 1 > room if rule == "one" else np.zeros(len(g), bool)
        if rule != "none":
            exc[0] = True
        neg = g < 0
        total, down, n_neg = int(size.sum()), int(size[neg].sum()), int(neg.sum())
        plain_down, plain_all = int(size[neg & ~exc].sum()), int(size[~exc].sum())
        ne, e = int((neg & exc).sum()), int(exc.sum())
        out["pos"][at], out["neg"][at], out["zero"][at] = len(g) - n_neg, n_neg, int((g[1:] == 0).sum())
        out["pe"][at], out["ne"][at] = e - ne, ne
        out["up"][at], out["down"][at], out["upx"][at], out["downx"][at] = total - down, down, plain_all - plain_down, plain_down
    return out


def _clamped(v: float, bits: int) -> int:
    """Rounded half away from zero, within [0, bits]."""
    return min(bits, max(0, int(np.floor(v + 0.5)) if v >= 0 else -int(np.floor(0.5 - v))))


def choose_approximate(x: np.ndarray, variant: str) -> tuple[int, int, bool]:
    """(total_bits, b, reversed): the choice between the split points next to the estimate, by the same costs and ties as ``split``."""
    n, bits = len(x), max(1, int(x.max()).bit_length())
    g = np.diff(x, prepend=0) if n >= 2 else np.zeros(0, np.int64)
    up, down = int(g[g > 0].sum()), -int(g[g < 0].sum())
    estimate = np.log2(np.log(2) * (up + down) / n) if up + down else None
    if variant == "bstar":
        sure = estimate is None or np.floor(estimate) == np.ceil(estimate)
        low, high = (min(bits, max(0, int(f(estimate)))) if estimate is not None else 0 for f in (np.floor, np.ceil))
        splits = np.array(sorted({low, max(low, high)}))
        s = statistics(x, splits, bits, "none") if n >= 2 or not sure else {"pos": np.ones(len(splits), np.int64), "neg": np.zeros(len(splits), np.int64), "up": x[0] >> splits, "down": np.zeros(len(splits), np.int64)}
        best, cost = int(np.argmin(c := _cost_all_gaps(s, splits, bits))), c
        return (bits, bits, False) if not sure and PLAIN_FIELDS["bstar"] + _bytes(n * bits) < cost[best] else (bits, int(splits[best]), False)
    if variant == "u":
        whole = up // n
        low, high = (_clamped(np.log2(whole) + k, bits) if whole else 0 for k in (0, 1))
    else:
        low, high = (_clamped(estimate + k, bits) if estimate is not None else 0 for k in (0, 1))
    splits, plain = np.array([low, high]), _bytes(n * bits) + PLAIN_FIELDS[variant]
    s = statistics(x, splits, bits, "one" if variant == "u" else "two")
    if variant == "b":
        cost = _cost_two_way(s, splits, n, bits)
        best = int(np.argmin(cost))
        return (bits, bits, False) if plain < cost[best] else (bits, int(splits[best]), False)
    both = _cost_one_way(s, splits, n, bits)
    best = int(np.argmin(both))
    return (bits, bits, False) if plain < both[:2].min() or plain < both[best] else (bits, int(splits[best // 2]), bool(best % 2))


#: Bytes of an element and of a block's own fields.
PLAIN_FIELDS = {"u": 11, "b": 10, "bstar": 10}


def _cost_all_gaps(s: dict[str, np.ndarray], splits: np.ndarray, bits: int) -> np.ndarray:
    count = s["pos"] + s["neg"]
    cost = 10 + _bytes(count * splits) + np.where(splits < bits, _bytes(s["up"] + count) + _bytes(s["down"] + count), 0)
    return np.where(count == 0, 10, cost)


def _cost_split(splits: np.ndarray, n: int, bits: int, fields: int, exc: np.ndarray, *sums: np.ndarray) -> np.ndarray:
    parts = _bytes(n * splits) + _bytes(exc * (bits - splits)) + _bytes(n) + sum(_bytes(t + n - exc) for t in sums) + fields
    return np.where((splits >= bits) | (exc == 0) | (exc > n), _bytes(n * bits) + fields, parts)


def _cost_two_way(s: dict[str, np.ndarray], splits: np.ndarray, n: int, bits: int) -> np.ndarray:
    return _cost_split(splits, n, bits, PLAIN_FIELDS["b"], s["pe"] + s["ne"], s["upx"], s["downx"])


def _cost_one_way(s: dict[str, np.ndarray], splits: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Upwards and reversed by turns."""
    ahead = _cost_split(splits, n, bits, PLAIN_FIELDS["u"], s["pe"] + s["neg"], s["upx"])
    back = _cost_split(splits, n, bits, PLAIN_FIELDS["u"], s["pos"] - s["zero"] + s["ne"], s["downx"])
    return np.column_stack([ahead, back]).ravel()


def choose(x: np.ndarray, variant: str, strategy: str = "optimal") -> tuple[int, int, bool]:
    """(total_bits, b, reversed), by the same costs and ties as ``split``."""
    if variant not in ("rle", "u", "b", "bstar") or strategy not in ("optimal", "approximate") or (variant, strategy) == ("rle", "approximate"):
        raise ValueError(f"no {strategy} choice for the variant {variant}")
    n, top = len(x), int(x.max()) if len(x) else 0
    bits = max(1, top.bit_length())
    if strategy == "approximate":
        return choose_approximate(x, variant)
    if variant == "rle":
        bits = 1 if top == 0 else (top + 1).bit_length()
        same = np.array([bits] * (n - 1))
        diff = x[1:] ^ x[:-1]
        if n > 1:
            lengths = np.zeros(n - 1, np.int64)
            nz = diff > 0
            lengths[nz] = np.floor(np.log2(diff[nz].astype(np.float64))).astype(np.int64) + 1
            over = nz & (diff < (np.int64(1) << np.minimum(np.maximum(lengths - 1, 0), 62)))
            lengths[over] -= 1
            same = np.where(nz, bits - lengths, bits)
        freq = np.bincount(same, minlength=bits + 1) if n > 1 else np.zeros(bits + 1, np.int64)
        h = np.arange(1, bits + 1)
        cost = n * (bits - h + 1) + (1 + np.cumsum(freq)[: bits]) * h
        best = int(np.argmin(cost)) if len(cost) else 0
        return (bits, bits - int(h[best]), False) if cost[best] < n * bits else (bits, bits, False)
    if variant == "bstar":
        variation = int(np.abs(np.diff(x)).sum() + x[0]) if n >= 2 else 0
        est = np.log2(np.log(2) * variation / n) if variation else None
        lo = max(0, int(np.floor(est)) - 1) if est is not None else 0
        hi = max(0, min(bits, int(np.ceil(est)) + 3)) if est is not None else 0
        splits = np.arange(min(lo, bits), max(hi, min(lo, bits)) + 1)
        s = statistics(x, splits, bits, "none")
        cost = _cost_all_gaps(s, splits, bits)
        best = int(np.argmin(cost))
        return (bits, bits, False) if 10 + _bytes(n * bits) < cost[best] else (bits, int(splits[best]), False)
    splits = np.arange(1, bits)
    plain = _bytes(n * bits) + PLAIN_FIELDS[variant]
    if not len(splits):
        return bits, bits, False
    s = statistics(x, splits, bits, "one" if variant == "u" else "two")
    if variant == "b":
        cost = _cost_two_way(s, splits, n, bits)
        best = int(np.argmin(cost))
        return (bits, int(splits[best]), False) if cost[best] < plain else (bits, bits, False)
    both = _cost_one_way(s, splits, n, bits)
    best = int(np.argmin(both))
    return (bits, int(splits[best // 2]), bool(best % 2)) if both[best] < plain else (bits, bits, False)


def _classic(values: np.ndarray) -> dict:
    """Monotone blocks: low parts, and steps of the high parts in unary."""
    base = int(values[0])
    x = values - base
    if len(x) > 1 and (np.diff(x) < 0).any():
        raise ValueError("the classic variant takes monotone blocks")
    bits = max(1, int(x[-1]).bit_length())
    mean = (int(x[-1]) + 1) // len(x)
    b = 0 if mean <= 1 else min(bits, mean.bit_length() - 1)
    row = {"base": base, "n": len(x), "total_bits": bits, "b": b, "h": bits - b, "reversed": False, "high": b"", "flags": b"", "down": b""}
    return row | {"low": pack_ints(x & ((1 << b) - 1), b), "up": pack_unary(np.diff(x >> b, prepend=0))}


def encode_block(values: np.ndarray, variant: str, strategy: str = "optimal") -> dict:
    if variant == "classic":
        return _classic(values)
    base = int(values.min())
    if int(values.max()) - base >= 1 << 63:
        raise OverflowError("the range of a block exceeds 63 bits")
    x = values - base
    bits, b, rev = choose(x, variant, strategy)
    h = bits - b
    row = {"base": base, "n": len(x), "total_bits": bits, "b": b, "h": h, "reversed": rev, "high": b"", "flags": b"", "up": b"", "down": b""}
    row["low"] = pack_ints(x & ((1 << b) - 1) if b < 63 else x, b)
    if h:
        hi = x >> b if b < 63 else np.zeros_like(x)
        g = np.diff(hi, prepend=0)
        way = -g if rev else g
        exc = {
            "rle": lambda: g != 0, "u": lambda: (way < 0) | (way >= h), "b": lambda: np.abs(g) + 2 > h, "bstar": lambda: np.zeros(len(g), bool),
        }[variant]()
        if variant != "bstar":
            exc[0] = True
            row["flags"] = np.packbits(exc, bitorder="little").tobytes()
            row["high"] = pack_ints(hi[exc], h)
        if variant == "u":
            row["up"] = pack_unary(way[~exc])
        elif variant in ("b", "bstar"):
            row["up"], row["down"] = pack_unary(np.maximum(g[~exc], 0)), pack_unary(np.maximum(-g[~exc], 0))
    return row


def decode_block(row: dict, variant: str) -> np.ndarray:
    n, b, h = row["n"], row["b"], row["h"]
    if not 0 <= b < 65:
        raise ValueError(f"no split point {b} of 64-bit values")
    low = unpack_ints(row["low"], b, n)
    if variant == "classic":
        return row["base"] + (low | np.cumsum(unpack_unary(row["up"], n)) << b)
    if h == 0:
        return row["base"] + low
    if variant == "bstar":
        g = unpack_unary(row["up"], n) - unpack_unary(row["down"], n)
        return row["base"] + (low | np.cumsum(g) << b)
    exc = np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=n, bitorder="little").astype(bool)
    full = unpack_ints(row["high"], h, int(exc.sum()))
    if variant == "rle":
        return row["base"] + (low | full[np.cumsum(exc) - 1] << b)
    g = np.zeros(n, np.int64)
    rest = n - len(full)
    if variant == "u":
        g[~exc] = unpack_unary(row["up"], rest) * (-1 if row["reversed"] else 1)
    else:
        g[~exc] = unpack_unary(row["up"], rest) - unpack_unary(row["down"], rest)
    sums = np.cumsum(g)
    at = np.flatnonzero(exc)
    which = np.cumsum(exc) - 1
    return row["base"] + (low | (full[which] + sums - sums[at][which]) << b)


#: What unsigned values are held less.
BIAS = 1 << 63


def is_unsigned(seq: DataFrame) -> bool:
    return isinstance(seq.schema["value"].dataType, T.DecimalType)


def _as_read(df: DataFrame, unsigned: bool) -> DataFrame:
    return df.withColumn("value", (F.col("value").cast("decimal(20,0)") + F.lit(Decimal(BIAS))).cast("decimal(20,0)")) if unsigned else df


def encode(seq: DataFrame, variant: str = "bstar", size: int = DEFAULT_SIZE, strategy: str = "optimal") -> DataFrame:
    """Block rows of (pos, value): one exchange by block, then one task packs whole blocks. variant: rle, u, b, bstar or classic; strategy: optimal or approximate."""
    ship(seq.sparkSession)
    if variant != "classic":
        choose(np.zeros(1, np.int64), variant, strategy)  # refuses what there is no choice for
    value = F.col("value") - F.lit(Decimal(BIAS)) if is_unsigned(seq) else F.col("value")
    rows = seq.select(F.expr(f"pos div {size}").alias("part"), "pos", value.cast("bigint").alias("value"))

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("pos").to_numpy(), kind="stable")
        row = encode_block(group.column("value").to_numpy()[order], variant, strategy) | {"part": group.column("part")[0].as_py()}
        kinds = {"part": pa.int64(), "n": pa.int64(), "base": pa.int64(), "total_bits": pa.int32(), "b": pa.int32(), "h": pa.int32(), "reversed": pa.bool_()}
        return pa.table({k: pa.array([row[k]], kinds.get(k, pa.binary())) for k in NAMES})

    return rows.groupBy("part").applyInArrow(run, FIELDS)


def decode(blocks: DataFrame, variant: str = "bstar", size: int = DEFAULT_SIZE, unsigned: bool = False) -> DataFrame:
    """(pos, value); no exchange."""
    ship(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v = decode_block(row, variant)
                yield pa.RecordBatch.from_arrays([pa.array(row["part"] * size + np.arange(len(v))), pa.array(v)], names=["pos", "value"])

    return _as_read(blocks.select(*NAMES).mapInArrow(run, "pos long, value long"), unsigned)


def lookup(blocks: DataFrame, positions: DataFrame, variant: str, size: int, unsigned: bool = False) -> DataFrame:
    """(pos, value) for (pos): positions meet their block by an equi-join on part, and each block is decoded once for all of its positions."""
    ship(blocks.sparkSession)
    asked = positions.select("pos", F.expr(f"pos div {size}").alias("part"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pos = left.column("pos").to_numpy()
        if not len(pos) or not right.num_rows:
            return pa.table({"pos": pa.array([], pa.int64()), "value": pa.array([], pa.int64())})
        v = decode_block(right.to_pylist()[0], variant)
        i = pos % size
        ok = i < len(v)
        return pa.table({"pos": pos[ok], "value": v[i[ok]]})

    return _as_read(asked.groupBy("part").cogroup(blocks.select(*NAMES).groupBy("part")).applyInArrow(run, "pos long, value long"), unsigned)
