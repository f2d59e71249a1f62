"""Independent SQL for the registered queries, for DuckDB. Blocks hold 4096 elements unless a query says otherwise."""

from __future__ import annotations

CENTS = "SELECT event_id AS pos, CAST(round(value * 100) AS BIGINT) AS v FROM events"
TIMES = "SELECT event_id AS pos, epoch_us(ts) AS v FROM events"
CUSTOMERS = "SELECT o_orderkey AS pos, o_custkey AS v FROM orders"
BALANCES = "SELECT c_custkey AS pos, CAST(round(c_acctbal * 100) AS BIGINT) AS v FROM customer"
SHIP_DAYS = """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey) - 1 AS pos,
    CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS v FROM lineitem"""


def bits(x: str) -> str:
    return f"length(ltrim(bin({x}), '0'))"


def bytes_(x: str) -> str:
    return f"(({x}) + 7) // 8"


def frame(sequence: str, size: int = 4096) -> str:
    """CTEs m (a row for each block) and f (a row for each element)."""
    return f"""
    s AS ({sequence}), p AS (SELECT pos // {size} AS part, pos, pos % {size} AS i, v FROM s),
    m AS (SELECT part, min(v) AS base, max(v) AS mx, count(*) AS n,
        CAST(CASE WHEN min(v) = max(v) THEN 1 ELSE {bits('max(v) - min(v)')} END AS BIGINT) AS tb,
        CAST(CASE WHEN min(v) = max(v) THEN 1 ELSE {bits('max(v) - min(v) + 1')} END AS BIGINT) AS tbr FROM p GROUP BY part),
    f AS (SELECT p.part, p.pos, p.i, p.v, m.base, m.mx, m.n, m.tb, m.tbr, p.v - m.base AS x,
        coalesce(lag(p.v) OVER (PARTITION BY p.part ORDER BY p.pos) - m.base, 0) AS px FROM p JOIN m ON p.part = m.part)"""


RULES = {
    "none": "false",
    "two": "(i = 0 OR abs(g) + 2 > tb - b)",
    "one": "(i = 0 OR abs(g) + 1 > greatest(tb - b, 0))",
}


def counters(rule: str, candidates: str, name: str = "c") -> str:
    """CTE with the nine counters of f for the split points that ``candidates`` (a FROM item with part and b) lists."""
    exc = RULES[rule]
    return f"""
    {name}_g AS (SELECT f.part, f.i, f.n, f.tb, k.b, (f.x >> CAST(k.b AS INT)) - (f.px >> CAST(k.b AS INT)) AS g FROM f JOIN {candidates} k ON f.part = k.part),
    {name} AS (SELECT part, n, tb, b, CAST(count(*) FILTER (g >= 0) AS BIGINT) AS pg, CAST(count(*) FILTER (g < 0) AS BIGINT) AS ng,
        CAST(count(*) FILTER (g = 0 AND i > 0) AS BIGINT) AS zg, CAST(count(*) FILTER (g >= 0 AND {exc}) AS BIGINT) AS pe,
        CAST(count(*) FILTER (g < 0 AND {exc}) AS BIGINT) AS ne, CAST(coalesce(sum(g) FILTER (g >= 0), 0) AS BIGINT) AS sp,
        CAST(coalesce(sum(-g) FILTER (g < 0), 0) AS BIGINT) AS sn, CAST(coalesce(sum(g) FILTER (g >= 0 AND NOT {exc}), 0) AS BIGINT) AS spx,
        CAST(coalesce(sum(-g) FILTER (g < 0 AND NOT {exc}), 0) AS BIGINT) AS snx FROM {name}_g GROUP BY part, n, tb, b)"""


def every(first: str = "0", last: str = "tb") -> str:
    return f"(SELECT part, unnest(range({first}, {last} + 1)) AS b FROM m)"


NINE = """pg AS positive_gaps, ng AS negative_gaps, zg AS zero_gaps, pe AS positive_exceptions, ne AS negative_exceptions,
    sp AS sum_pos, sn AS sum_neg, spx AS sum_pos_no_exc, snx AS sum_neg_no_exc"""

PLAIN = {v: f"{bytes_('n * tb')} + {8 + k}" for v, k in (("u", 3), ("b", 2), ("bstar", 2))}


def _split_cost(exc: str, sums: tuple[str, ...], fields: int, plain: str) -> str:
    gaps = " + ".join(bytes_(f"{s} + n - ({exc})") for s in sums)
    return f"CASE WHEN b >= tb OR ({exc}) = 0 OR ({exc}) > n THEN {plain} ELSE {bytes_('n * b')} + {bytes_(f'({exc}) * (tb - b)')} + {bytes_('n')} + {gaps} + {8 + fields} END"


COST_B = _split_cost("pe + ne", ("spx", "snx"), 2, PLAIN["b"])
COST_U = _split_cost("pe + ng", ("spx",), 3, PLAIN["u"])
COST_UR = _split_cost("pg - zg + ne", ("snx",), 3, PLAIN["u"])
COST_S = f"CASE WHEN pg + ng = 0 THEN 10 ELSE 10 + {bytes_('(pg + ng) * b')} + CASE WHEN b < tb THEN {bytes_('sp + pg + ng')} + {bytes_('sn + pg + ng')} ELSE 0 END END"

#: Variation of the values themselves, and the estimates made of it.
VARIATION = """
    v AS (SELECT part, n, tb, sum(CASE WHEN n >= 2 AND x >= px THEN x - px ELSE 0 END) AS up, sum(CASE WHEN n >= 2 AND x < px THEN px - x ELSE 0 END) AS down
        FROM f GROUP BY part, n, tb),
    e AS (SELECT part, n, tb, CASE WHEN up + down > 0 THEN log2(ln(2.0) * CAST(up + down AS DOUBLE) / n) END AS x, CASE WHEN up // n > 0 THEN log2(CAST(up // n AS DOUBLE)) END AS xu FROM v)"""


def clamp(x: str) -> str:
    return f"coalesce(least(tb, greatest(0, CAST(round({x}) AS BIGINT))), 0)"


def pick(candidates: str) -> str:
    """One choice per block from (part, n, tb, b, rev, cost, rank)."""
    return f"""SELECT part, n, tb AS total_bits, CAST(b AS BIGINT) AS b, CAST(tb - b AS BIGINT) AS h, rev AS reversed, CAST(cost AS BIGINT) AS theoretical_bytes
        FROM ({candidates}) QUALIFY row_number() OVER (PARTITION BY part ORDER BY cost, rank) = 1"""


def split_rle(sequence: str, size: int = 4096) -> str:
    lcp = f"CASE WHEN x = px THEN tbr ELSE tbr - {bits('xor(x, px)')} END"
    return f"""WITH {frame(sequence, size)}, l AS (SELECT part, i, {lcp} AS lcp FROM f),
        k AS (SELECT part, n, tbr, unnest(range(0, tbr + 1)) AS h FROM m),
        r AS (SELECT k.part, k.n, k.tbr, k.h, 1 + count(*) FILTER (l.i > 0 AND l.lcp < k.h) AS runs FROM k JOIN l ON k.part = l.part GROUP BY k.part, k.n, k.tbr, k.h),
        c AS (SELECT *, CASE WHEN h = 0 THEN n * tbr ELSE n * (tbr - h + 1) + runs * h END AS cost FROM r)
        SELECT part, n, tbr AS total_bits, CAST(tbr - h AS BIGINT) AS b, CAST(h AS BIGINT) AS h, false AS reversed,
            CAST(CASE WHEN h = 0 THEN {bytes_('n * tbr')} + 10 ELSE {bytes_('n * (tbr - h)')} + {bytes_('runs * h')} + {bytes_('n')} + 10 END AS BIGINT) AS theoretical_bytes
        FROM c QUALIFY row_number() OVER (PARTITION BY part ORDER BY cost, h) = 1"""


def split_b_optimal(sequence: str, size: int = 4096) -> str:
    return f"""WITH {frame(sequence, size)}, {counters('two', every('1', 'tb - 1'))}
        {pick(f"SELECT part, n, tb, tb AS b, false AS rev, {PLAIN['b']} AS cost, -1 AS rank FROM m UNION ALL SELECT part, n, tb, b, false, {COST_B}, b FROM c")}"""


def split_u_optimal(sequence: str, size: int = 4096) -> str:
    return f"""WITH {frame(sequence, size)}, {counters('one', every('1', 'tb - 1'))}
        {pick(f'''SELECT part, n, tb, tb AS b, false AS rev, {PLAIN['u']} AS cost, -1 AS rank FROM m
            UNION ALL SELECT part, n, tb, b, false, {COST_U}, 2 * b FROM c UNION ALL SELECT part, n, tb, b, true, {COST_UR}, 2 * b + 1 FROM c''')}"""


def split_b_approx(sequence: str, size: int = 4096) -> str:
    return f"""WITH {frame(sequence, size)}, {VARIATION}, w AS (SELECT part, {clamp('x')} AS lo, {clamp('x + 1')} AS hi FROM e),
        {counters('two', '(SELECT part, lo AS b FROM w UNION SELECT part, hi FROM w)')}
        {pick(f'''SELECT c.part, n, tb, b, false AS rev, {COST_B} AS cost, CASE WHEN b = lo THEN 0 ELSE 1 END AS rank FROM c JOIN w ON c.part = w.part
            UNION ALL SELECT part, n, tb, tb, false, {PLAIN['b']}, 2 FROM m''')}"""


def split_u_approx(sequence: str, size: int = 4096) -> str:
    return f"""WITH {frame(sequence, size)}, {VARIATION}, w AS (SELECT part, {clamp('xu')} AS lo, {clamp('xu + 1')} AS hi FROM e),
        {counters('one', '(SELECT part, lo AS b FROM w UNION SELECT part, hi FROM w)')},
        k AS (SELECT c.*, lo, hi, {COST_U} AS cf, {COST_UR} AS cr FROM c JOIN w ON c.part = w.part),
        a AS (SELECT part, {PLAIN['u']} < least(min(cf) FILTER (b = lo), min(cr) FILTER (b = lo)) AS early FROM k GROUP BY part, n, tb)
        {pick(f'''SELECT k.part, n, tb, b, false AS rev, cf AS cost, CASE WHEN b = lo THEN 0 ELSE 2 END AS rank FROM k JOIN a ON k.part = a.part WHERE NOT early
            UNION ALL SELECT k.part, n, tb, b, true, cr, CASE WHEN b = lo THEN 1 ELSE 3 END FROM k JOIN a ON k.part = a.part WHERE NOT early
            UNION ALL SELECT part, n, tb, tb, false, {PLAIN['u']}, 4 FROM m''')}"""


def split_bstar_optimal(sequence: str, size: int = 4096) -> str:
    return f"""WITH {frame(sequence, size)}, {VARIATION},
        w AS (SELECT part, CAST(CASE WHEN x IS NULL THEN 0 ELSE least(tb, greatest(0, floor(x) - 1)) END AS BIGINT) AS lo,
            CAST(CASE WHEN x IS NULL THEN 0 ELSE greatest(0, least(tb, ceil(x) + 3)) END AS BIGINT) AS hi FROM e),
        {counters('none', '(SELECT part, unnest(range(lo, greatest(lo, hi) + 1)) AS b FROM w)')}
        {pick(f"SELECT part, n, tb, b, false AS rev, CASE WHEN n < 2 THEN 10 ELSE {COST_S} END AS cost, b AS rank FROM c UNION ALL SELECT part, n, tb, tb, false, {PLAIN['bstar']}, 1000 FROM m")}"""


def split_bstar_approx(sequence: str, size: int = 4096) -> str:
    return f"""WITH {frame(sequence, size)}, {VARIATION},
        w AS (SELECT part, x IS NULL OR floor(x) = ceil(x) AS sure, CAST(CASE WHEN x IS NULL THEN 0 ELSE least(tb, greatest(0, floor(x))) END AS BIGINT) AS lo,
            CAST(CASE WHEN x IS NULL THEN 0 ELSE greatest(0, least(tb, ceil(x))) END AS BIGINT) AS hi FROM e),
        {counters('none', '(SELECT part, unnest(range(lo, greatest(lo, hi) + 1)) AS b FROM w)')}
        {pick(f'''SELECT c.part, n, tb, b, false AS rev, CASE WHEN n < 2 AND NOT sure THEN 10 ELSE {COST_S} END AS cost, b AS rank FROM c JOIN w ON c.part = w.part
            UNION ALL SELECT m.part, n, tb, tb, false, {PLAIN['bstar']}, 1000 FROM m JOIN w ON m.part = w.part WHERE NOT sure''')}"""


SPLITS = {
    "rle_optimal": split_rle, "u_optimal": split_u_optimal, "u_approximate": split_u_approx, "b_optimal": split_b_optimal,
    "b_approximate": split_b_approx, "bstar_optimal": split_bstar_optimal, "bstar_approximate": split_bstar_approx,
}


def encoded(sequence: str, split: str, exc: str, size: int = 4096, shift: str = "g") -> str:
    """CTE z: elements with high, low, gap and flag under the choice of ``split``."""
    inner = frame(sequence, size)
    return f"""{inner}, o AS ({split}), y AS (SELECT f.part, f.pos, f.i, f.n, f.base, o.b, o.h, o.reversed, f.x >> CAST(o.b AS INT) AS hi,
            f.x & ((CAST(1 AS BIGINT) << CAST(o.b AS INT)) - 1) AS low, (f.x >> CAST(o.b AS INT)) - (f.px >> CAST(o.b AS INT)) AS g FROM f JOIN o ON f.part = o.part),
        z AS (SELECT *, h > 0 AND ({exc}) AS is_exception FROM y)"""


EXC = {
    "rle": "i = 0 OR g <> 0",
    "u": "i = 0 OR (CASE WHEN reversed THEN -g ELSE g END) < 0 OR (CASE WHEN reversed THEN -g ELSE g END) >= h",
    "b": "i = 0 OR abs(g) + 2 > h",
    "bstar": "false",
}


def _plain(sequence: str, where: str = "true", value: str = "v AS value") -> str:
    return f"SELECT pos, {value} FROM ({sequence}) WHERE {where}"


def _totals(split: str, names: str = "") -> str:
    return f"SELECT {names}CAST(sum(n) AS BIGINT) AS n, count(*) AS blocks, CAST(sum(theoretical_bytes) + 16 AS BIGINT) AS total_bytes FROM ({split})"


COMPONENTS = f"""k AS (SELECT part, n, CAST(b AS BIGINT) AS b, CAST(h AS BIGINT) AS h, n * b AS low_bits, count(*) FILTER (is_exception) AS highs,
        CASE WHEN h > 0 THEN n ELSE 0 END AS flag_bits,
        CASE WHEN h > 0 THEN coalesce(sum(g) FILTER (g > 0 AND NOT is_exception), 0) + count(*) FILTER (NOT is_exception) ELSE 0 END AS up_bits,
        CASE WHEN h > 0 THEN coalesce(sum(-g) FILTER (g < 0 AND NOT is_exception), 0) + count(*) FILTER (NOT is_exception) ELSE 0 END AS down_bits
        FROM z GROUP BY part, n, b, h)"""
COMPONENT_COLUMNS = f"""part, n, b, h, CAST(low_bits AS BIGINT) AS low_bits, highs, CAST(flag_bits AS BIGINT) AS flag_bits, CAST(up_bits AS BIGINT) AS up_bits,
        CAST(down_bits AS BIGINT) AS down_bits, CAST({bytes_('low_bits')} + {bytes_('highs * h')} + {bytes_('flag_bits')} + {bytes_('up_bits')} + {bytes_('down_bits')} + 10 AS BIGINT) AS theoretical_bytes"""

BITS = f"WITH {frame(CENTS)}, t AS (SELECT part, pos, x % 2 AS bit FROM f)"
RANKED = "SELECT part, pos, bit, coalesce(sum(bit) OVER (PARTITION BY part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r, row_number() OVER (PARTITION BY part ORDER BY pos) - 1 AS p FROM t"


def _uniform(key: str, salt: int, seed: int = 42) -> str:
    """A number in [0, 1) from the first 28 bits of a digest."""
    return f"(CAST(('0x' || substr(md5({key} || ':{seed}:{salt}'), 1, 7)) AS BIGINT) / 268435456.0)"


CLASSIC = "CASE WHEN (mx - base + 1) // n <= 1 THEN 0 ELSE least(tb, " + bits("(mx - base + 1) // n") + " - 1) END"

SQL: dict[str, str] = {
    "flagship": f"""WITH {encoded(TIMES, split_b_optimal(TIMES, 256), EXC['b'], 256)}, {COMPONENTS}
        SELECT o.part, o.n, o.total_bits, o.b, o.h, o.theoretical_bytes, q.highs, q.up_bits, q.down_bits, q.theoretical_bytes AS encoded_bytes
        FROM o JOIN (SELECT {COMPONENT_COLUMNS} FROM k) q ON o.part = q.part""",
    "seq_block_minmax": f"WITH {frame(BALANCES, 512)} SELECT part, n, base, mx AS max FROM m",
    "seq_total_bits": f"WITH {frame(BALANCES, 512)} SELECT part, tb AS total_bits FROM m",
    "seq_total_bits_rle": f"WITH {frame('SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, CAST(quality AS BIGINT) AS v FROM labels', 64)} SELECT part, tbr AS total_bits FROM m",
    "seq_high_low_split": f"WITH {frame(CENTS)} SELECT pos, x >> 5 AS high, x & 31 AS low FROM f",
    "seq_recombine": _plain(BALANCES),
    "seq_high_gaps": f"WITH {frame(CENTS)} SELECT pos, (x >> 6) - (px >> 6) AS gap FROM f",
    "seq_lcp": f"WITH {frame(CENTS)} SELECT pos, CASE WHEN x = px THEN tbr ELSE tbr - {bits('xor(x, px)')} END AS lcp FROM f WHERE i > 0",
    "seq_lcp_histogram": f"WITH {frame(CENTS)} SELECT part, CASE WHEN x = px THEN tbr ELSE tbr - {bits('xor(x, px)')} END AS lcp, count(*) AS n_pairs FROM f WHERE i > 0 GROUP BY 1, 2",
    "seq_runs_by_h": f"""WITH {frame(CENTS)}, l AS (SELECT part, CASE WHEN x = px THEN tbr ELSE tbr - {bits('xor(x, px)')} END AS lcp FROM f WHERE i > 0),
        q AS (SELECT DISTINCT part, lcp FROM l) SELECT q.part, q.lcp + 1 AS h, 1 + (SELECT count(*) FROM l WHERE l.part = q.part AND l.lcp <= q.lcp) AS runs FROM q""",
    "seq_variation_original": f"WITH {frame(CENTS)}, {counters('none', '(SELECT part, 0 AS b FROM m)')} SELECT part, CASE WHEN n < 2 THEN 0 ELSE pg END AS positive_gaps, CASE WHEN n < 2 THEN 0 ELSE ng END AS negative_gaps, CASE WHEN n < 2 THEN 0 ELSE zg END AS zero_gaps, CASE WHEN n < 2 THEN 0 ELSE sp END AS sum_pos, CASE WHEN n < 2 THEN 0 ELSE sn END AS sum_neg FROM c",
    **{f"seq_gap_stats_{k}": f"WITH {frame(CENTS)}, {counters(r, '(SELECT part, CAST(8 AS BIGINT) AS b FROM m)')} SELECT part, b, {NINE} FROM c" for k, r in (("none", "none"), ("two_way", "two"), ("one_way", "one"))},
    "seq_gap_stats_all_b": f"WITH {frame(CENTS)}, {counters('two', every())} SELECT part, b, {NINE} FROM c",
    **{f"split_{k}": SPLITS[v](CENTS) for k, v in (("rle", "rle_optimal"), ("u_optimal", "u_optimal"), ("u_approx", "u_approximate"), ("b_optimal", "b_optimal"), ("b_approx", "b_approximate"), ("bstar_optimal", "bstar_optimal"), ("bstar_approx", "bstar_approximate"))},
    **{f"split_{k}_times": SPLITS[v](TIMES) for k, v in (("rle", "rle_optimal"), ("u_optimal", "u_optimal"), ("u_approx", "u_approximate"), ("b_optimal", "b_optimal"), ("b_approx", "b_approximate"), ("bstar_optimal", "bstar_optimal"), ("bstar_approx", "bstar_approximate"))},
    "split_ship_days": split_bstar_optimal(SHIP_DAYS),
    "split_classic": f"WITH {frame(TIMES)}, q AS (SELECT *, CAST({CLASSIC} AS BIGINT) AS b FROM m) SELECT part, n, tb AS total_bits, b, tb - b AS h, CAST({bytes_('n * b')} + {bytes_('n + ((mx - base) >> CAST(b AS INT)) + 64')} + 17 AS BIGINT) AS theoretical_bytes FROM q",
    "cost_sweep_bstar": f"WITH {frame(CENTS)}, {counters('none', every())} SELECT part, b, CAST({COST_S} AS BIGINT) AS cost FROM c",
    "cost_sweep_b": f"WITH {frame(CENTS)}, {counters('two', every())} SELECT part, b, CAST({COST_B} AS BIGINT) AS cost FROM c",
    "cost_sweep_u": f"WITH {frame(CENTS)}, {counters('one', every())} SELECT part, b, CAST(least({COST_U}, {COST_UR}) AS BIGINT) AS cost FROM c",
    "enc_rle_runs": f"WITH {encoded(CENTS, split_rle(CENTS), EXC['rle'])} SELECT part, i, b, low, CASE WHEN is_exception THEN hi END AS high, is_exception FROM z",
    "enc_u_components": f"""WITH {encoded(TIMES, split_u_optimal(TIMES), EXC['u'])} SELECT part, i, b, reversed, low, CASE WHEN is_exception THEN hi END AS high,
        CASE WHEN h > 0 AND NOT is_exception THEN CASE WHEN reversed THEN -g ELSE g END END AS gap, is_exception FROM z""",
    "enc_b_components": f"WITH {encoded(CENTS, split_b_optimal(CENTS), EXC['b'])} SELECT part, i, b, low, CASE WHEN is_exception THEN hi END AS high, CASE WHEN h > 0 AND NOT is_exception THEN g END AS gap, is_exception FROM z",
    "enc_bstar_gaps": f"WITH {encoded(CENTS, split_bstar_optimal(CENTS), EXC['bstar'])} SELECT part, i, b, low, CASE WHEN h > 0 THEN g END AS gap FROM z",
    "enc_classic_gaps": f"WITH {frame(TIMES)}, q AS (SELECT f.*, CAST({CLASSIC} AS BIGINT) AS b FROM f) SELECT part, i, b, x & ((CAST(1 AS BIGINT) << CAST(b AS INT)) - 1) AS low, (x >> CAST(b AS INT)) - (px >> CAST(b AS INT)) AS gap FROM q",
    "unary_bits": f"WITH {encoded(TIMES, split_bstar_optimal(TIMES), EXC['bstar'])} SELECT part, i, repeat('1', CAST(g AS INT)) || '0' AS code, repeat('0', CAST(g AS INT)) || '1' AS inverted FROM z WHERE h > 0 AND g >= 0",
    "size_by_variant": " UNION ALL ".join(_totals(f(CENTS), f"'{k}' AS variant, ") for k, f in SPLITS.items()),
    "bpi_ratio": f"SELECT n, total_bytes, round(total_bytes * 8 / n, 6) AS bits_per_int, round(total_bytes / (n * 8), 6) AS ratio, round(total_bytes / 1048576, 6) AS megabytes FROM ({_totals(split_bstar_optimal(CENTS))})",
    "approx_vs_optimal": f"""SELECT o.part, o.b AS b_optimal, o.theoretical_bytes AS bytes_optimal, a.b AS b_approx, a.theoretical_bytes AS bytes_approx
        FROM ({split_bstar_optimal(CENTS)}) o JOIN ({split_bstar_approx(CENTS)}) a ON o.part = a.part""",
    "partition_size_sweep": " UNION ALL ".join(
        f"SELECT '{v}' AS variant, CAST({k} AS BIGINT) AS partition_size, blocks, total_bytes FROM ({_totals(f(CENTS, k))})"
        for v, f in SPLITS.items() for k in (8000, 10000, 16000, 24000, 32000, 40000, 48000, 56000, 64000, 100000, 250000, 500000)
    ),
    "build_metrics": f"""WITH {encoded(CENTS, split_b_optimal(CENTS), EXC['b'])}, {COMPONENTS}
        SELECT count(*) AS partitions, CAST(sum(n) AS BIGINT) AS elements, CAST(sum(highs) AS BIGINT) AS exceptions, CAST(sum(b) AS BIGINT) AS sum_split, min(b) AS min_split, max(b) AS max_split, round(avg(b), 6) AS avg_split FROM k""",
    "encoded_sizes": f"WITH {encoded(CENTS, split_b_optimal(CENTS), EXC['b'])}, {COMPONENTS} SELECT {COMPONENT_COLUMNS} FROM k",
    "decode_rle": _plain(CENTS), "decode_u": _plain(TIMES), "decode_b": _plain(CENTS), "decode_bstar": _plain(TIMES), "decode_classic": _plain(TIMES),
    "point_get": _plain(CENTS, "pos = 777"),
    "at_checked": f"SELECT q.pos, CASE WHEN s.pos IS NULL THEN 'out_of_range' ELSE 'ok' END AS status, s.v AS value FROM (SELECT unnest([0, 5, 999, 1000000000, -1])::BIGINT AS pos) q LEFT JOIN ({CENTS}) s ON q.pos = s.pos",
    "get_elements": _plain(CENTS, "pos >= 100 AND pos < 350"),
    "get_elements_clamped": _plain(CENTS, "pos >= (SELECT count(*) FROM events) - 10"),
    "get_range": _plain(CENTS, "pos >= 40 AND pos < 90"),
    "batch_lookup": f"SELECT q.pos, s.v AS value FROM (SELECT (i * 7919) % (SELECT count(*) FROM events) AS pos FROM range(2000) t(i)) q JOIN ({CENTS}) s ON q.pos = s.pos",
    "packed_lookup": f"SELECT q.pos, s.v AS value FROM (SELECT (i * 104729) % (SELECT count(*) FROM events) AS pos FROM range(2000) t(i)) q JOIN ({CENTS}) s ON q.pos = s.pos",
    "no_ra_prefix": f"SELECT pos AS i, v AS value FROM ({CENTS}) WHERE pos >= 300 AND pos < 364",
    **{f"no_ra_prefix_{v}": f"SELECT pos AS i, v AS value FROM ({q}) WHERE pos >= 300 AND pos < 364" for v, q in (("rle", CENTS), ("u", TIMES), ("bstar", CENTS))},
    "block_route": f"SELECT pos, pos // 1000 AS part, pos % 1000 AS i FROM ({CENTS})",
    "bv_rank1": f"{BITS} SELECT part, pos, CAST(r AS BIGINT) AS rank1 FROM ({RANKED})",
    "bv_rank0": f"{BITS} SELECT part, pos, CAST(p - r AS BIGINT) AS rank0 FROM ({RANKED})",
    "bv_rank_range": f"{BITS} SELECT part, count(*) FILTER (bit = 1 AND pos >= 100 AND pos < 700) AS ones, count(*) FILTER (bit = 0 AND pos >= 100 AND pos < 700) AS zeros FROM t GROUP BY part",
    "bv_select1": f"{BITS} SELECT part, row_number() OVER (PARTITION BY part ORDER BY pos) AS k, pos FROM t WHERE bit = 1",
    "bv_select0": f"{BITS} SELECT part, row_number() OVER (PARTITION BY part ORDER BY pos) AS k, pos FROM t WHERE bit = 0",
    "bv_cumgap": f"""WITH {encoded(CENTS, split_bstar_optimal(CENTS), EXC['bstar'])} SELECT part, i + 1 AS k, CAST(sum(greatest(g, 0)) OVER (PARTITION BY part ORDER BY i) AS BIGINT) AS cumgap FROM z WHERE h > 0""",
    "bv_get": f"{BITS} SELECT part, bit FROM t WHERE pos = 77",
    "bv_pack": f"WITH {frame(CENTS)} SELECT part, i AS pos, x % 2 AS bit FROM f",
    "stored_metadata": "SELECT count(*) AS n, CAST(ceil(count(*) / 4096) AS BIGINT) AS blocks, count(*) = 0 AS empty, 0 AS split_point FROM events",
    "decode_unsigned": f"SELECT pos, CAST(v::HUGEINT + 9223372036854775808::HUGEINT AS DECIMAL(20,0)) AS value, CAST(v::HUGEINT + 9223372036854775808::HUGEINT AS DECIMAL(20,0)) AS packed FROM ({TIMES})",
    "bv_set": f"{BITS} SELECT part, pos, CASE WHEN pos >= 8 AND pos < 20 THEN (2741 >> CAST(pos - 8 AS INT)) & 1 WHEN pos >= 100 AND pos < 150 THEN 1 ELSE bit END AS bit FROM t",
    "bv_from_packed": f"WITH {encoded(CENTS, split_b_optimal(CENTS), EXC['b'])} SELECT part, i AS pos, CAST(is_exception AS BIGINT) AS bit FROM z WHERE h > 0",
    "limit_read": _plain(CENTS, "pos < 500"),
    "numbered_positions": _plain(SHIP_DAYS),
    "drift_source": "SELECT i AS pos, CAST(CASE WHEN i % 13 = 0 THEN 42 ELSE i // 3 - 2 * (i // 7) END AS BIGINT) AS value FROM range(1000) t(i)",
    "bench_json_mean": """SELECT 'variant' || (o_orderkey % 2) AS compressor, 1000 * (1 + o_orderkey % 4) AS partition_size, count(*) AS n_runs, round(avg(o_orderkey / 128 * 100), 6) AS ratio, round(avg(o_custkey), 6) AS speed
        FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 0 GROUP BY 1, 2""",
    "speedup_efficiency": """WITH t AS (SELECT CAST(pow(2, o_orderkey % 4) AS BIGINT) AS threads, avg(o_custkey) AS a FROM orders GROUP BY 1)
        SELECT threads, round(a, 6) AS avg_throughput, round(a / (SELECT a FROM t WHERE threads = 1), 6) AS speedup, round(a / (SELECT a FROM t WHERE threads = 1) / threads * 100, 6) AS efficiency FROM t""",
    "packed_roundtrip": _plain(CENTS),
    "binary_source": """SELECT 'a.bin' AS file, i AS pos, i * 3 - 500 AS value, CAST(2 AS BIGINT) AS decimals FROM range(1000) t(i)
        UNION ALL SELECT 'b.bin', i, 99 - i, CAST(0 AS BIGINT) FROM range(100) t(i)""",
    "random_source": f"""WITH t AS (SELECT i AS pos, {_uniform('i', 1)} < 0.3 AND i > 0 AS again FROM range(5000) t(i)),
        h AS (SELECT pos, pos - CASE WHEN again AND lag(again) OVER (ORDER BY pos) THEN 2 WHEN again THEN 1 ELSE 0 END AS head FROM t)
        SELECT pos, CAST(floor({_uniform('head', 2)} * 1001) - 500 AS BIGINT) AS value FROM h""",
    "packed_choice": f"SELECT part, n, b, h, reversed FROM ({split_u_optimal(CENTS)})",
}
