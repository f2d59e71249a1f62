"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform) turns a unit vector, and the signed axis nearest to it is its hash; two
rotations make a bucket, and each table has rotations of its own. A query looks into the buckets whose two axes lose it least (multiprobe); the union of what lies
there over all tables is ranked by the exact inner product in double precision on the original vectors. An exact check follows: the last of the best so far is a
bar, and every vector that no probe met is ranked too unless its cosine in single precision, with the largest error that can have, shows it to be below
the bar. So the probes set the bar and the result is that of brute force, whatever the vectors. Nearness is the inner product; where norms
differ, vectors first get one more component that makes all norms equal and keeps inner products with queries, so that angles rank as inner products do.

The more vectors there are, the nearer the nearest are and the fewer buckets it takes to find them, so the number of probes falls with the number of
vectors (``probes``), and with it the share of all vectors that they meet: of uniformly distributed vectors in 64 dimensions a quarter of 2,000 and
a tenth of 50,000. The probes alone find nine tenths of the nearest there, and far fewer in more dimensions or where norms differ much. A query whose
probes meet fewer vectors in a block than were asked for meets all of that block.

The index is sharded: every block of about BLOCK_BYTES of vectors holds its own tables over all of its rows, and blocks of queries visit every block of
vectors, so no bucket, however full, ends up in one task. Only the best of each block leave it. Equal vectors are collapsed to one with its least ids, as many as can be
asked for. Recall of the probes alone and the share that they meet are measured in the tests, and the whole search is held against brute force. How
unusable vectors, vectors of different lengths, repeated ids and empty tables are treated is said in ``vectors``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import keep
from seqloom.llm.vectors import _matrix, blocks_by_length, collapse, length, most_common_length, scaled, usable

TABLES = 32
#: Probes a table are about PROBES / n ** FALL, never fewer than LEAST_PROBES.
PROBES, FALL, LEAST_PROBES = 2400, 0.38, 8
#: Axes of either rotation that probes are made of, nearest first, and dimensions that the second rotation hashes at most.
AXES, SECOND = 40, 64
BLOCK_BYTES, QUERY_ROWS = 16 << 20, 1024
SALTS = 64
#: Queries whose cosines with a block are taken at once, and the magnitude from whose inverse on scores are too near the ends of double precision to be bounded.
CHECKED, LARGE = 64, 1e290


def probes(n: int) -> int:
    """How many buckets of each table a query looks into, of ``n`` vectors."""
    return max(LEAST_PROBES, round(PROBES / max(n, 1) ** FALL))


def _hadamard(size: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h


def rotate(x: np.ndarray, turn: int) -> np.ndarray:
    """Three rounds of signs and Hadamard transform; the number of columns is a power of two.

    The transform of d = a * b is the one of b along rows and the one of a along columns of an a by b matrix.
    """
    rng = np.random.default_rng([turn, 4271])
    n, d = x.shape
    a = 1 << (d.bit_length() - 1) // 2
    left, right = _hadamard(a) / np.float32(np.sqrt(a)), _hadamard(d // a) / np.float32(np.sqrt(d // a))
    for _ in range(3):
        x = x * rng.choice((-1.0, 1.0), d).astype(x.dtype)
        x = (x.reshape(-1, d // a) @ right).reshape(n, a, -1)
        x = (x.swapaxes(1, 2).reshape(-1, a) @ left).reshape(n, -1, a).swapaxes(1, 2).reshape(n, d)
    return x


def losses(x: np.ndarray) -> np.ndarray:
    """How much farther each signed axis (axis, then its negative) is than the nearest."""
    both = np.stack([x, -x], 2).reshape(len(x), -1)
    return both.max(1, keepdims=True) - both


def directions(v: np.ndarray, largest: float, unit: float, query: bool) -> np.ndarray:
    """Unit vectors padded to a power of two; with the extra component if ``largest``, the largest norm in units of ``unit``, is given."""
    if largest and query:
        v = np.column_stack([scaled(v), np.zeros(len(v))])
    elif largest:
        v = v / unit
        v = np.column_stack([v, np.sqrt(np.maximum(0, largest**2 - (v**2).sum(1)))])
    v = scaled(v)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    size = max(2, 1 << (v.shape[1] - 1).bit_length())
    return np.pad(v, ((0, 0), (0, size - v.shape[1]))).astype(np.float32)


def units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in single precision, and the norms of the rows as ``scaled`` returns them."""
    v = scaled(v)
    norms = np.linalg.norm(v, axis=1)
    return (v / norms[:, None]).astype(np.float32), norms


class Index:
    """Tables over one block of vectors: what lies in a bucket is next to each other in ``order``."""

    def __init__(self, v: np.ndarray, largest: float = 0.0, unit: float = 1.0):
        self.v, self.largest, self.unit = v, largest, unit
        x = directions(v, largest, unit, False)
        self.second = min(x.shape[1], SECOND)
        self.codes = np.empty((TABLES, len(v)), np.int64)
        self.order = np.empty((TABLES, len(v)), np.int64)
        for t in range(TABLES):
            one, two = self._losses(x, t)
            code = one.argmin(1) * 2 * self.second + two.argmin(1)
            self.order[t] = np.argsort(code, kind="stable")
            self.codes[t] = code[self.order[t]]
        exponents = np.frexp(np.abs(v).max(1))[1]
        self.highest = exponents.max()
        self.units, norms = units(v)
        self.norms = np.ldexp(norms, exponents - self.highest)

    def _losses(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        return losses(rotate(x, 2 * t)), losses(rotate(x, 2 * t + 1)[:, : self.second])

    def _buckets(self, x: np.ndarray, t: int, many: int) -> np.ndarray:
        """The codes of the ``many`` buckets whose axes lose least, in squares."""
        sides = []
        for loss in self._losses(x, t):
            few = min(AXES, loss.shape[1])
            axes = np.argpartition(loss, few - 1, axis=1)[:, :few]
            sides.append((axes, np.take_along_axis(loss, axes, 1) ** 2))
        (one, lost), (two, more) = sides
        both = (lost[:, :, None] + more[:, None, :]).reshape(len(x), -1)
        many = min(many, both.shape[1])
        best = np.argpartition(both, many - 1, axis=1)[:, :many]
        across = two.shape[1]
        return np.take_along_axis(one, best // across, 1) * 2 * self.second + np.take_along_axis(two, best % across, 1)

    def candidates(self, queries: np.ndarray, many: int, least: int) -> Iterator[np.ndarray]:
        """For each query the places, ascending, of what lies in ``many`` buckets of each table; all places if fewer than ``least`` do."""
        n = len(self.v)
        x = directions(queries, self.largest, self.unit, True)
        first, size = [], []
        for t in range(TABLES):
            codes = self._buckets(x, t, many)
            low = np.searchsorted(self.codes[t], codes)
            first.append(low + t * n)
            size.append(np.searchsorted(self.codes[t], codes, "right") - low)
        first, size = np.concatenate(first, 1), np.concatenate(size, 1)
        flat, seen = self.order.ravel(), np.zeros(n, bool)
        for at, many_there in zip(first, size):
            some = many_there > 0
            at, many_there = at[some], many_there[some]
            ends = np.cumsum(many_there)
            steps = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - many_there), many_there)
            seen[:] = False
            seen[flat[steps]] = True
            found = np.flatnonzero(seen)
            yield found if len(found) >= least else np.arange(n)

    def missed(self, q: np.ndarray, norm: float, cosines: np.ndarray, at: np.ndarray, bar: float) -> np.ndarray:
        """The places beside ``at`` whose inner product with ``q`` may reach ``bar``; all of them where scores are too near the ends of double precision."""
        highest = np.frexp(np.abs(q).max())[1]
        part, exponent = np.frexp(bar)
        with np.errstate(over="ignore", under="ignore"):
            need, scale = np.ldexp(part / norm, exponent - highest - self.highest), np.ldexp(1.0, highest + self.highest)
        if all(1 / LARGE < abs(x) < LARGE for x in (bar, need, scale)):
            # twice what rounding the components and adding up their products can be off by
            slack = np.float32((len(q) + 8) * 2.0**-23)
            may = (cosines + slack) * self.norms >= need
        else:
            may = np.ones(len(self.v), bool)
        may[at] = False
        return np.flatnonzero(may)

    def search(self, queries: np.ndarray, ids: np.ndarray, k: int, many: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (places, scores) of the k best of the block, ties to the smaller id: its candidates, then what else may reach the last of their best."""
        places = self.candidates(queries, many, k)
        for i in range(0, len(queries), CHECKED):
            asked = queries[i : i + CHECKED]
            directed, norms = units(asked)
            for q, norm, cosines, at in zip(asked, norms, directed @ self.units.T, places):
                score = self.v[at] @ q
                if len(at) < len(self.v):
                    more = self.missed(q, norm, cosines, at, np.partition(score, len(at) - k)[len(at) - k])
                    at, score = np.concatenate([at, more]), np.concatenate([score, self.v[more] @ q])
                if len(at) > k:
                    bar = np.partition(score, len(at) - k)[len(at) - k]
                    some = score >= bar
                    at, score = at[some], score[some]
                best = np.lexsort((ids[at], -score))[:k]
                yield at[best], score[best]


def least_ids(member: DataFrame, k: int) -> DataFrame:
    """(rep, ids): the k least ids of every vector that occurs more than once; reduced in batches, then by salted groups."""

    def few(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.sort_values("id")
            got = f.groupby("rep")["id"].apply(lambda x: x.head(k).tolist())
            yield pd.DataFrame({"rep": got.index.astype("int64"), "ids": got.to_numpy()})

    merge = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k).alias("ids")
    parts = member.select("id", "rep").mapInPandas(few, "rep long, ids array<long>")
    salted = parts.groupBy("rep", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).alias("salt")).agg(merge)
    return salted.groupBy("rep").agg(merge).where(F.size("ids") > 1)


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row for which ``is_query`` (on the column ``id``) holds; itself never."""
    distinct, member = collapse(usable(table, id_col, vector_col))
    member = keep(member)
    asked = member.where(is_query)
    size = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    unit = float(distinct.agg(F.max(size).alias("u")).first()["u"] or 1.0)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.lit(unit)) * (x / F.lit(unit))))
    stats = distinct.agg(F.count("*").alias("n"), F.min(norm).alias("lo"), F.max(norm).alias("hi")).first()
    largest = float(stats["hi"]) if stats["n"] and stats["lo"] < 0.99 * stats["hi"] else 0.0
    many = probes(stats["n"])
    queries = keep(distinct.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v"))
    block_rows = max(1, BLOCK_BYTES // (8 * max(1, most_common_length(distinct))))
    cblocks, qblocks = blocks_by_length(distinct, block_rows), blocks_by_length(queries, QUERY_ROWS)
    block = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = queries.select("rep", "v", length(), F.lit(True).alias("q"), block(qblocks, 3).alias("i"), to_all(cblocks).alias("j"))
    right = distinct.select("rep", "v", length(), F.lit(False).alias("q"), to_all(qblocks).alias("i"), block(cblocks, 5).alias("j"))
    most = k + 1

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group.column("q").to_numpy()
        rep, v = group.column("rep").to_numpy(), _matrix(group.column("v"), group.column("d")[0].as_py())
        order = np.argsort(rep, kind="stable")
        asks, rep, v = asks[order], rep[order], v[order]
        ask_of, found, scores = [], [], []
        if asks.any() and not asks.all():
            ids, mine = rep[~asks], rep[asks]
            for me, (at, score) in zip(mine, Index(v[~asks], largest, unit).search(v[asks], ids, most, many)):
                ask_of.append(np.full(len(at), me))
                found.append(ids[at])
                scores.append(score)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"ask": join(ask_of, np.int64), "rep": join(found, np.int64), "score": join(scores, float)})

    hits = left.unionByName(right).groupBy("d", "i", "j").applyInArrow(search, "ask long, rep long, score double")
    best = lambda what: W.partitionBy("ask").orderBy(F.desc("score"), what)
    hits = hits.withColumn("r", F.row_number().over(best("rep"))).where(F.col("r") <= most).drop("r")
    ids = least_ids(member.join(distinct.where("n > 1").select("rep"), "rep", "left_semi"), most)
    each = hits.join(ids, "rep", "left").select("ask", "score", F.explode(F.coalesce("ids", F.array("rep"))).alias("vec_id"))
    each = each.withColumn("r", F.row_number().over(best("vec_id"))).where(F.col("r") <= most)
    lists = each.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    answered = asked.join(lists, F.col("rep") == F.col("ask")).select(
        F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("near")
    )
    out = answered.select("query_id", F.posexplode("near").alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")
