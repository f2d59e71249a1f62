"""Near-duplicate vectors by PCA-ordered tiled comparison, and nearest neighbours by cross-polytope hashing.

Vectors that are null, zero, or hold null or non-finite components take no part: they link with nothing, are asked for nothing and
found by nothing. Vectors of different lengths are never compared; those of each length are compared with one another. Equal vectors are collapsed first and counted, so copies never meet one
another in a task. Rows that repeat an id count once (the least vector stands). Rows with a null id are left out. Further columns are not read. An empty
table gives no rows. Components of any size that a double can hold are fine: rows are scaled by powers of two before norms are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import connected_components, keep

TILE = 1024
BLOCK_ROWS = 8192
STEPS = (16, 32)
SLACK = 1e-4


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): one row per id that takes part, v as array of float or, from other types, of double."""
    single = table.schema[vector_col].dataType == T.ArrayType(T.FloatType(), table.schema[vector_col].dataType.containsNull)
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(finite & nonzero, F.lit(False))).groupBy("id").agg(F.min("v").alias("v"))
    return rows


def length() -> Column:
    return F.size("v").alias("d")


def most_common_length(rows: DataFrame) -> int:
    top = rows.groupBy(length()).count().orderBy(F.desc("count"), "d").first()
    return top["d"] if top else 0


def blocks_by_length(rows: DataFrame, block_rows: int) -> Column:
    """How many blocks of about ``block_rows`` the vectors of a row's length fill; lengths that fill one block are not gathered."""
    many = rows.groupBy(length()).count().where(F.col("count") > block_rows).collect()
    if not many:
        return F.lit(1)
    known = F.create_map(*(F.lit(x) for r in many for x in (r["d"], round(r["count"] / block_rows))))
    return F.coalesce(F.try_element_at(known, F.size("v")), F.lit(1))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component between a half and one; exact, so cosines stay as they are."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None]) if len(v) else v


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def collapse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors as rep, v, n; members as id, rep): rep is the least id that has the vector."""
    groups = keep(rows.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    copied = groups.where("n > 1").select("v", F.col("rep").alias("first"))
    member = rows.join(copied, "v", "left").select("id", F.coalesce("first", "id").alias("rep"))
    return groups.select("rep", "v", "n"), member


def principal_axes(distinct: DataFrame, d: int) -> np.ndarray:
    """Eigenvectors (columns, largest first) of the mean outer product of the unit vectors; one d*d matrix per task is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = scaled(_matrix(batch.column(0), d))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["i", "s"])

    sums = distinct.select("v").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(d * d)
    for r in sums:
        total[r["i"]] = r["s"]
    _, axes = np.linalg.eigh(total.reshape(d, d))
    return axes[:, ::-1].copy()


class Block:
    """Unit vectors in PCA order, with leading parts that carry the norm of what they leave out as one more component."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, n: np.ndarray, axes: np.ndarray | None):
        v = scaled(v)
        norms = np.linalg.norm(v, axis=1)
        self.ids, self.v, self.n, self.norms = ids, v, n, norms
        turned = v / norms[:, None]
        if axes is not None:
            turned = turned @ axes
        self.leads = []
        for k in STEPS:
            if k < v.shape[1]:
                rest = np.sqrt(np.maximum(0, 1 - (turned[:, :k] ** 2).sum(1)))
                self.leads.append(np.column_stack([turned[:, :k], rest]).astype(np.float32))
        if not self.leads:
            self.leads.append(np.column_stack([turned, np.zeros(len(v))]).astype(np.float32))


def tile_links(a: Block, b: Block, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine at least the threshold, tile by tile.

    The first product covers the leading dimensions and the product of what both leave out, which bounds the cosine from above (Cauchy-Schwarz). Where no
    pair of a tile can reach the threshold, the tile is done; pairs that can go on to more dimensions and at last to the exact cosine in double precision.
    """
    least = np.float32(threshold - SLACK)
    for i in range(0, len(a.ids), TILE):
        for j in range(i if same else 0, len(b.ids), TILE):
            bound = a.leads[0][i : i + TILE] @ b.leads[0][j : j + TILE].T
            x, y = np.nonzero(bound >= least)
            if same and i == j:
                use = x < y
                x, y = x[use], y[use]
            x, y = x + i, y + j
            for lead_a, lead_b in zip(a.leads[1:], b.leads[1:]):
                if not len(x):
                    break
                ok = np.concatenate([np.einsum("ij,ij->i", lead_a[x[s : s + 65536]], lead_b[y[s : s + 65536]]) for s in range(0, len(x), 65536)]) >= least
                x, y = x[ok], y[ok]
            for s in range(0, len(x), 65536):
                p, q = x[s : s + 65536], y[s : s + 65536]
                cosine = np.einsum("ij,ij->i", a.v[p], b.v[q]) / (a.norms[p] * b.norms[q])
                ok = cosine >= threshold
                if ok.any():
                    yield p[ok], q[ok]


def near_duplicates(table: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per id, of all pairs with cosine >= threshold.

    Blocks of about BLOCK_ROWS distinct vectors of one length are compared pairwise, one task for each pair of blocks; a task gives back counts and a spanning forest of
    its links, a row for each vector that has one, never the pairs. The axes are those of the most common length; the bounds hold in any
    order of dimensions, so vectors of other lengths are taken as they come.
    """
    ids = table.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    rows = usable(table, id_col, vector_col)
    distinct, member = collapse(rows)
    main = most_common_length(distinct)
    if main == 0:
        return ids.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    shared = table.sparkSession.sparkContext.broadcast(principal_axes(distinct.where(F.size("v") == main), main))
    placed = distinct.select("rep", "v", "n", length(), blocks_by_length(distinct, BLOCK_ROWS).alias("m"))
    placed = placed.withColumn("k", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int"))
    # a vector of block k goes to the pairs (i, k) and (k, j)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least(o, "k").alias("i"), F.greatest(o, "k").alias("j"))))
    spread = placed.select("rep", "v", "n", "d", "k", pair.alias("p")).select("rep", "v", "n", "d", "k", "p.i", "p.j")

    def compare(group: pa.Table) -> pa.Table:
        d, i, j = (group.column(c)[0].as_py() for c in ("d", "i", "j"))
        group = group.combine_chunks()
        k = group.column("k").to_numpy()
        rep, n, v = group.column("rep").to_numpy(), group.column("n").to_numpy(), _matrix(group.column("v"), d)

        def block(which: int) -> Block:
            at = np.flatnonzero(k == which)
            at = at[np.argsort(rep[at], kind="stable")]
            return Block(rep[at], v[at], n[at], shared.value if d == main else None)

        a = block(i)
        b = a if i == j else block(j)
        na, nb = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        shift = 0 if i == j else len(a.ids)
        everyone = a.ids if i == j else np.concatenate([a.ids, b.ids])
        order = np.argsort(everyone, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = np.arange(len(order))
        for x, y in tile_links(a, b, i == j, threshold):
            np.add.at(na, x, b.n[y])
            np.add.at(nb, y, a.n[x])
            p, q = place[x], place[y + shift]
            differ = root[p] != root[q]
            if differ.any():
                root = _spanning_from(root, p[differ], q[differ])
        links = na + nb if i == j else np.concatenate([na, nb])
        least = everyone[order][root][place]
        some = links > 0
        return pa.table({"rep": everyone[some], "links": links[some], "least": least[some]})

    parts = keep(spread.groupBy("d", "i", "j").applyInArrow(compare, "rep long, links long, least long"))
    counts = parts.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(parts.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    of_rep = (
        distinct.select("rep", "n").join(counts, "rep", "left").join(component, F.col("rep") == F.col("id"), "left")
        .select("rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    found = member.join(of_rep, "rep").select("id", "n_links", "component_id")
    return (
        ids.join(found, "id", "left")
        .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def _spanning_from(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root`` after joining what x and y pair up."""
    while True:
        p, q = root[x], root[y]
        use = p != q
        if not use.any():
            return root
        x, y, p, q = x[use], y[use], p[use], q[use]
        low = np.minimum(p, q)
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        while not (root[root] == root).all():
            root = root[root]
