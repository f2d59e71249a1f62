"""Near-duplicate documents by ProbMinHash.

A document is the multiset of its five-word shingles (lower case, words split at white space; a document of fewer words is one shingle). Its
shingles arrive by Poisson processes whose rates are their multiplicities: every arrival falls into a random register, each register keeps the first shingle
to arrive, and arrivals later than the latest register are never generated. Two registers agree with the probability Jaccard similarity of the two
multisets, which is the plain Jaccard similarity where no shingle repeats. Bands of registers propose pairs; a pair is a link if the exact probability
Jaccard similarity of its texts is at least the threshold; classes are the connected components of links.

Documents with equal multisets are collapsed first, so a group of copies of any size is one row from there on. A bucket of a band never emits all its
pairs: first each document meets one leader, the one with the fullest buckets among those it shares any with, then, while
classes in a bucket are not joined yet, a few others; pairs within a bucket are then only formed across those classes, each pair once, must agree in registers
as linked pairs do, and crowded buckets are worked through in blocks that give back only links that join classes. Pairs of different texts that are linked
within one class need not be compared; none across classes is left out but for what banding and the registers miss (about 6 in 100,000 at the
threshold, fewer above).

Null and empty texts, and those of white space only, are alike to nothing: each is a class of its own. To classes(), rows that repeat a doc_id are one document, the
one whose text has the least hash (a null text only if there is no other), and rows with a null doc_id are left out. To deduplicate(), every row is a document of its own. Very long texts are shingled in slices. Columns other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import chunks, connected_components, keep

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
CROWDED = 100
STARS = 1
BLOCK_ROWS = 512
ROWS_AT_ONCE = 500
SLICE_WORDS = 100_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _hashes(words: list[str]) -> np.ndarray:
    """One hash for each run of SHINGLE words, from prefix sums of a polynomial in the bytes."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    up, down = _powers(1 << max(16, (len(data) + 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(data))
    n = max(1, len(starts) - SHINGLE + 1)
    starts, ends = starts[:n], ends[len(ends) - n :]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, and how often each occurs."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    step = SLICE_WORDS
    if len(words) <= step:
        return np.unique(_hashes(words), return_counts=True)
    parts = [_hashes(words[i : i + step + SHINGLE - 1]) for i in range(0, len(words) - SHINGLE + 1, step)]
    return np.unique(np.concatenate(parts), return_counts=True)


def signature(hashes: np.ndarray, counts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The first shingle to arrive in each register. Rounds go on for shingles whose next arrival can still be first somewhere."""
    first = np.full(registers, np.inf)
    holder = np.zeros(registers, np.uint64)
    n = len(hashes)
    each = max(1, -(-6 * registers // n))
    state, now, rate, who = hashes, np.zeros(n), counts.astype(float), hashes
    turn = 1
    while len(who):
        turns = np.arange(turn, turn + each, dtype=np.uint64)
        draws = mix(state[:, None] + turns[None, :] * np.uint64(_BASE))
        uniform = ((draws >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        at = now[:, None] + np.cumsum(-np.log(uniform), 1) / rate[:, None]
        slot = (mix(draws) % np.uint64(registers)).astype(np.int64)
        t, s = at.ravel(), slot.ravel()
        owner = np.repeat(who, each) if each > 1 else who
        np.minimum.at(first, s, t)
        won = first[s] == t
        holder[s[won]] = owner[won]
        last = at[:, -1]
        go = last < first.max()
        state, now, rate, who = state[go], last[go], rate[go], who[go]
        turn += each
        each = 1 if np.isfinite(first).all() else each
    return holder


def band_keys(holder: np.ndarray) -> np.ndarray:
    weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    rows = holder.reshape(BANDS, ROWS)
    return mix((mix(rows) * weights).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum over common d of 1 / sum over e of max(x_e / x_d, y_e / y_d), exactly, by sorting the ratios x/y."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    y_before = np.concatenate([[0.0], np.cumsum(y)])[np.searchsorted(ratio, ratio, "left")]
    x_from = (wa.sum() - x.sum()) + x.sum() - np.concatenate([[0.0], np.cumsum(x)])[np.searchsorted(ratio, ratio, "left")]
    y_only = wb.sum() - y.sum()
    return float((1 / (x_from / x + (y_only + y_before) / y)).sum())


def _hashed(documents: DataFrame) -> DataFrame:
    """(doc_id, text, h), h being null for null texts only."""
    h = F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("h")
    return documents.select(F.col("doc_id").cast("long"), "text", h).where("doc_id is not null")


def _repeated(rows: DataFrame) -> DataFrame:
    """(doc_id, least) of ids that occur more than once, least being the least h; written."""
    return keep(rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h").alias("least")).where("n > 1").drop("n"))


def _chosen(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` without those that stand behind another of the same doc_id; those that stay for one doc_id are equal."""
    marked = rows.join(repeated.withColumn("again", F.lit(True)), "doc_id", "left")
    return marked.where(F.col("again").isNull() | F.col("h").eqNullSafe(F.col("least"))).select(*rows.columns)


def sketch(documents: DataFrame) -> DataFrame:
    """(doc_id, h, same, bands, registers): same is equal for equal multisets, null where there is no word."""
    kind = "doc_id long, h long, same binary, bands array<long>, registers binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, ROWS_AT_ONCE):
            same, bands, registers = [], [], []
            for text in batch.column(2):
                hashes, counts = shingles(text.as_py() or "")
                if not len(hashes):
                    same.append(None), bands.append(None), registers.append(None)
                    continue
                holder = signature(hashes, counts)
                same.append(hashlib.blake2b(hashes.tobytes() + counts.tobytes(), digest_size=16).digest())
                bands.append(band_keys(holder))
                registers.append((holder & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "same", "bands", "registers"])

    return _hashed(documents).select("doc_id", "h", "text").mapInArrow(run, kind)


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = lru_cache(maxsize=64)(shingles)
        for batch in chunks(batches, ROWS_AT_ONCE):
            ok = [
                probability_jaccard(shingles(ta.as_py()), cached(tb.as_py())) >= threshold
                for ta, tb in zip(batch.column(2), batch.column(3))
            ]
            got = batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
            yield got

    return keep(both.mapInArrow(run, "a long, b long"))


def _least_agreement(threshold: float) -> float:
    return REGISTERS * threshold - 4 * np.sqrt(REGISTERS * threshold * (1 - threshold))


def _agreeing(pairs: DataFrame, threshold: float) -> DataFrame:
    """Drops pairs whose registers agree four standard deviations less than linked pairs' do."""
    least = _least_agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(n, -1) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((ra == rb).sum(1) >= least))

    return pairs.select("a", "b", "ra", "rb").mapInArrow(run, "a long, b long")


def _within(rows: DataFrame, threshold: float) -> DataFrame:
    """Links of crowded buckets that join classes, found in blocks of about BLOCK_ROWS by BLOCK_ROWS documents.

    A block looks at pairs across classes that share no earlier bucket and whose registers agree well enough, best first, and passes over
    pairs that links found before have joined. One minus the similarity is a metric (it is the chance that a register differs), so a pair whose distances
    to one central document differ by more than a linked pair's can is ruled out without being compared.
    """
    least, reach = _least_agreement(threshold), 1 - threshold + 1e-9
    many = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    chunk = F.pmod(F.xxhash64("doc_id"), many).cast("int")
    rows = rows.select("bucket", "doc_id", "class", "central", "bands", "registers", "text", chunk.alias("k"), many.alias("m"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least(o, "k").alias("i"), F.greatest(o, "k").alias("j"))))
    spread = rows.select("*", pair.alias("p")).select("bucket", "doc_id", "class", "central", "bands", "registers", "text", "k", "p.i", "p.j")

    def block(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, cls, k = (group.column(c).to_numpy() for c in ("doc_id", "class", "k"))
        i, j, bucket = (group.column(c)[0].as_py() for c in ("i", "j", "bucket"))
        found: list[tuple[int, int]] = []
        if len(set(cls.tolist())) > 1:
            bands = np.array(group.column("bands").to_pylist(), np.int64)
            registers = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(len(ids), -1)
            left, right = np.flatnonzero(k == i), np.flatnonzero(k == j)
            near = (cls[left][:, None] != cls[right][None, :]) & (ids[left][:, None] > ids[right][None, :] if i == j else True)
            agree = np.zeros(near.shape, np.int16)
            for c in range(registers.shape[1]):
                agree += registers[left, c][:, None] == registers[right, c][None, :]
            near &= agree >= least
            for c in range(bands.shape[1]):
                near &= ~((bands[left, c][:, None] == bands[right, c][None, :]) & (bands[left, c] < bucket)[:, None])
            x, y = np.nonzero(near)
            if len(x):
                order = np.argsort(-agree[x, y], kind="stable")
                x, y = left[x[order]], right[y[order]]
                text = group.column("text")
                use = np.unique(np.concatenate([x, y]))
                have = {int(u): shingles(text[int(u)].as_py()) for u in use}
                pivot = have[int(use[np.argmax(group.column("central").to_numpy()[use])])]
                far = np.zeros(len(ids))
                far[use] = [1 - probability_jaccard(have[int(u)], pivot) for u in use]
                ok = np.abs(far[x] - far[y]) <= reach
                root = {int(c): int(c) for c in cls}

                def find(c: int) -> int:
                    while root[c] != c:
                        root[c] = root[root[c]]
                        c = root[c]
                    return c

                for p, q in zip(x[ok].tolist(), y[ok].tolist()):
                    u, v = find(int(cls[p])), find(int(cls[q]))
                    if u != v and probability_jaccard(have[p], have[q]) >= threshold:
                        root[u] = v
                        found.append((int(ids[p]), int(ids[q])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return keep(spread.groupBy("bucket", "i", "j").applyInArrow(block, "a long, b long"))


def _mixed(cells: DataFrame, part: DataFrame) -> DataFrame:
    """The cells of buckets in which more than one class is left, with their classes."""
    placed = cells.drop("class").join(part, F.col("doc_id") == F.col("id"), "left").withColumn("class", F.coalesce("component", "doc_id")).drop("id", "component")
    mixed = keep(placed.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("bucket"))
    return keep(placed.join(mixed, "bucket", "left_semi"))


def _star(cells: DataFrame, order: Column) -> DataFrame:
    """One pair (a, b) for each document a: b leads by ``order`` among those of other classes that lead a bucket of a's."""
    leads = F.max(F.struct(order.alias("o"), (-F.col("doc_id")).alias("d"), F.col("class").alias("c"))).alias("top")
    tops = keep(cells.groupBy("bucket").agg(leads))
    seen = cells.select("bucket", "doc_id", "class").join(tops, "bucket").where("top.c <> class")
    return seen.groupBy("doc_id").agg(F.max("top").alias("top")).select(F.col("doc_id").alias("a"), (-F.col("top.d")).alias("b"))


def classes(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept), one row per doc_id: class_id is the least doc_id of the class, and that document is kept."""
    sketches = keep(sketch(documents))
    repeated = _repeated(sketches)
    sketches = _chosen(sketches, repeated)
    # equal multisets
    known = sketches.where("same is not null")
    copied = keep(known.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first"))
    member = keep(known.select("doc_id", "same").join(copied, "same", "left").select("doc_id", F.coalesce("first", "doc_id").alias("rep")))
    others = member.where("doc_id <> rep").select("doc_id").distinct()
    reps = known.join(others, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    # buckets that more than one representative shares; a document is central if its buckets are full
    cells = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = keep(cells.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    cells = keep(cells.join(shared, "bucket").select("bucket", "doc_id", "n"))
    central = cells.groupBy("doc_id").agg(F.sum("n").alias("central"))
    texts = _chosen(_hashed(documents).join(central.select("doc_id"), "doc_id", "left_semi"), repeated).select("doc_id", "text")
    texts = keep(texts.dropDuplicates(["doc_id"]))
    cells = keep(cells.join(central, "doc_id").withColumn("class", F.col("doc_id")))
    # every document against one leader: first the most central, then, across classes, others
    links = _verify(_star(cells, F.col("central")), texts, threshold)
    for seed in range(STARS):
        rest = _mixed(cells, connected_components(links))
        links = links.unionByName(_verify(_star(rest, F.xxhash64("doc_id", F.lit(seed))), texts, threshold))
    # what is left across classes: every pair once, in the first bucket that it shares
    rest = _mixed(cells, connected_components(links))
    rows = rest.join(reps.select("doc_id", "bands", "registers"), "doc_id")
    roomy = rows.where(F.col("n") <= CROWDED)
    one = roomy.select("bucket", F.col("doc_id").alias("a"), F.col("class").alias("ca"), F.col("bands").alias("ba"), F.col("registers").alias("ra"))
    two = roomy.select(F.col("bucket").alias("k"), F.col("doc_id").alias("b"), F.col("class").alias("cb"), F.col("bands").alias("bb"), F.col("registers").alias("rb"))
    once = F.array_min(F.array_intersect("ba", "bb")) == F.col("bucket")
    across = one.join(two, (F.col("bucket") == F.col("k")) & (F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & once)
    more = _verify(_agreeing(across, threshold), texts, threshold)
    crowded = _within(rows.where(F.col("n") > CROWDED).join(texts, "doc_id"), threshold)
    links = links.unionByName(more).unionByName(crowded)
    part = connected_components(links)
    found = member.join(part, member["rep"] == part["id"], "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    alone = sketches.where("same is null").select("doc_id", F.col("doc_id").alias("class_id"))
    every = found.unionByName(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return every.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def deduplicate(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, whole: the one with the least doc_id; a row whose doc_id is null or repeated only if the class has no other.

    Only rows of the latter kind are written with keys of their own, beyond all doc_ids.
    """
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    again = keep(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select(F.col("doc_id").alias("_again")))
    last = known.agg(F.max("doc_id").alias("d")).first()["d"] or 0
    if last >= 1 << 62:
        raise ValueError("doc_ids leave no room for keys beyond them")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    whole = documents.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("_id"))
    single = whole.where("_id is not null").join(again, F.col("_id") == F.col("_again"), "left_anti").select("row", F.col("_id").alias("key"))
    repeated = whole.join(again, F.col("_id") == F.col("_again"), "left_semi").unionByName(whole.where("_id is null"))
    odd = keep(repeated.select("row", (F.monotonically_increasing_id() + last + 1).alias("key")))
    rows = single.unionByName(odd)
    kept = classes(rows.select(F.col("key").alias("doc_id"), "row.text"), threshold).where("kept").select(F.col("doc_id").alias("key"))
    return rows.join(keep(kept).hint("merge"), "key", "left_semi").select("row.*")  # a key for each class: never broadcast, at any size
