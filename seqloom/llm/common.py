"""What the operators share: tables, scratch space, exact collapsing and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.runtime import scratch, ship

#: Rows, and bytes, that Spark hands to Python at once: its default of 10,000 texts is tens of megabytes, several times over, and without bound for long ones.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_ROWS, _BYTES, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "10000"


def ready(spark: SparkSession) -> None:
    """Ships the package, and makes batches smaller unless the session sets a size of its own."""
    ship(spark)
    if spark.conf.get(_ROWS) == _DEFAULT:
        spark.conf.set(_ROWS, BATCH_ROWS)
        spark.conf.set(_BYTES, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_noted: list[list[str]] = []


def keep(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in shared scratch space and returns what was written.

    This cuts the lineage: a lost executor costs the tasks that ran there, never the chain before.
    """
    spark = df.sparkSession
    ready(spark)
    path = scratch(spark)
    df.write.parquet(path)
    for paths in _noted:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noting() -> Iterator[list[str]]:
    """The paths that keep() writes to, as they come."""
    paths: list[str] = []
    _noted.append(paths)
    try:
        yield paths
    finally:
        _noted.pop()


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for p in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of at most ``per_class`` labelled documents for either label, none of them held out.

    The documents are those with the least hash of doc_id among labelled ones, so a rerun takes the same; of rows that repeat a doc_id one counts, the one whose
    text has the least hash. Labels that are null, or that contradict each other for one doc_id, teach nothing. At most
    ``2 * per_class`` ids are broadcast. Also returns how many usable ids either label has in all.
    """
    usable = (
        labels.select("doc_id", F.col(target).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most"))
        .where("label = _most").drop("_most")
    )
    prior = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    picks = [usable.where(F.col("label") == v).orderBy(order, "doc_id").limit(per_class) for v in (0, 1)]
    chosen = picks[0].unionByName(picks[1])
    text = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label")
    return found.agg(F.min(F.struct(F.xxhash64("text"), "text")).getField("text").alias("text")), prior


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id on an edge; component is the least id that can be reached.

    ``edges`` has long columns a and b. Alternates the large-star and small-star steps, which need a logarithmic number
    of rounds whatever the shape. Each step reduces with a partial ``min`` before its shuffle and joins on a key whose
    hot side Spark can split, as the other side is a written table; each round is written to shared scratch space.
    """
    now = keep(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    size = _fingerprint(now)
    for _ in range(rounds):
        if size[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        now = keep(small.where("u <> v").distinct())
        last, size = size, _fingerprint(now)
        if size == last:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("u").agg(F.min("v").alias("v"))
    return roots.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")
    ).first()
    return row["n"], row["h"]


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is made from one stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


_holder: list = []


def hold(owner: object, clear: Callable[[], None]) -> None:
    """Makes ``owner`` the one whose tables this worker keeps: what another left, in a worker that lives on, is emptied first."""
    if _holder and _holder[0] is not owner:
        _holder[1]()
    _holder[:] = owner, clear


class WordCache:
    """Values by word in two generations of about ``limit`` bytes each, so that memory is bounded and common words stay."""

    #: Of one entry besides its letters and its value: two objects' heads and a place in a table.
    ENTRY = 220

    def __init__(self, limit: int, code: Callable[[list[str]], Iterable[bytes]]):
        self.limit, self.code = limit, code
        self.clear()

    def clear(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def ensure(self, words: Iterable[str]) -> dict[str, bytes]:
        """A table that has all of ``words``."""
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        new, old = self.new, self.old
        missing = set(words).difference(new)
        if old:
            again = [w for w in missing if w in old]
            self._add(again, [old[w] for w in again])
            missing.difference_update(again)
        if missing:
            listed = list(missing)
            self._add(listed, list(self.code(listed)))
        return new

    def _add(self, words: list[str], values: list[bytes]) -> None:
        self.new.update(zip(words, values))
        self.size += self.ENTRY * len(words) + sum(map(len, words)) + sum(map(len, values))

    def join(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.new.__getitem__, words))
        except KeyError:
            return b"".join(map(self.ensure(words).__getitem__, words))
