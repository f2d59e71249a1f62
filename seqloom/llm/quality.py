"""Quality by compression.

Two zstandard dictionaries are trained, on text labelled good and on text labelled bad. A text is cut into blocks and every block
compressed with either; what the bad dictionary needs more than the good one, over the sum of both, says which kind of text it resembles. That
normalised difference, with how far the text shrinks at all (endless repetition shrinks alike under both), goes through a logistic calibration fitted on
labelled text that the dictionaries have not seen.

Dictionaries and calibration come from the whole texts of at most ``per_class`` labelled documents for either label (the bound is a parameter), weighted back to how often
either label occurs among all labelled rows; every whole text is scored, all of its blocks. Null and empty texts compress to
nothing either way and get the calibrated score of no difference. Where labels of one kind are missing, every text gets the share of good labels, or 0.5
without labels. Repeated rows are scored alike; further columns pass through, columns that have the names of results are replaced. An
empty table gives an empty table.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import keep, labelled_sample

BLOCK = 1024
SAMPLE_BYTES = 256
DICTIONARY_BYTES = 400_000
LEVEL = 3


def blocks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def dictionary(parts: list[bytes], seed: int = 7) -> bytes:
    """A trained dictionary; raw content where there is too little text to train one."""
    parts = list(parts)
    random.Random(seed).shuffle(parts)
    total = sum(map(len, parts))
    try:
        return zstd.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 4)), parts, k=50, d=6).as_bytes()
    except zstd.ZstdError:
        return b"".join(parts)[:DICTIONARY_BYTES] or b" " * 8


class Sizes:
    """Compressed sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = [self._compressor(d) for d in (good, bad)]

    @staticmethod
    def _compressor(content: bytes) -> zstd.ZstdCompressor:
        kind = zstd.DICT_TYPE_AUTO
        d = zstd.ZstdCompressionDict(content, dict_type=kind)
        d.precompute_compress(level=LEVEL)
        return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def of(self, text: str) -> tuple[float, float]:
        """(normalised difference, log of the share that is left after compression)."""
        data = text.encode()
        parts = blocks(data, BLOCK)
        if not parts:
            return 0.0, 0.0
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.both)
        return (bad - good) / (bad + good), float(np.log((good + bad) / (2 * len(data))))


@dataclass
class Model:
    good: bytes
    bad: bytes
    center: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_sizes"}

    def score(self, text: str) -> float:
        if not hasattr(self, "_sizes"):
            self._sizes = Sizes(self.good, self.bad) if self.good else None
        x = _inputs(self._sizes.of(text)) if self._sizes else np.zeros(3)
        z = self.coefficients[0] + self.coefficients[1:] @ ((x - self.center) / self.scale)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _inputs(sizes: tuple[float, float]) -> np.ndarray:
    difference, left = sizes
    return np.array([difference, left, min(left, -2.0)])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(c)) * len(y)
    penalty[0, 0] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        c = c + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty @ c), -3, 3)
    return c


def fit(teach: dict[int, list[bytes]], measured: np.ndarray, prior: dict[int, int], good: bytes, bad: bytes) -> Model:
    """``measured``: rows of (label, difference, log share left), of texts that the dictionaries have not seen."""
    y = measured[:, 0].astype(int) if len(measured) else np.zeros(0, int)
    if not all(teach.values()) or len(set(y)) < 2:
        n = sum(prior.values())
        share = (prior.get(1, 0) + 0.5) / (n + 1)
        return Model(b"", b"", np.zeros(3), np.ones(3), np.array([np.log(share / (1 - share)), 0, 0, 0]))
    x = np.array([_inputs((d, left)) for _, d, left in measured])
    share = np.array([prior.get(v, 1) / max(1, (y == v).sum()) for v in (0, 1)])
    weight = share[y] / share[y].mean()
    center, scale = x.mean(0), x.std(0) + 1e-6
    return Model(good, bad, center, scale, _logistic((x - center) / scale, y, weight))


def _teaching_blocks(sample: DataFrame) -> dict[int, list[bytes]]:
    """All blocks of the sampled texts, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += [(label, p) for p in blocks(text.as_py().encode(), SAMPLE_BYTES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["label", "block"]
            )

    got = sample.select("label", "text").mapInArrow(run, "label int, block binary").toArrow()
    label, block = got.column("label").to_numpy(), got.column("block")
    return {v: sorted(block.filter(pa.array(label == v)).to_pylist()) for v in (0, 1)}


def _measure(sample: DataFrame, good: bytes, bad: bytes) -> np.ndarray:
    shared = sample.sparkSession.sparkContext.broadcast((good, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(*shared.value)
        for batch in batches:
            got = [sizes.of(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "difference", "left"])

    out = sample.select("label", "text").mapInArrow(run, "label int, difference double, left double")
    return np.array([tuple(r) for r in out.orderBy("label", "difference", "left").collect()]).reshape(-1, 3)


def train(documents: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = 1500) -> Model:
    """One half of the sample trains the dictionaries, the other half the calibration."""
    sample, prior = labelled_sample(documents, labels, target, per_class)
    sample = keep(sample)
    half = F.pmod(F.xxhash64("doc_id", F.lit(18)), F.lit(2)) == 0
    teach = _teaching_blocks(sample.where(half))
    if not all(teach.values()):
        return fit(teach, np.zeros((0, 3)), prior, b"", b"")
    good, bad = dictionary(teach[1]), dictionary(teach[0])
    return fit(teach, _measure(sample.where(~half), good, bad), prior, good, bad)


def score(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``documents`` with score (how likely good) and predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in documents.columns if c not in ("score", "predicted")]
    documents = documents.select(*kept)
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = np.array([own.score(t.as_py() or "") for t in batch.column(at)], float)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array(scores >= threshold).cast(pa.int32())],
                names=[*batch.schema.names, "score", "predicted"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(run, f"{fields}, score double, predicted int")
