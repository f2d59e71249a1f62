"""Toxicity by multiple-instance learning.

Labels exist for documents only. A document is a bag of sentences; a sentence is toxic with probability sigmoid(w.x), where x holds its
words and the words' first letters; a document is toxic if any sentence is (noisy-or): p = 1 - prod(1 - p_s). The weights are fitted to the documents'
labels through that formula, so that sentences that make documents toxic get the blame, and the same weights then locate them.

The model is fitted on all sentences of at most ``per_class`` labelled documents for either label (the bound is a parameter), weighted back to how often
either label occurs among all labelled rows; every whole text is scored. Null and empty texts, and those without a letter, have no sentence
and score 0. Where labels of one kind are missing altogether nothing can be learnt and everything scores 0. Contradictory or null labels teach nothing.
Very long sentences are read in windows of ``WINDOW`` words. Repeated rows are scored alike; further columns pass through, columns that have
the names of results are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.llm.common import chunks, hold, labelled_sample

BITS = 18
PREFIXES = (3, 4, 5, 6, 7, 8)
WINDOW = 50
ROWS_AT_ONCE = 500
SCALES = (0.8, 1.0, 1.2, 1.5, 1.8, 2.2, 2.6, 3.0)
SHIFTS = tuple(np.arange(-4, 6.1, 0.5))
KNOWN_WORDS = 250_000
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashed features: the word, and its beginnings, which inflected and compounded forms share.

    A word too short for some beginning stands for it itself, so that shrinking weighs equally on all words.
    """
    mask = (1 << BITS) - 1
    return [zlib.crc32(word.encode()) & mask, *(zlib.crc32((word[:n] if len(word) > n else word + "$").encode(), n) & mask for n in PREFIXES)]


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words): ends of sentences are . ! ? and line breaks."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lowered; keep the places
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    for m in SENTENCE.finditer(low):
        words = WORD.findall(m[0])
        if not words:
            continue
        if len(words) <= WINDOW:
            yield m.start(), m.end(), words
            continue
        at = [w.span() for w in WORD.finditer(low, m.start(), m.end())]
        for i in range(0, len(words), WINDOW):
            last = min(i + WINDOW, len(words)) - 1
            yield at[i][0], at[last][1], words[i : i + WINDOW]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    usable: bool

    def __post_init__(self) -> None:
        self._words: dict[str, float] = {}

    def _word(self, word: str) -> float:
        got = self._words.get(word)
        if got is None:
            if len(self._words) > KNOWN_WORDS:
                self._words.clear()
            got = self._words[word] = float(self.weights[features(word)].sum())
        return got

    def score(self, text: str, blame: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and the sentences whose own probability is at least ``blame``."""
        if not self.usable or not text:
            return 0.0, []
        spans, sums = [], []
        word = self._word
        for start, end, words in sentences(text):
            sums.append(sum(map(word, set(words))))
            spans.append((start, end))
        if not sums:
            return 0.0, []
        z = np.array(sums) + self.bias
        silent = np.logaddexp(0.0, z).sum()
        found = np.flatnonzero(z >= np.log(blame / (1 - blame)))
        p = 1 / (1 + np.exp(-z[found]))
        return float(-np.expm1(-silent)), [(*spans[i], float(x)) for i, x in zip(found, p)]


@dataclass
class Bags:
    """A bounded sample: labels, the words of all sentences one after another, how many in each, how many sentences in each document."""

    label: np.ndarray
    word: np.ndarray
    words_in: np.ndarray
    sentences_in: np.ndarray
    vocabulary: list[str]


def _bags(sample: DataFrame) -> Bags:
    """Documents as word numbers; the driver gets every document's distinct words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, ROWS_AT_ONCE):
            words, numbers, counts = [], [], []
            for text in batch.column(1):
                own: dict[str, int] = {}
                said = [set(w) for _, _, w in sentences(text.as_py())]
                numbers.append([own.setdefault(w, len(own)) for s in said for w in sorted(s)])
                counts.append([len(s) for s in said])
                words.append(list(own))
            ints = pa.list_(pa.int32())
            columns = [batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array(numbers, ints), pa.array(counts, ints)]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "w", "i", "n"])

    got = sample.select("label", "text").mapInArrow(run, "label int, w array<string>, i array<int>, n array<int>").toArrow()
    if not got.num_rows:
        return Bags(*(np.zeros(0, np.int32) for _ in range(4)), [])
    w, i, n = (got.column(c).combine_chunks() for c in ("w", "i", "n"))
    coded = w.flatten().dictionary_encode()
    start = np.repeat(np.cumsum(w.value_lengths().to_numpy()) - w.value_lengths().to_numpy(), i.value_lengths().to_numpy())
    word = coded.indices.to_numpy()[start + i.flatten().to_numpy()]
    return Bags(got.column("label").to_numpy(), word, n.flatten().to_numpy(), n.value_lengths().to_numpy(), coded.dictionary.to_pylist())


def fit(bags: Bags, prior: dict[int, int], epochs: int = 100, rate: float = 0.1, ridge: float = 0.03) -> Model:
    """Maximum likelihood of the documents' labels under noisy-or, by full-batch Adam."""
    weights = np.zeros(1 << BITS)
    y = bags.label
    if len(y) == 0 or y.min() == y.max():
        return Model(weights.astype(np.float32), -20.0, False)
    made = np.array([features(w) for w in bags.vocabulary], np.int32)
    n_sentences = len(bags.words_in)
    doc_of_sentence = np.repeat(np.arange(len(y)), bags.sentences_in)
    sentence_of = np.repeat(np.arange(n_sentences), bags.words_in)
    known = np.unique(made)
    column_of = np.zeros(1 << BITS, np.int64)
    column_of[known] = np.arange(len(known))
    column = column_of[made]

    def per_sentence(w: np.ndarray) -> np.ndarray:
        of_word = w[column].sum(1)
        return np.bincount(sentence_of, of_word[bags.word], n_sentences)

    share = np.array([prior.get(v, 1) for v in (0, 1)], float) / np.maximum(np.bincount(y, minlength=2), 1)
    weight = share[y] / share[y].mean() / len(y)
    # a fifth of the documents is left to set scale and threshold, which shrinking has moved
    aside = (np.arange(len(y)) % 5 == 4) if len(y) >= 100 else np.zeros(len(y), bool)
    weight, check = np.where(aside, 0, weight), weight

    w, b = np.zeros(len(known)), -5.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, epochs + 1):
        z = b + per_sentence(w)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        silent = np.bincount(doc_of_sentence, np.logaddexp(0, z), len(y)) + 1e-9
        d = np.where(y == 1, -1 / np.expm1(np.minimum(silent, 50)), 1.0) * weight
        g = d[doc_of_sentence] * p
        of_word = np.bincount(bags.word, g[sentence_of], len(column))
        gw = np.bincount(column.ravel(), np.repeat(of_word, column.shape[1]), len(known)) + ridge * w / len(y) * 10
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-7)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-7)
    if aside.any() and len(set(y[aside])) == 2:
        z = per_sentence(w)
        use = aside[doc_of_sentence]
        z, doc = z[use], doc_of_sentence[use]

        def loss(scale: float, shift: float) -> float:
            silent = np.bincount(doc, np.logaddexp(0, scale * z + shift), len(y))[aside] + 1e-9
            return float((np.where(y[aside] == 1, -np.log(-np.expm1(-silent)), silent) * check[aside]).sum())

        _, scale, b = min((loss(c, c * b + d), c, c * b + d) for c in SCALES for d in SHIFTS)
        w = w * scale
    weights[known] = np.where(np.abs(w) < 0.02, 0, w)
    return Model(weights.astype(np.float32), float(b), True)


def train(documents: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = 1500) -> Model:
    sample, prior = labelled_sample(documents, labels, target, per_class)
    return fit(_bags(sample), prior)


def score(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``documents`` with score, predicted and offending: array of (start, end, score), end exclusive, in code points."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    result = "score double, predicted int, offending array<struct<start:int,end:int,score:double>>"
    kept = [c for c in documents.columns if c not in ("score", "predicted", "offending")]
    documents = documents.select(*kept)
    at = kept.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        hold(own, own._words.clear)
        for batch in batches:
            scores, found = [], []
            for text in batch.column(at):
                s, spans = own.score(text.as_py() or "")
                scores.append(s)
                found.append([{"start": a, "end": b, "score": p} for a, b, p in spans])
            said = pa.array(np.array(scores) >= threshold).cast(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), said, pa.array(found, kind)],
                names=[*batch.schema.names, "score", "predicted", "offending"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(run, f"{fields}, {result}")
