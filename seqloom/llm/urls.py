"""URL filter: rules first, then a ratio of character language models.

A rule names a host, with all its subdomains, and the beginning of a path; the longest rule that fits decides. URLs that rules decide are
accepted and rejected examples: for either kind a variable-order Markov model over bytes is counted over all of them (but for a fifth, by a
hash of the URL), each order smoothed with the one below. URLs without a rule are judged by the difference of log-likelihoods over length, put through a
logistic calibration fitted on at most ``CALIBRATION_ROWS`` URLs of the fifth left out.

Counts are exact: an n-gram of up to ORDER + 1 symbols is a number of its own, so no two share a count, and the table of counts is a written
one that grows with what occurs. It is neither gathered nor broadcast by hand: what URLs without a rule ask of it is put together for
about ``CHUNK`` different URLs at a time, once for each n-gram, and joined to it. URLs are scored whole. A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged
by what the calibration says of no difference (null) or of its text. Where rules accept or reject nothing, everything without a rule is allowed. Repeated rows
count and are judged as often as they occur; further columns pass through, columns with the names of results are replaced. An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import chunks, keep

ORDER = 5
STRENGTH = 4.0
CALIBRATION_ROWS = 5000
ROWS_AT_ONCE = 4000
CHUNK = 2048
#: Symbols are bytes, what stands before a URL and what ends it.
_START, _END, _SYMBOL = 256, 257, 9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @classmethod
    def parse(cls, action: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(action, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` the host up to / ? # with A-Z lowered, then the path up to ? #; empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*+)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*+([^?#]*+)", 1), F.lit(""))


def deciding_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, action) of the longest rule that fits, null without one; among equally long ones the first."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in ordered]
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for fit, r in reversed(list(zip(fits, ordered))):
        text, action = F.when(fit, r.text).otherwise(text), F.when(fit, r.action).otherwise(action)
    return text, action


def _positions(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all bytes of all URLs and the end of each: (which URL, context and symbol, context), the latter two by order."""
    lengths = np.array([len(u) + 1 for u in urls])
    owner = np.repeat(np.arange(len(urls)), lengths)
    place = np.arange(lengths.sum()) + ORDER * (owner + 1)
    data = np.full(lengths.sum() + ORDER * len(urls), _START, np.int64)
    ends = np.cumsum(lengths) - 1
    own = np.full(len(place), _END, np.int64)
    own[np.delete(np.arange(len(place)), ends)] = np.frombuffer(b"".join(urls), np.uint8)
    data[place] = own
    context = np.zeros(len(place), np.int64)
    grams, contexts = [], []
    for k in range(ORDER + 1):
        if k:
            context = context | data[place - k] << _SYMBOL * k
        grams.append(_key(k, 1) | context | own)
        contexts.append(_key(k, 0) | context)
    return owner, np.array(grams), np.array(contexts)


def _key(order: int, symbol: int) -> int:
    """The bits above the symbols: the order, and whether the symbol after the context belongs to it."""
    return (2 * order + symbol) << _SYMBOL * (ORDER + 1)


def _asked(urls: list[bytes]) -> np.ndarray:
    _, grams, contexts = _positions(urls)
    return np.unique(np.concatenate([grams.ravel(), contexts.ravel()]))


def _difference(urls: list[bytes], keys: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """log-likelihood under accepted less that under rejected, over length, by the counts of ``keys``; other keys have none."""
    owner, grams, contexts = _positions(urls)
    order = np.argsort(keys)
    keys = np.append(keys[order], np.iinfo(np.int64).max)
    logs = []
    for counts in (yes, no):
        counts = np.append(counts[order], 0)

        def of(asked: np.ndarray) -> np.ndarray:
            at = np.searchsorted(keys, asked)
            return np.where(keys[at] == asked, counts[at], 0)

        p = np.full(len(owner), 1 / 257)
        for k in range(ORDER + 1):
            p = (of(grams[k]) + STRENGTH * p) / (of(contexts[k]) + STRENGTH)
        logs.append(np.log(p))
    return np.bincount(owner, logs[0] - logs[1], len(urls)) / np.array([len(u) + 1 for u in urls])


@dataclass
class Model:
    counts: DataFrame  # (key, yes, no) of every context, with and without a symbol: how often in accepted and in rejected URLs
    intercept: float
    slope: float

    def difference(self, urls: list[bytes]) -> np.ndarray:
        """log-likelihood under accepted less that under rejected, over length, of a few URLs."""
        if not urls:
            return np.zeros(0)
        asked = self.counts.sparkSession.createDataFrame(pa.table({"key": _asked(urls)}))
        got = self.counts.join(F.broadcast(asked), "key").toPandas()
        return _difference(urls, *(got[c].to_numpy(np.int64) for c in ("key", "yes", "no")))

    def differences(self, urls: DataFrame) -> DataFrame:
        """(url, difference) of every different URL of ``urls``; null and empty ones are left out."""
        texts = keep(urls.select("url").where("url <> ''").distinct())
        texts = texts.withColumn("chunk", F.pmod(F.xxhash64("url"), F.lit(-(-texts.count() // CHUNK) or 1)))

        def ask(some: pa.Table) -> pa.Table:
            keys = _asked([u.encode() for u in some.column("url").to_pylist()])
            return pa.table({"chunk": np.full(len(keys), some.column("chunk")[0].as_py()), "key": keys})

        asked = texts.groupBy("chunk").applyInArrow(ask, "chunk long, key long").join(self.counts, "key").select("chunk", "key", "yes", "no")

        def judged(some: pa.Table, counts: pa.Table) -> pa.Table:
            listed = some.column("url").to_pylist()
            keys, yes, no = (counts.column(c).to_numpy() for c in ("key", "yes", "no"))
            out = [_difference([u.encode() for u in listed[i : i + ROWS_AT_ONCE]], keys, yes, no) for i in range(0, len(listed), ROWS_AT_ONCE)]
            return pa.table({"url": pa.array(listed, pa.string()), "difference": np.concatenate(out) if out else np.zeros(0)})

        return texts.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(judged, "url string, difference double")

    def accept(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * difference, -40, 40)))


def _left_out(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(11)), F.lit(5)) == 0


def count(labelled: DataFrame) -> DataFrame:
    """(key, yes, no) over all rows of (url, accepted), written; tasks send each key once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, ROWS_AT_ONCE):
            urls = [u.encode() for u in batch.column(0).to_pylist()]
            if not urls:
                continue
            owner, grams, contexts = _positions(urls)
            accepted = np.array(batch.column(1).to_pylist(), bool)[owner]
            keys, at = np.unique(np.concatenate([grams.ravel(), contexts.ravel()]), return_inverse=True)
            yes = np.bincount(at[np.tile(accepted, 2 * (ORDER + 1))], minlength=len(keys))
            total = np.bincount(at, minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(yes), pa.array(total - yes)], names=["key", "yes", "no"])

    parts = labelled.select("url", "accepted").mapInArrow(run, "key long, yes long, no long")
    return keep(parts.groupBy("key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    scale = x.std() + 1e-9
    c = np.zeros(2)
    a = np.column_stack([np.ones(len(x)), x / scale])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + 0.01 * np.eye(2)
        c = c + np.clip(np.linalg.solve(h, a.T @ (y - p) - 0.01 * c), -2, 2)
    return float(c[0]), float(c[1] / scale)


def train(labelled: DataFrame) -> Model | None:
    """``labelled``: (url, accepted). None if either kind is missing."""
    rest = labelled.where(~_left_out(F.col("url")))
    counts = count(rest)
    every = counts.where(F.col("key") == _key(0, 0)).first()
    if every is None or not every["yes"] or not every["no"]:
        return None
    some = labelled.where(_left_out(F.col("url"))).orderBy(F.xxhash64("url", F.lit(13)), "url").limit(CALIBRATION_ROWS).collect()
    model = Model(counts, 0.0, 1.0)
    x, y = model.difference([r["url"].encode() for r in some]), np.array([r["accepted"] for r in some], float)
    if len(set(y)) == 2:
        model.intercept, model.slope = _calibrate(x, y)
    return model


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score (how likely accepted; null where a rule decides) and verdict."""
    named = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in pages.columns if c not in named]
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    text, action = deciding_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", text.alias("rule"), action.alias("_action"))
    labelled = rows.where("_action is not null").select(F.col(url_col).alias("url"), (F.col("_action") == "allow").alias("accepted"))
    model = train(labelled)
    if model is None:
        return rows.select(*kept, "host", "path", "rule", F.lit(None).cast("double").alias("score"), F.coalesce("_action", F.lit("allow")).alias("verdict"))
    ask = rows.where("_action is null").select(F.col(url_col).alias("url"))
    known = keep(model.differences(ask)).select(F.col("url").alias("_url"), "difference")
    joined = rows.join(known, (F.col(url_col) == F.col("_url")) & F.col("_action").isNull(), "left")
    linear = F.lit(model.intercept) + F.lit(model.slope) * F.coalesce("difference", F.lit(0.0))
    likely = 1 / (1 + F.exp(-F.greatest(F.least(linear, F.lit(40.0)), F.lit(-40.0))))
    score = F.when(F.col("_action").isNull(), likely)
    verdict = F.coalesce("_action", F.when(score >= 0.5, "allow").otherwise("block"))
    return joined.select(*kept, "host", "path", "rule", score.alias("score"), verdict.alias("verdict"))
