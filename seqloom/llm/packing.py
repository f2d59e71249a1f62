"""Best-fit packing of token pieces by bin completion with branch and bound.

Texts become ids (a closing id after each), cut every ``capacity`` ids; the pieces go into as few sequences of at most
``capacity`` ids as the search finds. Only how many pieces there are of each length matters for that, so the search
runs on a histogram of at most ``capacity`` numbers, whatever the corpus, and its answer, patterns of lengths with
multiplicities, comes to a few thousand rows. The search fills the bin of the largest piece left: it goes through the
fillings that no exchange or addition improves, the one with the least waste first, applies each as often as the counts and the waste
allow, then all of them less often, and drops branches whose waste already rules out fewer bins than the incumbent, which is best fit decreasing to
begin with. It ends at the lower bound, when nothing is left to try, or after ``SEARCH_NODES`` nodes and fillings, at every size of input alike.
Pieces are then numbered within their length, by task and place in the task, and each number falls into one slot of a pattern.

Null texts count as empty; an empty text is the closing id alone. Ties between pieces of one length are settled by where they
were read. Repeated rows are packed as often as they occur. Further input columns are not read. An empty table packs to nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.bpe import slices
from seqloom.llm.common import WordCache, chunks, hold, keep

RUN_BYTES, WORD_BYTES = 48 << 20, 8 << 20
SEARCH_NODES = 20_000
OPEN_STEPS = 64
ROWS_AT_ONCE = 1000
_CONTROL = re.compile("[\x1c-\x1f]")
#: The tokenizer's own split pattern, and letters that lowering and composing leave alone but for case.
_RUN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_RUN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
_PLAIN = re.compile("[\t\n\r -~\xa1-\u012f\u0131-\u017f]*")
_WORD_END = b"\xff"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte; printable bytes are themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE = _byte_letters()
Pattern = tuple[int, ...]


def _merged(symbols: list[str], order: dict[tuple[str, str], int]) -> list[str]:
    """What the merges make of symbols: the earliest first, the leftmost among equals."""
    while len(symbols) > 1:
        i = min(range(len(symbols) - 1), key=lambda k: order.get((symbols[k], symbols[k + 1]), len(order)))
        if (symbols[i], symbols[i + 1]) not in order:
            break
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


def rank_coder(model: dict) -> Callable[[bytes], list[int]] | None:
    """Ids of one run of bytes by a rank table, many times faster than the tokenizer's own model; None if that would not give the same.

    A byte that UTF-8 never has stands for the end of a word, so that a token which ends one has bytes of its own. Ranks pick a pair by what it
    becomes, merges by what it is made of. Both come to the same if ids ascend with the merges and every token is what its own bytes
    merge to: as long as no token reaches over either end of some bytes, these merge as they would alone.
    """
    vocabulary, end = model["vocab"], model["end_of_word_suffix"] or ""
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocabulary[a + b] for a, b in merges]
    byte = {c: b for b, c in _BYTE.items()}
    plain = not model["continuing_subword_prefix"] and not model["unk_token"] and not model["dropout"] and bool(end)
    single = {*_BYTE.values(), *(c + end for c in _BYTE.values())}
    if not plain or made != sorted(set(made)) or not single <= set(vocabulary) or max(vocabulary[c] for c in single) >= min(made, default=1 << 32):
        return None
    order = {m: k for k, m in enumerate(merges)}
    ranks = {bytes([b]): vocabulary[c] for b, c in _BYTE.items()}
    if set(vocabulary.values()) - set(made) - {vocabulary[c] for c in single}:
        return None
    for (a, b), number in zip(merges, made):
        token = a + b
        ends = token.endswith(end)
        body = token[: -len(end)] if ends else token
        letters = [*body[:-1], body[-1] + end] if ends else [*body]
        if _merged(letters, order) != [token]:
            return None
        ranks[bytes(map(byte.__getitem__, body)) + _WORD_END * ends] = number
    ranks |= {bytes([b]) + _WORD_END: vocabulary[c + end] for b, c in _BYTE.items()}
    own = tiktoken.Encoding("ranks", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda run: own(run + _WORD_END)


class WordCoder:
    """Ids of texts by a tokenizer that lowers case, drops white space and never looks across it.

    A text falls into runs of letters, digits and signs, which the tokenizer's model sees one at a time; their ids are kept. Of texts
    with letters that Unicode may fold or compose differently, each word is taken by itself, and those with such letters go
    through the tokenizer whole. What is kept is bounded in bytes; a run that has to be coded again costs little.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = WordCache(WORD_BYTES, self._words)
        self.runs = WordCache(RUN_BYTES, self._runs)
        own = json.loads(self.tokenizer.to_str())
        self.splits = own["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == _RUN_PATTERN and [
            x["type"] for x in own["normalizer"]["normalizers"]
        ] == ["NFC", "Replace", "Lowercase"]
        self.run = rank_coder(own["model"]) or self._by_model

    def _by_model(self, run: bytes) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize("".join(map(_BYTE.__getitem__, run)))]

    def clear(self) -> None:
        self.words.clear()
        self.runs.clear()

    def _raw(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", c.ids).tobytes() for c in coded]

    def _words(self, words: list[str]) -> list[bytes]:
        plain = _PLAIN.fullmatch
        return [self._runs_of(w) if self.splits and plain(w) else self._raw([w])[0] for w in words]

    def _runs_of(self, text: str) -> bytes:
        return self.runs.join(_RUN.findall(text.lower()))

    def _runs(self, runs: list[str]) -> list[bytes]:
        code = self.run
        return [array("I", code(r.encode())).tobytes() for r in runs]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._slice, slices(text)))

    def _slice(self, text: str) -> bytes:
        if self.splits and _PLAIN.fullmatch(text):
            return self._runs_of(text)
        if _CONTROL.search(text):  # these split words for Python but not for the tokenizer
            return self._raw([text])[0]
        return self.words.join(text.split())


@lru_cache(maxsize=2)
def load(path: str) -> WordCoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordCoder(path)


def pieces(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], task, nth): nth counts pieces of that length in that task."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    if keep_ids:
        schema += ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = load(path), TaskContext.get().partitionId()
        hold(coder, coder.clear)
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in chunks(batches, ROWS_AT_ONCE):
            rows: list[tuple] = []
            ids: list[np.ndarray] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                coded = coder.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
            out = out.astype({"piece": "int32", "task": "int32", "doc_id": "Int64"})
            got = pa.RecordBatch.from_pandas(out, preserve_index=False)
            if keep_ids:
                got = pa.RecordBatch.from_arrays([*got.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*got.schema.names, "ids"])
            yield got

    return documents.select("doc_id", "text").mapInArrow(run, schema)


# the search, on counts of lengths


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Patterns with multiplicities: longest first, each into the fullest bin that has room."""
    room: dict[int, Counter[Pattern]] = defaultdict(Counter)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fit = min((r for r in room if r >= length and room[r]), default=None)
            if fit is None:
                k = capacity // length
                if left >= k:
                    room[capacity - k * length][(length,) * k] += left // k
                if left % k:
                    room[capacity - left % k * length][(length,) * (left % k)] += 1
                break
            pattern, many = next(iter(room[fit].items()))
            take = min(many, left)
            k = 1
            while take == many and (k + 1) * length <= fit and (k + 1) * take <= left:
                k += 1
            room[fit][pattern] -= take
            if not room[fit][pattern]:
                del room[fit][pattern]
            if not room[fit]:
                del room[fit]
            room[fit - k * length][pattern + (length,) * k] += take
            left -= take * k
    total: Counter[Pattern] = Counter()
    for r in room.values():
        total.update(r)
    return total


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing takes: by total length, and for each k by the pieces of at least k, of which those over half never share a bin."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in {0, *(n for n in counts if 2 * n <= capacity)}:
        large = sum(c for n, c in counts.items() if n > capacity - k)
        half = [(n, c) for n, c in counts.items() if 2 * n > capacity and n <= capacity - k]
        rest = sum(n * c for n, c in counts.items() if k <= n and 2 * n <= capacity)
        spare = sum(c * (capacity - n) for n, c in half)
        best = max(best, large + sum(c for _, c in half) + max(0, -(-(rest - spare) // capacity)))
    return best


def completions(counts: dict[int, int], lengths: list[int], space: int, most_waste: int) -> Iterator[Pattern | None]:
    """Undominated fillings of ``space``, least waste first, and None for each dominated one. ``lengths``: those with a count, ascending.

    A filling to which another piece could be added, or in which one piece could be exchanged for a longer one that is left and still
    fits, is dominated. Among fillings of one waste, those of long pieces come first.
    """
    usable = lengths[: bisect_right(lengths, space)]
    have = [counts[n] for n in usable]
    mask = (1 << space + 1) - 1
    reach = [1]  # the sums that the shortest j lengths can make, as bits
    for n, c in zip(usable, have):
        sums, step, many = reach[-1], 1, min(c, space // n)
        while many > 0:
            take = min(step, many)
            sums |= sums << take * n
            many, step = many - take, 2 * step
        reach.append(sums & mask)

    def exact(j: int, left: int) -> Iterator[Pattern]:
        if left == 0:
            yield ()
            return
        for i in range(min(j, bisect_right(usable, left)), 0, -1):
            if not reach[i] >> left & 1:
                return
            n = usable[i - 1]
            for k in range(min(have[i - 1], left // n), 0, -1):
                if reach[i - 1] >> left - k * n & 1:
                    for tail in exact(i - 1, left - k * n):
                        yield (n,) * k + tail

    for waste in range(min(space, most_waste) + 1):
        if reach[-1] >> space - waste & 1:
            for filling in exact(len(usable), space - waste):
                yield None if waste and _improves(dict(zip(usable, have)), usable, filling, waste) else filling


def _improves(counts: dict[int, int], lengths: list[int], taken: Pattern, left: int) -> bool:
    """Whether a piece that is left could stand for a shorter one of ``taken``, or be added."""
    used = Counter(taken)
    spare = lambda low, high: any(counts[n] > used[n] for n in lengths[bisect_left(lengths, low) : bisect_right(lengths, high)])
    return spare(1, left) or any(spare(t + 1, t + left) for t in used)


@dataclass
class _Step:
    """One bin pattern on the way down: the fillings of the largest piece, how many were tried, and the one that is applied."""

    first: int
    options: Iterator[tuple[Pattern | None, int]] | None = None
    tried: int = 0
    pattern: Pattern = ()
    times: int = 0


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = SEARCH_NODES) -> Counter[Pattern]:
    """The best packing found within ``nodes`` nodes and fillings; never worse than best fit decreasing."""
    left = {n: c for n, c in counts.items() if c}
    best = best_fit_decreasing(left, capacity)
    best_bins, bound = sum(best.values()), lower_bound(left, capacity)
    lengths, size, used = sorted(left), sum(n * c for n, c in left.items()), 0
    mark = {n: int.from_bytes(hashlib.blake2b(str(n).encode(), digest_size=16).digest(), "big") for n in left}
    state = sum(c * mark[n] for n, c in left.items()) % 2**128  # of what is left; 128 bits, so no two states share one
    seen: dict[int, int] = {}
    path: list[_Step] = []

    def apply(pattern: Pattern, times: int) -> None:
        """Takes ``pattern`` out of what is left, or puts it back if ``times`` is negative."""
        nonlocal size, used, state
        for n, k in Counter(pattern).items():
            before = left.get(n, 0)
            left[n] = before - k * times
            if not before:
                insort(lengths, n)
            if not left[n]:
                del left[n]
                lengths.pop(bisect_left(lengths, n))
            state = (state - k * times * mark[n]) % 2**128
        size, used = size - times * sum(pattern), used + times

    def choices(first: int, spare: int) -> Iterator[tuple[Pattern | None, int]]:
        """Every filling as often as it goes, then every filling every number of times less."""
        rest = left | {first: left[first] - 1}
        present = list(lengths)
        for f in completions(rest, present, capacity - first, spare):
            yield None if f is None else (first, *f), 0
        for f in completions(rest, present, capacity - first, spare):
            if f is not None:
                most = min((rest[n] + (n == first)) // k for n, k in Counter((first, *f)).items())
                for less in sorted(range(1, most), key=lambda t: -(t & -t)):
                    yield (first, *f), less

    def fill(step: _Step) -> bool:
        """Applies the next choice; False if there is none that can beat the incumbent."""
        nonlocal nodes
        spare = (best_bins - 1 - used) * capacity - size  # waste that is still allowed
        if spare < 0:
            return False
        if step.options is None:
            step.options = islice(choices(step.first, spare), step.tried, None)
        for pattern, less in step.options:
            nodes -= 1
            step.tried += 1
            if pattern is not None:
                break
            if nodes <= 0:
                return False
        else:
            return False
        step.pattern = pattern
        step.times = min(left[n] // k for n, k in Counter(pattern).items()) - less
        waste = capacity - sum(step.pattern)
        if waste > spare:
            return False
        if waste:
            step.times = min(step.times, spare // waste)  # fewer of them than that stay allowed
        apply(step.pattern, step.times)
        return True

    down = True
    while nodes > 0 and best_bins > bound:
        if down:
            nodes -= 1
            if not lengths:
                best_bins, best = used, Counter()
                for step in path:
                    best[step.pattern] += step.times
            elif used + -(-size // capacity) < best_bins and seen.get(state, used + 1) > used:
                seen[state] = used
                path.append(_Step(lengths[-1]))
                if len(path) > OPEN_STEPS:
                    path[-OPEN_STEPS - 1].options = None  # made again if the search comes back to it
                down = fill(path[-1])
                if not down:
                    path.pop()
                continue
        if not path:
            break
        apply(path[-1].pattern, -path[-1].times)
        down = fill(path[-1])
        if not down:
            path.pop()
    return best


def slots(plan: Counter[Pattern]) -> pd.DataFrame:
    """(length, first, many, sequence, offset): the pieces numbered first.. of that length go to sequence.. at offset."""
    next_of: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, many in plan.items():
        offset = 0
        for n in pattern:
            rows.append((n, next_of[n], many, sequence, offset))
            next_of[n] += many
            offset += n
        sequence += many
    return pd.DataFrame(rows, columns=["length", "first", "many", "sequence", "offset"]).astype("int64")


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """``cut`` (with length, task and nth, as from pieces(), already written) with sequence_id and offset.

    What reaches the driver is one count per length; what is broadcast is the plan, whose size depends on the number of
    lengths only. Nothing else is gathered; a length that a third of all pieces share is as good as any other.
    """
    spark = cut.sparkSession
    by_task = keep(cut.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = slots(bin_completion(counts, capacity)).sort_values(["length", "first"])
    step = 1 << 44
    starts = spark.sparkContext.broadcast(
        ((plan["length"] * step + plan["first"]).to_numpy(), plan["first"].to_numpy(), plan["sequence"].to_numpy(), plan["offset"].to_numpy())
    )
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    columns = [c for c in cut.columns if c not in ("task", "nth")]
    # never broadcast: there are as many offsets as tasks times lengths
    numbered = cut.join(offsets.hint("merge"), ["task", "length"]).select(*columns, (F.col("earlier") + F.col("nth")).alias("number"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, first, sequence, offset = starts.value
        for f in frames:
            at = np.searchsorted(keys, f["length"].to_numpy() * step + f["number"].to_numpy(), "right") - 1
            f["sequence_id"] = sequence[at] + f["number"].to_numpy() - first[at]
            f["offset"] = offset[at]
            yield f.drop(columns="number")

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in numbered.schema.fields if x.name != "number")
    return numbered.mapInPandas(place, f"{fields}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(keep(pieces(documents, path, capacity, end_id)), capacity)
