"""Byte-level BPE encoding and decoding by monoid tree reduction.

A match of the split pattern is halved until its halves are short; short runs of bytes are merged outright. Two encoded
neighbours are joined by encoding anew a window of tokens around their border. The window grows until the tokens just
inside and just outside either of its ends are what encoding that pair alone gives. Rank-ordered merging has the property
that a token sequence whose every adjacent pair is stable in this sense is the encoding of its bytes, so what lies outside
the window is proven to stand. Decoding concatenates the tokens' bytes up the same kind of tree.

Null texts count as empty; empty texts give no ids and decode to no bytes. Very long texts are worked through in
slices that end where a match ends. Repeated rows stay repeated rows. Columns other than the text pass through; columns
called ``ids`` or ``decoded`` in the input are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seqloom.llm.common import WordCache, chunks, hold

#: White space as Unicode has it, which is what the split pattern's ``\s`` stands for.
WHITE = "\t-\r \x85\xa0  -     　"
LEAF_BYTES, LEAF_TOKENS = 8, 512
LEAVES = 80_000
SLICE_CHARS = 1 << 20
UNIT_BYTES, MATCH_BYTES = 60 << 20, 36 << 20
ROWS_AT_ONCE = 500
_ODD_WHITE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def split_pattern(pattern: str) -> regex.Pattern:
    """The split pattern with ``\\s`` and ``\\S`` spelled out."""
    spelled = pattern.replace(r"\S", f"[^{WHITE}]").replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]")
    return regex.compile(spelled)


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = split_pattern(pattern)
        self.token = {i: b for b, i in ranks.items()}
        self.listed = np.full(max(self.token, default=0) + 1, b"", object)
        self.listed[list(self.token)] = list(self.token.values())
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.leaves: dict[bytes, tuple[int, ...]] = {}
        self.units = WordCache(UNIT_BYTES, self._units)
        self.matches = WordCache(MATCH_BYTES, self._matches)

    def clear(self) -> None:
        for table in (self.units, self.matches, self.pairs, self.leaves):
            table.clear()

    # one match of the pattern

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else self._tree(piece)

    def _tree(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) > LEAF_BYTES:
            middle = len(piece) // 2
            return self._join(self._tree(piece[:middle]), self._tree(piece[middle:]))
        leaf = self.leaves.get(piece)
        if leaf is None:
            if len(self.leaves) > LEAVES:
                self.leaves.clear()
            leaf = self.leaves[piece] = tuple(self._merge(piece))
        return leaf

    def _join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The monoid's operation; it is associative, as both sides are encodings of their bytes."""
        if not left or not right:
            return left or right
        window = self._pair(left[-1], right[0])
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            before = a == 0 or self._stands(left[a - 1], window[0])
            after = b == len(right) or self._stands(window[-1], right[b])
            if before and after:
                return left[:a] + window + right[b:]
            width *= 2
            inside = left[max(0, len(left) - width) :] + right[:width]
            window = tuple(self._merge(b"".join(map(self.token.__getitem__, inside))))

    def _pair(self, a: int, b: int) -> tuple[int, ...]:
        """What the bytes of two tokens encode to."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > LEAVES:
                self.pairs.clear()
            known = self.pairs[a, b] = tuple(self._merge(self.token[a] + self.token[b]))
        return known

    def _stands(self, a: int, b: int) -> bool:
        return self._pair(a, b) == (a, b)

    def _merge(self, piece: bytes) -> list[int]:
        """Least rank first, leftmost among equals."""
        ranks = self.ranks
        if len(piece) > 96:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(ranks) + 1
        pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1" * n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= n or end[nxt[i]] != stop:
                continue
            j = nxt[i]
            alive[j], end[i], nxt[i] = 0, stop, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (h := prev[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = nxt[i]
        return out

    # whole texts

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return b"".join(self._slice(s) for s in slices(text))

    def _slice(self, text: str) -> bytes:
        if not text:
            return b""
        if uneven(text):
            units = self.split.findall(text)
        else:  # single white space only: a match never reaches over a space, so words stand alone
            first, *rest = text.split(" ")
            units = [" " + w for w in rest]
            if first:
                units.insert(0, first)
        return self.units.join(units)

    def _units(self, units: list[str]) -> list[bytes]:
        find = self.split.findall
        found = [
            [u] if u[1:].isalpha() and u[0] == " " else [u[:-1], u[-1]] if u[-1] in ".," and u[1:-1].isalpha() and u[0] == " " else find(u)
            for u in units
        ]
        have = self.matches.ensure(chain.from_iterable(found))
        return [have[f[0]] if len(f) == 1 else b"".join(map(have.__getitem__, f)) for f in found]

    def _matches(self, matches: list[str]) -> list[bytes]:
        return [array("i", self.encode_piece(m.encode())).tobytes() for m in matches]

    def decode(self, ids: np.ndarray) -> bytes:
        """Halves recursively; the bytes of short runs of tokens are concatenated up the tree."""
        if len(ids) <= LEAF_TOKENS:
            return b"".join(self.listed[ids].tolist())
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def uneven(text: str) -> bool:
    """Whether ``text`` (not empty, its first space aside) has white space at an end, two in a row, or any but spaces and line feeds."""
    return (
        "  " in text or "\n" in text and ("\n\n" in text or "\n " in text or " \n" in text)
        or text[-1] in " \n" or text[0] == "\n" or _ODD_WHITE.search(text) is not None
    )


def slices(text: str) -> Iterator[str]:
    """Cuts a very long text before single spaces between words, where a match always begins."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        cut = _CUT.search(text, at + SLICE_CHARS)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> TreeBPE:
    """The coder for a rank file (base64 token, space, rank); kept by each Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return TreeBPE(ranks, pattern)


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [values], names=[*names, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with ``ids`` (array of int). ``path`` is read on every worker, as part of the installed environment."""
    if not keep_text:
        df = df.withColumnRenamed(text_col, "_text")
        text_col = "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        hold(coder, coder.clear)
        for batch in chunks(batches, ROWS_AT_ONCE):
            coded = [coder.encode(t.as_py() or "") for t in batch.column(text_col)]
            ends = np.cumsum([0] + [len(c) // 4 for c in coded]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            if not keep_text:
                batch = batch.select([n for n in batch.schema.names if n != text_col])
            yield _with(batch, "ids", ids)

    schema = _schema(df, "ids", T.ArrayType(T.IntegerType(), False))
    if not keep_text:
        schema = T.StructType([f for f in schema.fields if f.name != text_col])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``df`` with ``decoded``, the bytes that its ``ids`` stand for (none for null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, none = load(path, pattern), np.zeros(0, np.int32)
        hold(coder, coder.clear)
        for batch in chunks(batches, ROWS_AT_ONCE):
            out = [coder.decode(x.values.to_numpy() if x.is_valid else none) for x in batch.column("ids")]
            yield _with(batch, "decoded", pa.array(out, pa.binary()))

    return df.mapInArrow(run, _schema(df, "decoded", T.BinaryType()))
