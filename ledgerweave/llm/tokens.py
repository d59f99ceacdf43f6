"""Encoding by a byte-level BPE vocabulary with a dynamic programme over byte prefixes.

An encoding is the one BPE gives exactly if every two neighbours in it are a pair BPE would leave alone.  Therefore every
byte prefix has one valid last token, and the table of last tokens is built left to right: of the vocabulary entries that
end at a byte, the one is taken that follows the last token of the prefix before it.  Following last tokens back gives the
ids.  The table never changes for a prefix, so appends are exact and an edit re-encodes only the pieces it touches.

Texts are cut into pieces by the vocabulary's pattern first; pieces are encoded once per worker and remembered.

Defined results: null and empty texts have no ids; special tokens written in a text are ordinary text; every other text,
blank or very long, is encoded whole; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: how this vocabulary cuts a text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by a worker, and their longest length in bytes; the memory is emptied when it is full.
REMEMBERED, REMEMBERED_BYTES = 400_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks of byte strings, which are their ids as well, and which neighbours BPE leaves alone."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.alone: dict[int, bool] = {}
        # lengths that occur, by last byte: which vocabulary entries can end at a position
        by_last: dict[int, set[int]] = {}
        for b in ranks:
            by_last.setdefault(b[-1], set()).add(len(b))
        self.lengths = {k: sorted(v, reverse=True) for k, v in by_last.items()}
        self.made = {i: self._merged(b) == [i] for i, b in self.bytes_of.items() if len(b) > 12}  # the short ones on demand
        self.known: dict[str, tuple[int, ...]] = {}

    def _merged(self, b: bytes) -> list[int]:
        """Plain BPE of a short string, lowest rank first, leftmost first: the definition the programme is held against."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether BPE builds this entry from its own bytes."""
        got = self.made.get(token)
        if got is None:
            got = self.made[token] = self._merged(self.bytes_of[token]) == [token]
        return got

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of a and b is a, b again."""
        key = a << 20 | b
        got = self.alone.get(key)
        if got is None:
            if len(self.alone) > 2_000_000:
                self.alone.clear()
            got = self.alone[key] = self._merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Append the last tokens of the prefixes of ``data`` longer than ``start``; last[i - 1] belongs to the prefix of i bytes."""
        ranks, lengths, bytes_of = self.ranks, self.lengths, self.bytes_of
        for end in range(start + 1, len(data) + 1):
            found = -1
            for n in lengths[data[end - 1]]:
                if n > end:
                    continue
                t = ranks.get(data[end - n : end], -1)
                if t >= 0 and (self.whole(t) if n == end else self.follows(last[end - n - 1], t)):
                    found = t
                    break
            assert found >= 0 and bytes_of[found]
            last.append(found)

    def back(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "replace")
        t = self.ranks.get(data)
        if t is not None and self.whole(t):
            return (t,)
        last: list[int] = []
        self.extend(data, last, 0)
        return tuple(self.back(last))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for p in self.pattern.findall(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = ids
            out += ids
        return out


class Prefixes:
    """The table of one growing text: exact appends and re-encoding near edits.

    Pieces before the last piece boundary that an append or edit can move are kept as they are.
    """

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.v, self.text, self.pieces = vocabulary, "", []
        self.append(text)

    def _cut(self, at: int) -> int:
        """Drop pieces that end after ``at`` and the two before, which look ahead; gives where the text goes on."""
        while self.pieces and self.pieces[-1][1] > at:
            self.pieces.pop()
        for _ in range(2):
            if self.pieces:
                self.pieces.pop()
        return self.pieces[-1][1] if self.pieces else 0

    def append(self, more: str) -> None:
        start = self._cut(len(self.text))
        self.text += more
        self._go(start)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] by ``new``; pieces behind it are found again as soon as the cuts meet the old ones."""
        shift = len(new) - (end - start)
        behind = {e + shift: k for k, (_, e, _) in enumerate(self.pieces) if e >= end}
        old = self.pieces[:]
        at = self._cut(start)
        self.text = self.text[:start] + new + self.text[end:]
        for m in self.v.pattern.finditer(self.text, at):
            self.pieces.append((m.start(), m.end(), self.v.piece(m.group())))
            k = behind.get(m.end())
            if k is not None and m.start() >= start + len(new):
                self.pieces += [(s + shift, e + shift, ids) for s, e, ids in old[k + 1 :]]
                break

    def _go(self, start: int) -> None:
        for m in self.v.pattern.finditer(self.text, start):
            self.pieces.append((m.start(), m.end(), self.v.piece(m.group())))

    def ids(self) -> list[int]:
        return [t for _, _, ids in self.pieces for t in ids]


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """One vocabulary, with what it remembers, per worker process."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(dict(shared.value))
    return _loaded[key]


def encode_texts(df: DataFrame, key: str, text: str, ranks: dict[bytes, int]) -> DataFrame:
    """(key, ids): one row per row of ``df``; a scan and a map, no shuffle.  The vocabulary, a fixed file, is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    kind = df.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            at, offsets, chunk = 0, [0], []
            for i in range(len(texts)):
                chunk += v.encode(texts[i].as_py() or "")
                offsets.append(len(chunk))
                if len(chunk) > 2_000_000 or i == len(texts) - 1:
                    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(chunk, dtype=np.int32)))
                    yield pa.RecordBatch.from_arrays([keys.slice(at, i + 1 - at), ids], [key, "ids"])
                    at, offsets, chunk = i + 1, [0], []

    return df.select(key, text).mapInArrow(run, T.StructType([kind, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
