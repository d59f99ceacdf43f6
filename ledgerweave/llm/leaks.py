"""Evaluation texts leaking into training text, by Wu-Manber search over words.

Test strings are the runs of ``words`` consecutive words of an item, or all words of a shorter item.  Strings of one length
form a group with a shift table of word pairs: a pair that no string of the group holds lets the search skip as far as a
string is long, less one; a pair that ends a string leads to the bucket of that pair, whose strings are compared directly.

Defined results: null and blank texts and items have no words and no cases; a very long text is searched whole; repeated
items and rows give one row per pair of ids.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

WORDS = 13
#: Items of one broadcast, and their characters.
ITEMS_PER_PART, ITEM_CHARS_PER_PART = 20_000, 40_000_000
#: Characters that are removed, and what a word is.
REMOVED = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(REMOVED.sub("", text or "").lower().replace("ё", "е"))


class Strings:
    """Test strings and their tables."""

    def __init__(self, items: list[tuple[int, str | None]], words: int = WORDS):
        groups: dict[int, dict[tuple[str, ...], set[int]]] = {}
        for item, text in items:
            w = words_of(text)
            n = min(words, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                groups.setdefault(n, {}).setdefault(tuple(w[i : i + n]), set()).add(item)
        self.groups = []
        for n, strings in sorted(groups.items()):
            if n == 1:
                self.groups.append((n, {}, {s[0]: ids for s, ids in strings.items()}))
                continue
            shift: dict[tuple[str, str], int] = {}
            bucket: dict[tuple[str, str], dict[tuple[str, ...], set[int]]] = {}
            for s, ids in strings.items():
                for j in range(1, n):
                    pair = (s[j - 1], s[j])
                    shift[pair] = min(shift.get(pair, n), n - 1 - j)
                bucket.setdefault((s[-2], s[-1]), {})[s] = ids
            self.groups.append((n, shift, bucket))

    def search(self, text: str | None) -> set[int]:
        w, found = words_of(text), set()
        size = len(w)
        for n, shift, bucket in self.groups:
            if n == 1:
                for x in bucket.keys() & set(w):
                    found |= bucket[x]
                continue
            at = n - 1
            while at < size:
                pair = (w[at - 1], w[at])
                step = shift.get(pair, n - 1)
                if step:
                    at += step
                    continue
                ids = bucket[pair].get(tuple(w[at - n + 1 : at + 1]))
                if ids:
                    found |= ids
                at += 1
        return found


#: Tables of a worker process, by broadcast: built once, not for every task.
_BUILT: dict[str, Strings] = {}


def _strings(shared, words: int) -> Strings:
    name, items = shared.value
    if name not in _BUILT:
        _BUILT.clear()  # one part's tables at a time
        _BUILT[name] = Strings(items, words)
    return _BUILT[name]


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, words: int = WORDS) -> DataFrame:
    """(key, item_key) of every text and item that share ``words`` consecutive words; the texts are read once.

    Items are broadcast in parts of bounded size.  With more than one part a task keeps its texts, one input split, and
    searches them for one part after the other, so that no more than one part's tables are held.
    """
    parts: list[list[tuple[int, str | None]]] = [[]]
    chars = 0
    for r in items.select(item_key, item_text).filter(f"`{item_key}` is not null").distinct().toLocalIterator():
        if len(parts[-1]) >= ITEMS_PER_PART or chars > ITEM_CHARS_PER_PART:
            parts.append([])
            chars = 0
        parts[-1].append((r[0], r[1]))
        chars += len(r[1] or "")
    shared = [docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, p)) for p in parts]
    kinds = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item_key, items.schema[item_key].dataType)])
    arrow = to_arrow_schema(kinds)
    source = docs.select(key, text).filter(f"`{key}` is not null and `{text}` is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = batches if len(shared) == 1 else list(batches)
        for part in shared:
            strings = _strings(part, words)
            for b in batches:
                a, c = [], []
                for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                    for item in strings.search(x.as_py()):
                        a.append(i)
                        c.append(item)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, arrow.field(0).type), pa.array(c, arrow.field(1).type)], schema=arrow)

    return source.mapInArrow(run, kinds).distinct()
