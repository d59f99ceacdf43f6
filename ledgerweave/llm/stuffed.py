"""Keyword-stuffed, link-list and tag pages, by a hidden Markov model over the lines of a text.

A text is a chain of short units: lines, long lines cut at sentence ends and into spans.  Each unit shows one of a few signs
(what it looks like by itself); the hidden label is prose, field, links, tags or menu.  The model's probabilities are fitted by
Baum-Welch, without labels, on all texts, from a prior that says what each label is about.  The signs of a text are found once
and staged; a round of the fit is a map over them of which only the sums of expected counts meet.  The most probable chain of
labels is found by the Viterbi recursion, so that an ambiguous unit takes its label from its neighbours.  A page is flagged
when labels other than prose and field cover more than half of its words.

Defined results: null, empty and blank texts have no words and are not flagged; a very long text is labelled whole;
repeated rows give one row per id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerweave.plans.staging import Stage

WORD = re.compile(r"[^\W_]+")
HIDDEN = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
ENTITY = re.compile(r"&(?:nbsp|amp|quot|lt|gt|#\d+);")
LINK = re.compile(r"(?:https?|hxxps?)://[^\s<>\"')\]]*(?:\s?\[\s?(?:dot|\.)\s?\]\s?[^\s<>\"')\]]*)*|www\.[^\s<>\"')\]]+|\b[\w-]+(?:\.[\w-]+)*(?:\.|\s?\[\s?(?:dot|\.)\s?\]\s?)(?:com|net|org|info|biz|ru|io|example|test|invalid)\b(?:/[^\s<>\"')\]]*)?")
TAG = re.compile(r"(?<![\w/&])#[^\W\d][\w-]*")
PRICE = re.compile(r"[$€£₽]\s?\d[\d.,]*|\b\d[\d.,]*\s?(?:usd|eur|руб)\b\.?$|\b(?:sku|id|art\.?)\s?-?\d{3,}\b")
REFERENCE = re.compile(r"^\W*\[\d+\]\s*\S+$|^\W*\[\d+\]\s*[^.!?]{0,60}(?:https?://|www\.)\S+$")
FIELD = re.compile(r"^[\w #./-]{1,40}\s?[=:|]\s?\S")
#: A quotation wrapped over lines is one line.
QUOTED = re.compile(r"(?m)(^>[^\n]*)\n>")
LINE_END = re.compile(r"[\n\r\u2028\u2029\x0b\x0c\x85]+")
TABLE = re.compile(r"^\|.*\|$")
SENTENCE_END = re.compile(r"(?<=[.!?…])[\"»”)]*\s+|\s+—\s+(?=\S+\s\S+\s\S+)")
CLOSED = re.compile(r"[.!?…][\"»”)\]]*$")
CODE = re.compile(r"\d")
#: Words that hold sentences together, leaving out those common in trade phrases.
GLUE = frozenset(
    "the of to and or in on at by for from with that this these it its is was were be been are as not but if had has have which than then so we our they their "
    "until when while because despite only more into between through came went each every why what who how nothing nobody either same i he she said twice yet both among over under "
    "и в на к о у от до за из не но что как это для пока если хотя поэтому когда чтобы же ли бы его её их он она они мы был была были было есть нет ещё уже лишь почти чем или при "
    "во об под над между после перед этот эта тот такие которые который несмотря дают объясняет ни то".split()
)

LABELS = ("prose", "field", "links", "tags", "menu")
SIGNS = ("sentence", "likely", "field", "linked", "link", "reference", "tags", "repeated", "listed", "short")
#: Prior probability of each sign (in the order of SIGNS) under each label, of staying with a label, and of the first label.
EMIT = {
    "prose": (0.52, 0.27, 0.02, 0.05, 0.01, 0.01, 0.01, 0.02, 0.03, 0.06),
    "field": (0.02, 0.04, 0.76, 0.01, 0.01, 0.08, 0.01, 0.01, 0.01, 0.05),
    "links": (0.01, 0.03, 0.02, 0.03, 0.76, 0.01, 0.04, 0.02, 0.03, 0.05),
    "tags": (0.01, 0.03, 0.02, 0.01, 0.04, 0.01, 0.74, 0.05, 0.04, 0.05),
    "menu": (0.01, 0.04, 0.01, 0.01, 0.02, 0.01, 0.03, 0.42, 0.27, 0.18),
}
STAY = 0.8
START = (0.4, 0.15, 0.15, 0.15, 0.15)
FLAGGED = 0.5
#: Fitting: observations the prior of a label counts as, rounds.
PRIOR, ROUNDS = 20_000.0, 4
#: Units (filled up to the longest chain) that are added up at once; steps of expected counts, whose sums do not depend on the order of tasks.
BLOCK_UNITS, STEPS = 1 << 18, 1 << 20
#: Chains that are remembered in a worker, and units of one at most.
KNOWN_CHAINS, KNOWN_UNITS = 100_000, 40


class Chain:
    """A hidden Markov model of labels: first label, move from label to label, sign under each label."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit
        self._start, self._emit = np.log(start).tolist(), np.log(emit).T.tolist()
        self._into = np.log(move).T.tolist()  # log probabilities of coming from each label
        self._known: dict[bytes, list[int]] = {}

    @classmethod
    def prior(cls) -> Chain:
        n = len(LABELS)
        move = np.full((n, n), (1 - STAY) / (n - 1))
        np.fill_diagonal(move, STAY)
        emit = np.array([EMIT[s] for s in LABELS])
        return cls(np.array(START), move, emit / emit.sum(axis=1, keepdims=True))

    def table(self) -> np.ndarray:
        """A row for each label: first label, moves from it, signs under it."""
        return np.column_stack([self.start, self.move, self.emit])

    def fitted(self, sequences: list[list[int]], weight: float = PRIOR, rounds: int = ROUNDS) -> Chain:
        """Baum-Welch from this model, which counts as ``weight`` observations of each label; without sequences the model itself."""
        chains, now = Counter(map(bytes, sequences)), self
        for _ in range(rounds if sequences else 0):
            now = self.learned(now.expected(chains), weight)
        return now

    def learned(self, counts: np.ndarray, weight: float) -> Chain:
        """The model of expected counts, to which this one adds ``weight`` observations of each label."""
        first, moves, signs = np.split(counts + weight * self.table(), [1, 1 + len(LABELS)], axis=1)
        return Chain(first[:, 0] / first.sum(), moves / moves.sum(axis=1, keepdims=True), signs / signs.sum(axis=1, keepdims=True))

    def expected(self, chains: dict[bytes, int]) -> np.ndarray:
        """Expected counts, laid out like ``table``, over chains of signs given how often each comes; many chains go forward and back at once."""
        out, longest = np.zeros(self.table().shape), sorted((c for c in chains if c), key=len, reverse=True)
        while longest:
            n = max(1, BLOCK_UNITS // len(longest[0]))
            out += self._expected(longest[:n], np.array([chains[c] for c in longest[:n]], dtype=float))
            longest = longest[n:]
        return out

    def _expected(self, chains: list[bytes], times: np.ndarray) -> np.ndarray:
        """The same for a block of chains, the longest first: units are laid out by place, those at place t being the first chains'."""
        sizes = np.array([len(c) for c in chains])
        place, chain = np.nonzero(np.arange(sizes[0])[:, None] < sizes)
        ends = np.cumsum(np.bincount(place)).tolist()
        begins = [0, *ends[:-1]]
        signs = np.empty(len(place), np.uint8)
        signs[np.lexsort((place, chain))] = np.frombuffer(b"".join(chains), np.uint8)
        a, emit = np.empty((len(place), len(LABELS))), self.emit.T[signs]
        scale, ahead, back = np.empty((len(place), 1)), np.empty_like(a), np.ones_like(a)
        x = self.start * emit[: ends[0]]
        for i, j in zip(begins, ends):
            if i:
                x = (a[before : before + j - i] @ self.move) * emit[i:j]
            scale[i:j] = total = x.sum(axis=1, keepdims=True)
            a[i:j] = x / total
            before = i
        emit /= scale
        for i, j, before in zip(begins[:0:-1], ends[:0:-1], begins[-2::-1]):
            ahead[i:j] = now = emit[i:j] * back[i:j]
            back[before : before + j - i] = now @ self.move.T
        held, n = a * back * times[chain][:, None], ends[0]
        came = np.array(begins)[place[n:] - 1] + chain[n:]  # the unit before
        moves = (a[came] * times[chain[n:], None]).T @ ahead[n:] * self.move
        return np.column_stack([held[:n].sum(axis=0), moves, [np.bincount(signs, h, len(SIGNS)) for h in held.T]])

    def _forward(self, seen: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the label at each unit given the units up to it, and what they were scaled by."""
        a, scale = np.empty((len(seen), len(LABELS))), np.empty(len(seen))
        for t, o in enumerate(seen):
            x = (a[t - 1] @ self.move if t else self.start) * self.emit[:, o]
            scale[t] = x.sum()
            a[t] = x / scale[t]
        return a, scale

    def label(self, signs: list[int] | bytes) -> list[int]:
        """Most probable labels (Viterbi); chains that come again, as those of short texts do, are remembered."""
        if not signs:
            return []
        key = bytes(signs)
        if key in self._known:
            return self._known[key]
        emit, into = self._emit, self._into
        score = [a + b for a, b in zip(self._start, emit[signs[0]])]
        back = []
        for o in signs[1:]:
            came, new = [], []
            for row, e in zip(into, emit[o]):
                reached = list(map(add, score, row))
                best = max(reached)
                came.append(reached.index(best))
                new.append(best + e)
            back.append(came)
            score = new
        at = score.index(max(score))
        out = [at]
        for b in reversed(back):
            at = b[at]
            out.append(at)
        out.reverse()
        if len(key) <= KNOWN_UNITS and len(self._known) < KNOWN_CHAINS:
            self._known[key] = out
        return out


LINE_WORDS, SPAN_WORDS = 28, 18


def units_of(text: str) -> list[tuple[str, bool]]:
    """Units of a text; whether the unit is a line of its own."""
    out: list[tuple[str, bool]] = []
    text = QUOTED.sub(r"\1 ", ENTITY.sub(" ", HIDDEN.sub("", text)))
    for line in LINE_END.split(text):
        line = " ".join(line.split())
        if not line:
            continue
        if len(line) < 120 or len(line.split()) <= LINE_WORDS and len(WORD.findall(line)) <= 3 * LINE_WORDS:
            parts = SENTENCE_END.split(line)
            out += [(p, len(parts) == 1) for p in parts if p]
            continue
        for sentence in SENTENCE_END.split(line):
            words = sentence.split()
            if len(words) <= LINE_WORDS:
                out.append((sentence, False))
            else:
                n = -(-len(words) // SPAN_WORDS)
                step = -(-len(words) // n)
                out += [(" ".join(words[i : i + step]), False) for i in range(0, len(words), step)]
    return out


class _Unit:
    __slots__ = ("text", "alone", "words", "rest", "links", "tags")

    def __init__(self, text: str, alone: bool):
        self.text, self.alone = text.lower().replace("ё", "е"), alone
        self.words = len(WORD.findall(self.text))
        bare, self.links = LINK.subn(" ", self.text) if "." in self.text or "[" in self.text or "://" in self.text else (self.text, 0)
        bare, self.tags = TAG.subn(" ", bare) if "#" in bare else (bare, 0)
        self.rest = WORD.findall(bare)


def _content(words: list[str]) -> tuple[str, ...]:
    return tuple([w for w in words if w not in GLUE and (w.isalpha() or not CODE.search(w))])


def signs_of(text: str) -> tuple[list[int], list[int]]:
    """Sign and number of words of each unit that has words."""
    units = [u for u in (_Unit(t, a) for t, a in units_of(text)) if u.words]
    # how often a word comes in different units: the same sentence again (a log) adds nothing
    spread = Counter()
    for c in {_content(u.rest) if len(u.rest) >= 5 else (*_content(u.rest), i) for i, u in enumerate(units)}:
        spread.update({w for w in c if isinstance(w, str)})
    often = max(3, 0.04 * len(units))
    out = []
    for u in units:
        t, rest = u.text, u.rest
        n = len(rest)
        glue = sum([w in GLUE for w in rest])
        kinds = len(set(rest))
        again = 1 - kinds / n if n else 0.0
        content = _content(rest)
        common = sum([spread[w] >= often for w in content]) / len(content) if content else 0.0
        cuts = sum([t.count(x) for x in ",;|/•·»–"]) / max(n, 1)
        closed = bool(CLOSED.search(t))
        sentence = n >= 5 and (glue >= max(1, 0.11 * n)) and again < 0.34 and cuts < 0.3
        likely = n >= 5 and again < 0.2 and cuts <= 0.2 and (closed or n >= 7 and glue >= 1) and common < 0.8
        if u.links:
            sign = "reference" if REFERENCE.match(t) else "linked" if (sentence or likely) and n >= 5 * u.links else "link"
        elif u.tags and u.tags * 3 >= n:
            sign = "tags"
        elif PRICE.search(t) and not sentence and not (closed and n >= 8 and cuts < 0.15):
            sign = "tags"
        elif TABLE.match(t):
            sign = "field"
        elif sentence and not (common >= 0.9 and cuts >= 0.18):
            sign = "sentence"
        elif u.alone and FIELD.match(t) and (any(CODE.search(w) for w in rest) or "=" in t or n <= 3) and again < 0.34 and (common < 0.7 or any(CODE.search(w) for w in rest)):
            sign = "field"
        elif n >= 4 and again >= 0.34:
            sign = "repeated"
        elif likely:
            sign = "likely"
        elif n >= 4 and (cuts >= 0.15 or common >= 0.7 or glue == 0 and not closed):
            sign = "listed"
        elif n < 5 and common >= 0.7 and len(units) > 4:
            sign = "listed"
        else:
            sign = "short"
        out.append(SIGNS.index(sign))
    return out, [u.words for u in units]


def _share(signs: list[int] | bytes, sizes: list[int], chain: Chain) -> float:
    total = sum(sizes)
    return sum(n for s, n in zip(chain.label(signs), sizes) if s >= 2) / total if total else 0.0


def stuffed_share(text: str | None, chain: Chain | None = None) -> float:
    """Share of the words of a text that are labelled links, tags or menu; 0 for a text without words."""
    return _share(*signs_of(text), chain or PRIOR_CHAIN) if text else 0.0


def signs_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, signs, words) of the texts that have words: the sign of each unit, a byte each, and its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [signs_of(x.as_py()) for x in b.column(1)]
            some = [(bytes(s), n) for s, n in found if s]
            kept = b.column(0).filter(pa.array([bool(s) for s, _ in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept, pa.array([s for s, _ in some], pa.binary()), pa.array([n for _, n in some], pa.list_(pa.int32()))], ["key", "signs", "words"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(run, T.StructType([rows.schema["key"], T.StructField("signs", T.BinaryType()), T.StructField("words", T.ArrayType(T.IntegerType()))]))


def fit_chain(signs: DataFrame, rounds: int = ROUNDS) -> Chain:
    """The model fitted on every text of a table of signs; a round reads it once, and a sum a task and parameter meets."""
    now = PRIOR_CHAIN
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: Chain = now) -> Iterator[pa.RecordBatch]:
            total = sum((model.expected(Counter(b.column(0).to_pylist())) for b in batches), np.zeros(model.table().shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(np.rint(total.ravel() * STEPS).astype(np.int64))], ["cell", "steps"])

        sums = signs.select("signs").mapInArrow(run, "cell long, steps long").groupBy("cell").agg(F.sum("steps").alias("steps")).collect()
        counts = np.zeros(now.table().shape)
        for r in sums:
            counts.flat[r.cell] = r.steps / STEPS
        now = PRIOR_CHAIN.learned(counts, PRIOR)
    return now


def find_stuffed(df: DataFrame, key: str, text: str, flagged: float = FLAGGED) -> DataFrame:
    """(key) of pages of which more than ``flagged`` of the words are no sentences; a scan, the rounds of the fit over staged signs and a map."""
    signs = Stage(df.sparkSession).write(signs_table(df, key, text))
    chain = fit_chain(signs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [_share(s, n, chain) > flagged for s, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(hit, pa.bool_()))], [key])

    return signs.mapInArrow(run, T.StructType([df.schema[key]])).distinct()


PRIOR_CHAIN = Chain.prior()
