"""Most similar vectors for every vector, by stable random projections, a kd-tree and a chi-square stopping test.

A Gaussian (2-stable) projection of a difference of length d to m dimensions has the squared length d^2 times a chi-square
variable of m degrees of freedom.  So, taking the neighbours of a vector in the projected space in the order of a kd-tree and
verifying each by its true similarity, the search may stop at the projected length r as soon as

    r^2 > q * d_k^2,        q the chi-square quantile of the wanted confidence,

d_k being the distance of the k-th best verified neighbour, or of the similarity floor while there are fewer than k.

The top of the tree, fitted on a bounded sample, cuts the projected space into cells; every vector is indexed in its cell, and
in the cell beyond a plane if it lies within the margin of the plane.  Planes are put where they repeat few vectors, and a part
that no plane divides (a clump narrower than the margin) is left whole; the vectors of a cell that is larger than a task
should hold are cut into blocks, and every two blocks meet in a task of their own.  So no task grows with the data, whatever
its shape.  Each task is finished by a kd-tree of its own.  Equal vectors are indexed once (a node), so that copies, however
many, never fill a cell; their members are joined to the nodes' results at the end.

Cells compare vectors rounded to 12 bits.  The rounding error of every similarity is bounded; where it could decide
(a similarity at the floor, a k-th place disputed by the next ones) the similarities are taken again from the table's values.

Of a key delivered several times the row of the highest version counts.  Only keys that may be repeated are shuffled for
this: a bitmap of repeated keys, of bounded size, is broadcast, and rows not in it go straight to their cells.

Defined results: null, NaN and out-of-range values count as 0; vectors of zeros have no direction and no neighbours; null keys
are left out; ties go to the smaller key; an empty table has no pairs; columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql import Window as W

from ledgerweave.plans.skew import hot_keys, skew_join
from ledgerweave.plans.staging import Stage

#: Projected dimensions of the tree's top, and (even) of the search in a task, a part of the former; confidence of the stopping test.
TOP_DIMS, DIMS, CONFIDENCE = 64, 16, 0.999
#: Nodes of a task; sampled nodes for each cell of that size and at most in all; margin in units of the floor's distance; points of a leaf.
CELL_NODES, SAMPLE_PER_CELL, MAX_SAMPLE, MARGIN, LEAF = 32_768, 256, 1 << 18, 0.9, 512
#: Positions a plane is tried at, directions it is tried in, and the largest sum of its two shares.
CUTS, DIRECTIONS, MAX_SHARES = (0.3, 0.4, 0.5, 0.6, 0.7), 4, 1.5
#: Further candidates kept beside the k best, bits of the bitmap.
SPARE, MAX_BITS = 5, 1 << 24
SEED = 20240229


def chi2_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square distribution of an even number of degrees of freedom."""

    def cdf(x: float) -> float:
        t, s = 1.0, 1.0
        for i in range(1, m // 2):
            t *= x / 2 / i
            s += t
        return 1 - math.exp(-x / 2) * s

    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def projection(width: int, dims: int = TOP_DIMS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, dims)).astype(np.float32)


#: The largest component of a rounded vector: two components are kept in three bytes.
TOP = 2047


def round_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to a largest component of ``TOP`` and rounded; none may be all zeros."""
    return np.rint(x / np.abs(x).max(axis=1, keepdims=True) * TOP).astype(np.int16)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Rows of rounded components as bytes."""
    n, w = codes.shape
    x = np.zeros((n, w + w % 2), dtype=np.uint16)
    x[:, :w] = codes + TOP
    a, b = x[:, 0::2], x[:, 1::2]
    out = np.empty((n, a.shape[1], 3), dtype=np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = a & 255, (a >> 8) | ((b & 15) << 4), b >> 4
    return out.reshape(n, -1)


def unit_rows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions, and the largest angle that rounding can have turned each by."""
    v = codes.astype(np.float32)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    turned = 0.5 * math.sqrt(codes.shape[1]) / size[:, 0] + 1e-6
    return v / size, turned


def slack(s, turned_sum):
    """Bound of the error of a cosine near ``s`` when the angle is off by at most ``turned_sum``; numpy or columns."""
    if isinstance(s, Column):
        return F.sqrt(F.greatest(F.lit(0.0), 1 - s * s)) * turned_sum + turned_sum * turned_sum + 2e-6
    return np.sqrt(np.maximum(0, 1 - s * s)) * turned_sum + turned_sum * turned_sum + 2e-6


def _codes(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column as a matrix of components."""
    n, size = len(column), (width + 1) // 2 * 3
    if not n:
        return np.zeros((0, width), np.int16)
    at = np.frombuffer(column.buffers()[1], dtype=np.int32, count=n + 1, offset=4 * column.offset)
    x = np.frombuffer(column.buffers()[2], dtype=np.uint8, count=n * size, offset=int(at[0])).reshape(n, -1, 3).astype(np.int16)
    out = np.empty((n, x.shape[1], 2), dtype=np.int16)
    out[:, :, 0] = x[:, :, 0] | ((x[:, :, 1] & 15) << 8)
    out[:, :, 1] = (x[:, :, 1] >> 4) | (x[:, :, 2] << 4)
    return out.reshape(n, -1)[:, :width] - TOP


class Cells:
    """The top of the tree: planes at its inner nodes, tasks at its leaves.

    ``sample`` stands for ``weight`` nodes each.  A part of more than ``cell_nodes`` nodes is cut by the plane that leaves the
    least work, if that divides it; the work of comparing grows with the square of a part.
    """

    def __init__(self, sample: np.ndarray, weight: float, cell_nodes: int, margin: float):
        self.margin = margin
        normal, value, kids, self.blocks = [], [], [], []
        todo = [(sample, None, 0)]
        dims = sample.shape[1]
        while todo:
            part, parent, side = todo.pop()
            if parent is not None:
                kids[parent][side] = len(kids)
            plane = self._plane(part, margin) if len(part) * weight > cell_nodes and len(part) >= 8 else None
            kids.append([-1, -1])
            if plane is None:
                normal.append(np.zeros(dims, np.float32))
                value.append(0.0)
                kids[-1] = [-1 - len(self.blocks)] * 2
                # a third above the cell's size is the sample's own noise
                n = len(part) * weight
                self.blocks.append(1 if n <= 1.34 * cell_nodes else math.ceil(n / (0.5 * cell_nodes)))
                continue
            normal.append(plane[0])
            value.append(plane[1])
            y = part @ plane[0] - plane[1]
            todo += [(part[y > -margin], len(kids) - 1, 1), (part[y <= margin], len(kids) - 1, 0)]
        self.normal, self.value, self.kids = np.array(normal), np.array(value, np.float32), np.array(kids)
        # a cell of one block is one task, a cell of b blocks has a task for every two blocks and for every block with itself
        self.first = np.concatenate([[0], np.cumsum([b * (b + 1) // 2 for b in self.blocks])])
        self.tasks = int(self.first[-1])

    @staticmethod
    def _plane(part: np.ndarray, margin: float) -> tuple[np.ndarray, float] | None:
        """The plane of least work among a few along the principal axes of the part."""
        _, axes = np.linalg.eigh(np.cov(part.T))
        best = None
        for axis in axes.T[::-1][:DIRECTIONS].astype(np.float32):
            y = np.sort(part @ axis)
            for q in CUTS:
                v = y[int(q * len(y))]
                left, right = np.searchsorted(y, v + margin, "right") / len(y), 1 - np.searchsorted(y, v - margin, "right") / len(y)
                cost = left * left + right * right
                if left + right <= MAX_SHARES and (best is None or cost < best[0]):
                    best = (cost, axis, float(v))
        return best and best[1:]

    def assign(self, p: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, task, side) of every task that a projected point belongs to; side 0 or 1 in a task of two blocks, else 2."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(np.arange(len(p)), 0)]
        while todo:
            rows, node = todo.pop()
            if not len(rows):
                continue
            if self.kids[node][0] < 0:
                done.append((rows, np.full(len(rows), -1 - self.kids[node][0])))
                continue
            y = p[rows] @ self.normal[node] - self.value[node]
            todo += [(rows[y <= self.margin], self.kids[node][0]), (rows[y > -self.margin], self.kids[node][1])]
        out = []
        for rows, leaf in done:
            b, start = self.blocks[leaf[0]], self.first[leaf[0]]
            if b == 1:
                out.append((rows, np.full(len(rows), start), np.full(len(rows), 2)))
                continue
            mine = (h[rows].astype(np.uint64) % np.uint64(b)).astype(np.int64)
            for other in range(b):
                low, high = np.minimum(mine, other), np.maximum(mine, other)
                out.append((rows, start + high * (high + 1) // 2 + low, np.where(low == high, 2, mine == high)))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))


def kd_leaves(p: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree over the points."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        q = p[rows]
        d = int(np.argmax(q.max(axis=0) - q.min(axis=0)))
        half = len(rows) // 2
        order = np.argpartition(q[:, d], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


class _Best:
    """The ``keep`` best neighbours of every row, best first."""

    def __init__(self, n: int, keep: int, floor: float):
        self.s, self.mate, self.keep, self.floor = np.full((n, keep), -2.0, np.float32), np.full((n, keep), -1, np.int64), keep, floor

    def _merge(self, rows: np.ndarray, s: np.ndarray, mate: np.ndarray) -> None:
        s, mate = np.hstack([self.s[rows], s]), np.hstack([self.mate[rows], mate])
        at = np.argsort(-s, axis=1, kind="stable")[:, : self.keep]
        self.s[rows], self.mate[rows] = np.take_along_axis(s, at, 1), np.take_along_axis(mate, at, 1)

    def offer_block(self, rows: np.ndarray, cols: np.ndarray, s: np.ndarray) -> None:
        """Similarities of all of ``rows`` to all of ``cols``."""
        some = np.flatnonzero(s.max(axis=1) > np.maximum(self.s[rows, -1], self.floor))
        if not len(some):
            return
        s = s[some]
        at = np.argpartition(-s, self.keep - 1, axis=1)[:, : self.keep] if s.shape[1] > self.keep else np.broadcast_to(np.arange(s.shape[1]), s.shape)
        top = np.take_along_axis(s, at, 1)
        ok = top >= self.floor
        self._merge(rows[some], np.where(ok, top, np.float32(-2)), np.where(ok, cols[at], -1))

    def offer_pairs(self, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> None:
        """Single candidates: b for a."""
        order = np.lexsort((-s, a))
        a, b, s = a[order], b[order], s[order]
        rows, start, size = np.unique(a, return_index=True, return_counts=True)
        place = np.arange(len(a)) - np.repeat(start, size)
        few = place < self.keep
        at, place = np.repeat(np.arange(len(rows)), size)[few], place[few]
        ts, tm = np.full((len(rows), self.keep), -2.0, np.float32), np.full((len(rows), self.keep), -1, np.int64)
        ts[at, place], tm[at, place] = s[few], b[few]
        self._merge(rows, ts, tm)


def search_cell(v: np.ndarray, p: np.ndarray, k: int, floor: float, quantile: float, leaf: int = LEAF, keep: int | None = None, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity): for every row its at most ``keep`` (by default ``k``) most similar rows of similarity ``floor`` or more.

    Leaves are searched pairwise in the order of the distance of their boxes, both ways at once; a pair of leaves is left out
    when the stopping test holds for all their points.  With ``side``, only rows of different sides are compared.
    """
    n = len(v)
    best = _Best(n, keep or k, floor)
    reach = np.full(n, quantile * (2 - 2 * floor), dtype=np.float32)
    parts = [np.arange(n)] if side is None else [np.flatnonzero(side == x) for x in (0, 1)]
    leaves, half_of = [], []
    for x, rows in enumerate(parts):
        if len(rows):
            got = [rows[r] for r in kd_leaves(p[rows], leaf)]
            leaves += got
            half_of += [x] * len(got)
    half_of = np.array(half_of)
    lo = np.array([p[r].min(axis=0) for r in leaves], dtype=np.float32)
    hi = np.array([p[r].max(axis=0) for r in leaves], dtype=np.float32)
    # one product gives minus half the squared distance: (p, -|p|^2/2, 1) . (q, 1, -|q|^2/2)
    half = (p * p).sum(axis=1, keepdims=True) / 2
    one = np.ones_like(half)
    here = [np.ascontiguousarray(np.hstack([p[r], -half[r], one[r]])) for r in leaves]
    there = [np.ascontiguousarray(np.hstack([p[r], one[r], -half[r]]).T) for r in leaves]
    far = np.array([reach[r].max() for r in leaves], dtype=np.float32)

    def shrink(i: int) -> None:
        kth = best.s[leaves[i], k - 1]
        reach[leaves[i]] = np.where(kth >= floor, quantile * np.maximum(0, 2 - 2 * kth) + 1e-4, reach[leaves[i]])
        far[i] = reach[leaves[i]].max()

    for i in range(len(leaves)):
        gap = np.maximum(0, np.maximum(lo[i:] - hi[i], lo[i] - hi[i:]))
        box = (gap * gap).sum(axis=1)
        near = np.flatnonzero(box <= np.maximum(far[i], far[i:]))
        for j in near[np.argsort(box[near], kind="stable")] + i:
            if box[j - i] > max(far[i], far[j]) or side is not None and half_of[i] == half_of[j]:
                continue
            minus = here[i] @ there[j]
            # candidates: projected distance within the reach of either point
            hit = np.flatnonzero(minus.ravel() >= np.float32(-max(far[i], far[j]) / 2))
            if not len(hit):
                continue
            if len(hit) * 50 > minus.size:
                s = v[leaves[i]] @ v[leaves[j]].T
                if i == j:
                    np.fill_diagonal(s, -2)
                    best.offer_block(leaves[i], leaves[i], s)
                else:
                    best.offer_block(leaves[i], leaves[j], s)
                    best.offer_block(leaves[j], leaves[i], s.T)
            else:
                a, b = np.divmod(hit, len(leaves[j]))
                d2 = -2 * minus.ravel()[hit]
                a, b = leaves[i][a], leaves[j][b]
                ok = d2 <= np.maximum(reach[a], reach[b])
                if i == j:
                    ok &= a < b
                a, b = a[ok], b[ok]
                s = np.einsum("ij,ij->i", v[a], v[b])
                ok = s >= floor
                if not ok.any():
                    continue
                a, b, s = a[ok], b[ok], s[ok]
                best.offer_pairs(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s]))
            shrink(i)
            shrink(j)
    a, c = np.nonzero(best.mate >= 0)
    return a, best.mate[a, c], best.s[a, c]


def _clean(c: Column, low: float, high: float) -> Column:
    x = c.cast("double")
    return F.when(x.between(low, high), x + F.lit(0.0)).otherwise(0.0)  # NaN is above all numbers; -0.0 becomes 0.0


def _pack(rows: DataFrame, key: str, version: str, columns: list[str], low: float, high: float) -> DataFrame:
    """(key, version, h, vec): hash of the values, and rounded direction; a vector of zeros is empty."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("version", T.LongType()), T.StructField("h", T.LongType()), T.StructField("vec", T.BinaryType())])
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.empty((width, b.num_rows))
            for i in range(width):
                x[i] = b.column(i + 2).to_numpy(zero_copy_only=False)
            x = np.ascontiguousarray(x.T)
            x[~((x >= low) & (x <= high))] = 0.0
            x += 0.0
            h = np.array([int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little", signed=True) for r in x], dtype=np.int64)
            some = (x != 0).any(axis=1)
            codes = pack_codes(round_rows(x[some]))
            ends = np.concatenate([[0], np.cumsum(np.where(some, codes.shape[1], 0))]).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h), data], ["key", "version", "h", "vec"])

    source = rows.select(F.col(key).cast("long").alias("key"), F.col(version).cast("long").alias("version"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    return source.mapInArrow(run, schema)


def _flagged(df: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """``df`` with ``__maybe``: whether the key may be one of ``keys``, by a broadcast bitmap of at most ``MAX_BITS`` bits."""
    bits = min(MAX_BITS, 1 << max(12, (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    p, q = place(F.col("k")), place(F.col(key))
    # at most bits / 64 rows, 262,144 of them at the largest
    bitmap = keys.select((p / 64).cast("int").alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)).cast("int")).alias("bit")).groupBy("__word").agg(F.expr("bit_or(bit)").alias("__bits"))
    out = df.withColumn("__word", (q / 64).cast("int")).join(F.broadcast(bitmap), "__word", "left")
    maybe = F.coalesce(F.call_function("shiftrightunsigned", F.col("__bits"), F.pmod(q, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return out.withColumn("__maybe", maybe).drop("__word", "__bits")


def _latest(df: DataFrame, stage: Stage, key: str, version: str, columns: list[str], low: float, high: float) -> tuple[DataFrame, int, DataFrame]:
    """(key, h, vec) of the row of the highest version of every key, the number of keys, and the rows with ``__maybe`` repeated."""
    df = df.filter(F.col(key).isNotNull())
    sizes = stage.write(df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    n_keys, n_twice = sizes.agg(F.count(F.lit(1)), F.sum(F.when(F.col("n") > 1, 1).otherwise(0))).first()
    flagged = _flagged(df, key, sizes.filter("n > 1"), n_twice or 0)
    once = _pack(flagged.filter("not __maybe"), key, version, columns, low, high).select("key", "h", "vec")
    # the newest delivery is chosen among packed rows; an empty vector hides older ones
    newest = F.max(F.struct(F.coalesce("version", F.lit(-(2**62))).alias("version"), "h", "vec"))
    twice = _pack(flagged.filter("__maybe"), key, version, columns, low, high).groupBy("key").agg(newest.alias("x")).select("key", "x.h", "x.vec")
    return once.unionByName(twice).filter("length(vec) > 0"), int(n_keys), flagged


def _sample(flagged: DataFrame, key: str, version: str, columns: list[str], low: float, high: float, n_keys: int, wanted: int) -> tuple[np.ndarray, float]:
    """Projections of distinct vectors of a hash sample of about ``wanted`` keys, and how many keys each stands for."""
    part = max(1, n_keys // wanted)
    width, g = len(columns), projection(len(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = unit_rows(_codes(b.column(1), width))[0] @ g
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), TOP_DIMS).cast(pa.list_(pa.float32()))], ["h", "p"])

    some = _pack(flagged.filter(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(part)) == 0), key, version, columns, low, high).filter("length(vec) > 0").select("h", "vec").dropDuplicates(["h"])
    got = some.mapInArrow(run, T.StructType([T.StructField("h", T.LongType()), T.StructField("p", T.ArrayType(T.FloatType()))])).select("p").limit(2 * wanted).toArrow()
    return got.column(0).combine_chunks().flatten().to_numpy().reshape(-1, TOP_DIMS) if got.num_rows else np.zeros((0, TOP_DIMS), np.float32), part


def _spread(vectors: DataFrame, width: int, cells) -> DataFrame:
    """(task, side, h, key, vec): each distinct vector of a partition once per task; all members of those with copies also as (-1, 2, h, key, null)."""
    g = projection(width)
    schema = T.StructType([T.StructField("task", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("key", T.LongType()), T.StructField("vec", T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int | None] = {}  # first key of each vector, null once it is known to have copies
        tree = cells.value
        for b in batches:
            if not b.num_rows:
                continue
            h, key = b.column(1).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False)
            new = np.zeros(len(h), bool)
            copies: list[tuple[int, int]] = []
            for i, (x, y) in enumerate(zip(h.tolist(), key.tolist())):
                if x not in seen:
                    seen[x] = y
                    new[i] = True
                    continue
                if seen[x] is not None:
                    copies.append((x, seen[x]))
                    seen[x] = None
                copies.append((x, y))
            fresh = np.flatnonzero(new)
            if len(fresh):
                rows, task, side = tree.assign(unit_rows(_codes(b.column(2).take(pa.array(fresh)), width))[0] @ g, h[fresh])
                take = pa.array(fresh[rows])
                yield pa.RecordBatch.from_arrays([pa.array(task.astype(np.int32)), pa.array(side.astype(np.int32)), b.column(1).take(take), b.column(0).take(take), b.column(2).take(take)], names)
            if copies:
                n = len(copies)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), pa.array(np.full(n, 2, np.int32)), *[pa.array(np.array(c, dtype=np.int64)) for c in zip(*copies)], pa.nulls(n, pa.binary())], names)

    return vectors.select("key", "h", "vec").mapInArrow(run, schema)


def _search(width: int, k: int, floor: float, confidence: float):
    g, quantile = projection(width)[:, :DIMS], chi2_quantile(confidence, DIMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates (h, other, sim, turned) of one task and the members (h, key) of its nodes."""
        names = ["h", "other", "key", "sim", "turned"]
        hs, ks, codes, sides = [], [], [], []

        def members(h: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            n = len(h)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.nulls(n, pa.int64()), pa.array(key), pa.nulls(n, pa.float32()), pa.nulls(n, pa.float32())], names)

        for b in batches:
            if not b.num_rows:
                continue
            whole = b.column(0).to_numpy(zero_copy_only=False) >= 0
            h, key = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            if not whole.all():
                yield members(h[~whole], key[~whole])
            if whole.any():
                b = b.filter(pa.array(whole))
                hs.append(h[whole])
                ks.append(key[whole])
                sides.append(b.column(1).to_numpy(zero_copy_only=False))
                codes.append(_codes(b.column(4), width).copy())
        if not hs:
            return
        every, keys = np.concatenate(hs), np.concatenate(ks)
        h, first, which, times = np.unique(every, return_index=True, return_inverse=True, return_counts=True)
        side = np.concatenate(sides)[first]
        v, turned = unit_rows(np.concatenate(codes)[first])
        del codes
        lowest = floor - float(slack(np.float64(floor), 2 * float(turned.max(initial=0))))
        a, c, s = search_cell(v, v @ g, k, lowest, quantile, keep=k + SPARE, side=side if (side < 2).any() else None)
        # members of nodes that have neighbours or copies; those of nodes in several tasks are made distinct afterwards
        named = times > 1
        named[a] = True
        yield members(every[named[which]], keys[named[which]])
        for x in range(0, len(a), 50_000):
            y = slice(x, x + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(h[a[y]]), pa.array(h[c[y]]), pa.nulls(len(a[y]), pa.int64()), pa.array(s[y]), pa.array((turned[a[y]] + turned[c[y]]).astype(np.float32))], names)

    return run


def _cosine(x: Column, y: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda m, n: m * n), F.lit(0.0), lambda t, z: t + z)
    return F.least(F.lit(1.0), dot(x, y) / F.sqrt(dot(x, x) * dot(y, y)))


def _decided(edges: DataFrame, members: DataFrame, df: DataFrame, stage: Stage, key: str, version: str, columns: list[str], low: float, high: float, k: int, floor: float) -> DataFrame:
    """(h, other, sim) of the k best of each node: similarities that rounding could decide are taken from the table's values."""
    place = W.partitionBy("h").orderBy(F.desc("sim"), "other")
    e = edges.withColumn("off", slack(F.col("sim"), F.col("turned"))).withColumn("r", F.row_number().over(place))
    mine = W.partitionBy("h")
    kth, off = F.max(F.when(F.col("r") == k, F.col("sim"))).over(mine), F.max("off").over(mine)
    # the k-th place is disputed if the next candidate may be better
    next_ = F.max(F.when(F.col("r") == k + 1, F.col("sim"))).over(mine)
    doubt = F.coalesce(kth - next_ <= 2 * off, F.lit(False)) | F.max(F.abs(F.col("sim") - floor) <= F.col("off")).over(mine)
    e = stage.write(e.withColumn("doubt", doubt).select("h", "other", "sim", "doubt"))
    open_ = e.filter("doubt").select("h", "other")
    nodes = open_.select("h").unionByName(open_.select(F.col("other").alias("h"))).distinct()
    # one key of every node in doubt stands for it
    keys = stage.write(members.join(nodes, "h", "left_semi").groupBy("h").agg(F.min("key").alias("k")))
    n = keys.count()
    if not n:
        return e.filter((F.col("sim") >= floor)).withColumn("r", F.row_number().over(place)).filter(F.col("r") <= k).select("h", "other", "sim")
    near = _flagged(df.filter(F.col(key).isNotNull()), key, keys, n).filter("__maybe")
    values = near.select(F.col(key).alias("k"), F.coalesce(version, F.lit(-(2**62))).alias("n"), F.array(*[_clean(F.col(c), low, high) for c in columns]).alias("x"))
    values = stage.write(values.join(keys, "k").groupBy("h").agg(F.max_by("x", "n").alias("x")))
    true = open_.join(values, "h").join(values.select(F.col("h").alias("other"), F.col("x").alias("y")), "other").select("h", "other", _cosine(F.col("x"), F.col("y")).cast("double").alias("sim"))
    both = e.filter("not doubt").select("h", "other", F.col("sim").cast("double").alias("sim")).unionByName(true)
    return both.filter(F.col("sim") >= floor).withColumn("r", F.row_number().over(place)).filter(F.col("r") <= k).select("h", "other", "sim")


def similar_pairs(
    df: DataFrame, key: str, columns: list[str], version: str, low: float, high: float, k: int = 5, floor: float = 0.95, confidence: float = CONFIDENCE, cell_nodes: int = CELL_NODES, margin: float = MARGIN
) -> DataFrame:
    """(a, b), a < b: one of the two is among the ``k`` most similar keys of the other and their cosine is ``floor`` or more."""
    stage, width, spark = Stage(df.sparkSession), len(columns), df.sparkSession
    # only what is named is read, under names of its own: other columns of the table cannot clash
    df = df.select(F.col(key).cast("long").alias("__k"), F.col(version).cast("long").alias("__n"), *[F.col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(columns)])
    key, version, columns = "__k", "__n", [f"__f{i}" for i in range(width)]
    vectors, n_keys, flagged = _latest(df, stage, key, version, columns, low, high)
    points, weight = np.zeros((0, TOP_DIMS), np.float32), 1.0
    if n_keys > cell_nodes:
        points, weight = _sample(flagged, key, version, columns, low, high, n_keys, min(MAX_SAMPLE, max(512, SAMPLE_PER_CELL * n_keys // cell_nodes)))
    cells = Cells(points, weight, cell_nodes, margin * math.sqrt(2 - 2 * floor))
    n_tasks, n_more = cells.tasks, max(1, len(cells.blocks))
    spread = _spread(vectors, width, spark.sparkContext.broadcast(cells))
    # one partition per task; copies are spread over further partitions
    part_of = F.when(F.col("task") >= 0, F.col("task")).otherwise(F.lit(n_tasks) + F.pmod(F.hash("key"), F.lit(n_more))).cast("int")
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("other", T.LongType()), T.StructField("key", T.LongType()), T.StructField("sim", T.FloatType()), T.StructField("turned", T.FloatType())])
    found = stage.write(spread.repartitionById(n_tasks + n_more, part_of).mapInArrow(_search(width, k, floor, confidence), schema))

    members = stage.write(found.filter("key is not null").select("h", "key").distinct())
    edges = found.filter("other is not null").groupBy("h", "other").agg(F.max("sim").alias("sim"), F.max("turned").alias("turned"))
    edges = stage.write(_decided(edges, members, df, stage, key, version, columns, low, high, k, floor))
    stage.drop(found)
    first = members.withColumn("r", F.row_number().over(W.partitionBy("h").orderBy("key"))).filter(F.col("r") <= k + 1)
    theirs = edges.join(first.filter(F.col("r") <= k).select(F.col("h").alias("other"), "key"), "other").select("h", "sim", "key")
    own = first.select("h", F.lit(1.0).alias("sim"), "key")
    # at most k + 1 of its own and k * k of others, per node
    ranked = theirs.unionByName(own).groupBy("h").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "key"))).alias("c")).filter(F.size("c") > 1)
    hot = hot_keys(members, "h")
    pairs = skew_join(members, ranked, "h", hot)
    near = F.slice(F.filter("c", lambda x: x["key"] != F.col("key")), 1, k)
    pairs = pairs.select("key", F.explode(near).alias("x")).select(F.least("key", "x.key").alias("a"), F.greatest("key", "x.key").alias("b"))
    return pairs.distinct()
