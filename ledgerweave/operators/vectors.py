"""Vector joins: nearest anchors, pairs within a radius, anchor pools, eras and training pairs.

Joins of two vector tables go block by block: either side is cut into parts, every part meets every part of the other side
once, as a matrix product, and only the k best (or the pairs within the radius) leave a block.  Ties go to the smaller key.
Vectors that are null or hold a null are left out.  An empty side gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerweave.plans.skew import hot_keys, skew_join
from ledgerweave.plans.staging import Stage

#: Rows of a part.
PART_ROWS = 20_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(c)
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _blocks(left: DataFrame, right: DataFrame, by: list[str], part_rows: int):
    """Both sides with the number of each block they take part in; parts by hash, so neither side is collected."""
    a = max(1, -(-left.count() // part_rows))
    b = max(1, -(-right.count() // part_rows))
    keys = by + ["__block"]
    lb = left.withColumn("__p", F.pmod(F.xxhash64("l"), F.lit(a)).cast("int")).withColumn("__block", F.explode(F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.col("__p") * b + i)))
    rb = right.withColumn("__p", F.pmod(F.xxhash64("r"), F.lit(b)).cast("int")).withColumn("__block", F.explode(F.transform(F.sequence(F.lit(0), F.lit(a - 1)), lambda i: i * b + F.col("__p"))))
    return lb.drop("__p").groupBy(*keys), rb.drop("__p").groupBy(*keys)


def _side(df: DataFrame, key: str, vec: str, name: str, by: list[str]) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    return df.filter(F.col(key).isNotNull() & v.isNotNull() & F.forall(F.coalesce(v, F.array()), lambda x: x.isNotNull())).select(*by, F.col(key).alias(name), v.alias(f"v{name}"))


def _pairwise(left: DataFrame, right: DataFrame, lkey: str, lvec: str, rkey: str, rvec: str, by: list[str], part_rows: int, choose) -> DataFrame:
    l, r = _side(left, lkey, lvec, "l", by), _side(right, rkey, rvec, "r", by)
    lg, rg = _blocks(l, r, by, part_rows)
    schema = T.StructType([*[l.schema[c] for c in by], l.schema["l"], r.schema["r"], T.StructField("dist", T.DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = _matrix(a.column("vl")), _matrix(b.column("vr"))
        out = []
        kr = b.column("r").to_numpy()
        order = np.argsort(kr, kind="stable")
        y, kr = y[order], kr[order]
        for i in range(0, len(x) if len(y) else 0, 500):
            p = x[i : i + 500]
            d2 = np.maximum(0, (p * p).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * p @ y.T)
            rows, cols = choose(d2)
            # the exact difference for those chosen, so that equal vectors are at distance 0
            d = np.sqrt(((p[rows] - y[cols]) ** 2).sum(1))
            out.append((rows + i, cols, d))
        rows, cols, d = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        data = [a.column(c).take(pa.array(rows)) for c in by] + [a.column("l").take(pa.array(rows)), pa.array(kr[cols]), pa.array(d)]
        return pa.table(data, names=[f.name for f in schema])

    return lg.cogroup(rg).applyInArrow(run, schema)


def nearest(queries: DataFrame, qkey: str, qvec: str, anchors: DataFrame, akey: str, avec: str, k: int, by: list[str] | None = None, exclude_self: bool = False, part_rows: int = PART_ROWS) -> DataFrame:
    """(by, l, r, dist, rank): the k nearest anchors of every query (within groups ``by``), Euclidean, exact."""
    by = by or []
    want = k + 1 if exclude_self else k

    def choose(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = d2.shape
        if m <= want:
            return tuple(np.indices((n, m)).reshape(2, -1))
        kth = np.partition(d2, want - 1, axis=1)[:, want - 1]
        return np.nonzero(d2 <= kth[:, None] * (1 + 1e-9) + 1e-9)

    pairs = _pairwise(queries, anchors, qkey, qvec, akey, avec, by, part_rows, choose)
    if exclude_self:
        pairs = pairs.filter("l != r")
    w = W.partitionBy(*by, "l").orderBy("dist", "r")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def within(left: DataFrame, lkey: str, lvec: str, right: DataFrame, rkey: str, rvec: str, radius: float, by: list[str] | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """(by, l, r, dist): all pairs at most ``radius`` apart."""
    pairs = _pairwise(left, right, lkey, lvec, rkey, rvec, by or [], part_rows, lambda d2: np.nonzero(d2 <= radius * radius * (1 + 1e-9) + 1e-9))
    return pairs.filter(F.col("dist") <= radius)


def recall_at(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(recall): share of the exact neighbours (l, r, rank <= k) that the approximate ones hold."""
    e = exact.filter(F.col("rank") <= k).select("l", "r")
    hit = e.join(approx.filter(F.col("rank") <= k).select("l", "r").distinct().withColumn("hit", F.lit(1)), ["l", "r"], "left")
    return hit.agg((F.count("hit") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("recall"))


def reduced(left: DataFrame, lkey: str, lvec: str, right: DataFrame, rkey: str, rvec: str, schema: T.StructType, reduce, by: list[str] | None = None, llabel: str | None = None, rlabel: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """What ``reduce(d, l, r, llabel, rlabel)`` makes of the distances of every block of rows: no pair is ever a row of a table.

    It gets a matrix of distances, the keys and labels of both sides (labels null where none is named) and gives arrays in the
    order of ``schema``.
    """
    by = by or []
    l, r = _side(left.withColumn("__y", F.col(llabel) if llabel else F.lit(None).cast("int")), lkey, lvec, "l", [*by, "__y"]), _side(right.withColumn("__z", F.col(rlabel) if rlabel else F.lit(None).cast("int")), rkey, rvec, "r", [*by, "__z"])
    lg, rg = _blocks(l, r, by, part_rows)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if len(a) and len(b):
            x, y = _matrix(a.column("vl")), _matrix(b.column("vr"))
            kl, kr, zl, zr = (t.column(c).to_numpy() for t, c in ((a, "l"), (b, "r"), (a, "__y"), (b, "__z")))
            size = (y * y).sum(1)[None, :]
            for i in range(0, len(x), 500):
                p = x[i : i + 500]
                d = np.sqrt(np.maximum(0, (p * p).sum(1)[:, None] + size - 2 * p @ y.T))
                d[kl[i : i + 500][:, None] == kr[None, :]] = 0.0
                out.append(reduce(d, kl[i : i + 500], kr, zl[i : i + 500], zr))
        kinds = to_arrow_schema(schema)
        cols = [np.concatenate([o[j] for o in out]) if out else [] for j in range(len(schema))]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, kinds)], schema=kinds)

    return lg.cogroup(rg).applyInArrow(run, schema)


class CellIndex:
    """An index of vectors in cells around centroids fitted on a bounded sample; every row is in the cell of its nearest one.

    A query visits the ``probes`` nearest cells.  A cell of more than ``part_rows`` rows is cut into blocks by hash, each of
    which the query visits, so that a crowded cell is never one task's.
    """

    def __init__(self, df: DataFrame, key: str, vec: str, cells: int | None = None, sample_rows: int = 50_000, part_rows: int = PART_ROWS, seed: int = 72):
        self.key, self.vec, self.seed = key, vec, seed
        rows = _side(df, key, vec, "r", [])
        n = rows.count()
        self.cells = cells or max(1, min(4096, int(n**0.5)))
        part = max(1, n // sample_rows)
        some = rows.filter(F.pmod(F.xxhash64("r"), F.lit(part)) == 0)
        self.empty = not n
        self.centroids = _centroids(some, "vr", self.cells, seed) if n else np.zeros((1, 1))
        stage = Stage(df.sparkSession)
        self.rows = stage.write(self._assign(rows, 1).select(F.get("__near", F.lit(0)).alias("__cell"), "r", "vr"))
        sizes = {r[0]: r[1] for r in self.rows.groupBy("__cell").count().collect()}  # one number a cell
        self.blocks = [max(1, -(-sizes.get(i, 0) // part_rows)) for i in range(len(self.centroids))]

    def _assign(self, df: DataFrame, probes: int, vec: str = "vr") -> DataFrame:
        """Adds ``__near``: the numbers of the nearest cells, nearest first."""
        c, empty = self.centroids, self.empty
        size = (c * c).sum(1)[None, :]
        names = df.columns
        k = min(probes, len(c))

        def run(batches):
            for b in batches:
                x = _matrix(b.column(names.index(vec)))
                d = size - 2 * x @ c.T if b.num_rows and not empty else np.zeros((b.num_rows, len(c)))
                near = np.argsort(d, axis=1, kind="stable")[:, :k].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], [*names, "__near"])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("__near", T.ArrayType(T.IntegerType()))]))

    def _meet(self, queries: DataFrame, rows: DataFrame, probes: int):
        """Both sides grouped by cell and block."""
        width = F.array(*[F.lit(b) for b in self.blocks])
        q = self._assign(queries, probes, "vl").withColumn("__cell", F.explode("__near")).drop("__near")
        q = q.withColumn("__block", F.explode(F.sequence(F.lit(0), F.get(width, F.col("__cell")) - 1)))
        r = rows.withColumn("__block", F.pmod(F.xxhash64("r"), F.get(width, F.col("__cell"))).cast("int"))
        return q.groupBy("__cell", "__block").cogroup(r.groupBy("__cell", "__block"))

    def nearest(self, queries: DataFrame, qkey: str, qvec: str, k: int, probes: int) -> DataFrame:
        """(l, r, dist, rank): the k nearest rows of the visited cells, by their exact distance."""
        q = _side(queries, qkey, qvec, "l", [])
        schema = T.StructType([q.schema["l"], self.rows.schema["r"], T.StructField("dist", T.DoubleType())])

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            kinds = to_arrow_schema(schema)
            if not len(a) or not len(b):
                return kinds.empty_table()
            x, y, kr = _matrix(a.column("vl")), _matrix(b.column("vr")), b.column("r").to_numpy()
            order = np.argsort(kr, kind="stable")
            y, kr = y[order], kr[order]
            out = []
            for i in range(0, len(x), 500):
                p = x[i : i + 500]
                d2 = np.maximum(0, (p * p).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * p @ y.T)
                top = np.argsort(d2, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(p)), top.shape[1])
                out.append((rows + i, top.ravel(), np.sqrt(((p[rows] - y[top.ravel()]) ** 2).sum(1))))
            rows, cols, d = (np.concatenate(z) for z in zip(*out))
            return pa.table([a.column("l").take(pa.array(rows)), pa.array(kr[cols]), pa.array(d)], names=schema.names).cast(kinds)

        return _best(self._meet(q, self.rows, probes).applyInArrow(run, schema), k)

    def coded_nearest(self, queries: DataFrame, qkey: str, qvec: str, books: np.ndarray, k: int, probes: int) -> DataFrame:
        """(l, r, dist, rank): the k nearest codes of the visited cells; a query makes one table of its distances to all
        centroids of all subspaces, and a code's distance is the sum of the entries it names."""
        m, c, w = books.shape
        q = _side(queries, qkey, qvec, "l", [])
        codes = pq_encode(self.rows.withColumn("vec", F.col("vr")).select(F.struct("__cell", "r").alias("__k"), "vec"), "__k", "vec", books).select("__k.*", "codes")
        schema = T.StructType([q.schema["l"], self.rows.schema["r"], T.StructField("dist", T.DoubleType())])

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            kinds = to_arrow_schema(schema)
            if not len(a) or not len(b):
                return kinds.empty_table()
            x = _matrix(a.column("vl")).reshape(len(a), m, w)
            at = _matrix(b.column("codes")).astype(np.int64)
            kr = b.column("r").to_numpy()
            out = []
            for i in range(0, len(x), 200):
                p = x[i : i + 200]
                d = np.zeros((len(p), len(at)))
                for j in range(m):
                    table = ((p[:, j, None, :] - books[j][None]) ** 2).sum(2)
                    d += table[:, at[:, j]]
                top = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
                out.append((np.repeat(np.arange(len(p)), top.shape[1]) + i, top.ravel(), np.sqrt(np.take_along_axis(d, top, 1)).ravel()))
            rows, cols, d = (np.concatenate(z) for z in zip(*out))
            return pa.table([a.column("l").take(pa.array(rows)), pa.array(kr[cols]), pa.array(d)], names=schema.names).cast(kinds)

        return _best(self._meet(q, codes, probes).applyInArrow(run, schema), k)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("l").orderBy("dist", "r"))).filter(F.col("rank") <= k)


def _centroids(df: DataFrame, vec: str, k: int, seed: int, iterations: int = 15) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.select(array_to_vector(F.col(vec)).alias("features"))
    return np.array(KMeans(k=k, maxIter=iterations, seed=seed).fit(x).clusterCenters())


def pq_train(df: DataFrame, vec: str, dim: int, m: int, centroids: int, sample_rows: int = 50_000, iterations: int = 15, seed: int = 72) -> np.ndarray:
    """Codebooks (m, centroids, dim / m) of a product quantiser, fitted on at most ``sample_rows`` rows chosen by hash."""
    n = df.count()
    part = max(1, n // sample_rows)
    some = df.filter(F.pmod(F.xxhash64(vec), F.lit(part)) == 0).select(F.col(vec).cast("array<double>").alias("v"))
    w = dim // m
    books = []
    for i in range(m):
        c = _centroids(some.select(F.slice("v", i * w + 1, w).alias("x")), "x", centroids, seed + i, iterations)
        books.append(np.array([*c, *[c[-1]] * (centroids - len(c))]))
    return np.array(books)


def pq_encode(df: DataFrame, key: str, vec: str, books: np.ndarray) -> DataFrame:
    """(key, codes): number of the nearest centroid in each subspace; the codebooks, of fixed size, go with the function."""
    m, c, w = books.shape
    kind = df.schema[key]

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1)).reshape(b.num_rows, m, w) if b.num_rows else np.zeros((0, m, w))
            codes = np.stack([((x[:, i, None, :] - books[i][None]) ** 2).sum(2).argmin(1) for i in range(m)], 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), m).cast(pa.list_(pa.int32()))], [kind.name, "codes"])

    return df.select(key, F.col(vec).cast("array<double>").alias("v")).mapInArrow(run, T.StructType([kind, T.StructField("codes", T.ArrayType(T.IntegerType()))]))


def rerank(short: DataFrame, queries: DataFrame, qkey: str, qvec: str, anchors: DataFrame, akey: str, avec: str, k: int) -> DataFrame:
    """(l, r, dist, rank): the k nearest of each query's shortlist (l, r) by the exact distance."""
    x = short.select("l", "r").join(_side(queries, qkey, qvec, "l", []), "l").join(_side(anchors, akey, avec, "r", []), "r")
    x = x.select("l", "r", F.sqrt(F.aggregate(F.zip_with("vl", "vr", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)).alias("dist"))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("l").orderBy("dist", "r"))).filter(F.col("rank") <= k)


def era_of(step: Column, split: int, width: int = 10) -> Column:
    return F.when(step <= split, "train").when(step <= split + width, "valid").when(step > split + width, "test")


def positive_pairs(edges: DataFrame, nodes: DataFrame, key: str, label: str, step: str, era: str, eps: int) -> DataFrame:
    """Edges between nodes of one label and era, at most ``eps`` steps apart."""
    n = nodes.select(key, label, step, era)
    a = n.select(F.col(key).alias("src"), F.col(label).alias("la"), F.col(step).alias("ta"), F.col(era).alias("ea"))
    b = n.select(F.col(key).alias("dst"), F.col(label).alias("lb"), F.col(step).alias("tb"), F.col(era).alias("eb"))
    return skew_join(edges, a, "src", hot_keys(edges, "src")).join(b, "dst").filter((F.col("la") == F.col("lb")) & (F.col("ea") == F.col("eb")) & (F.abs(F.col("ta") - F.col("tb")) <= eps)).select("src", "dst")


def hard_negatives(nodes: DataFrame, key: str, label: str, step: str, era: str, eps: int) -> DataFrame:
    """(a, b): all pairs of one era, at most ``eps`` steps apart, of different labels; steps are joined by equal distance, not crossed."""
    n = nodes.select(F.col(key).alias("a"), F.col(label).alias("la"), F.col(step).alias("t"), F.col(era).alias("e"))
    m = nodes.select(F.col(key).alias("b"), F.col(label).alias("lb"), F.explode(F.sequence(F.col(step) - eps, F.col(step) + eps)).alias("t"), F.col(era).alias("e"))
    return n.join(m, ["t", "e"]).filter((F.col("la") != F.col("lb")) & (F.col("a") < F.col("b"))).select("a", "b")


def sampling_probabilities(df: DataFrame, degree: str, alpha: float) -> DataFrame:
    """Adds p, in proportion to degree ** -alpha; the total is one row."""
    w = F.pow(F.col(degree).cast("double"), F.lit(-alpha))
    total = df.agg(F.sum(w).alias("__t"))
    return df.join(F.broadcast(total)).withColumn("p", w / F.col("__t")).drop("__t")
