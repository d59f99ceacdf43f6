"""Contrastive objectives and neighbourhood aggregation over tables of vectors.

Every row meets every other row once, in blocks, and only running maxima and sums of exponentials leave a block: no pair is
ever a row of a table.  Vectors of zeros have similarity 0 to all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerweave.operators.vectors import PART_ROWS, _blocks, _matrix, _side, reduced
from ledgerweave.plans.skew import hot_keys, skew_join
from ledgerweave.plans.staging import Stage


def log_sum_exp(left: DataFrame, lkey: str, lvec: str, right: DataFrame, rkey: str, rvec: str, temperature: float, exclude_self: bool, part_rows: int = PART_ROWS) -> DataFrame:
    """(l, lse): log of the sum over the right side of exp(cosine / temperature)."""
    a, b = _blocks(_side(left, lkey, lvec, "l", []), _side(right, rkey, rvec, "r", []), [], part_rows)
    kind = left.schema[lkey].dataType

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        if not len(p) or not len(q):
            return pa.table([pa.array([], p.column("l").type if len(p) else pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())], names=["l", "m", "s"])
        k, kr = p.column("l").to_numpy(), q.column("r").to_numpy()
        x, y = unit(_matrix(p.column("vl"))), unit(_matrix(q.column("vr")))
        top, total = np.empty(len(x)), np.empty(len(x))
        for i in range(0, len(x), 500):
            z = x[i : i + 500] @ y.T / temperature
            if exclude_self:
                z[k[i : i + 500][:, None] == kr[None, :]] = -np.inf
            m = z.max(axis=1)
            m = np.where(np.isfinite(m), m, -1e300)
            top[i : i + 500], total[i : i + 500] = m, np.where(m > -1e300, np.exp(z - m[:, None]).sum(axis=1), 0.0)
        return pa.table([p.column("l"), pa.array(top), pa.array(total)], names=["l", "m", "s"])

    parts = a.cogroup(b).applyInArrow(run, T.StructType([T.StructField("l", kind), T.StructField("m", T.DoubleType()), T.StructField("s", T.DoubleType())]))
    top = parts.groupBy("l").agg(F.max("m").alias("top"), F.collect_list(F.struct("m", "s")).alias("x"))  # one entry per block
    return top.select("l", (F.col("top") + F.log(F.aggregate("x", F.lit(0.0), lambda t, e: t + e["s"] * F.exp(e["m"] - F.col("top"))))).alias("lse"))


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0)), F.lit(0.0))


def nt_xent(df: DataFrame, key: str, vec: str, temperature: float) -> DataFrame:
    """(loss): mean over rows of logsumexp over all others minus the similarity to the partner; rows 2k and 2k + 1 are partners."""
    v = F.col(vec).cast("array<double>")
    rows = df.select(F.col(key).alias("l"), v.alias("v"))
    mate = df.select((F.col(key) + F.when(F.pmod(F.col(key), F.lit(2)) == 0, 1).otherwise(-1)).alias("l"), v.alias("w"))
    near = rows.join(mate, "l").select("l", (cosine(F.col("v"), F.col("w")) / temperature).alias("p"))
    return near.join(log_sum_exp(df, key, vec, df, key, vec, temperature, True), "l").agg(F.avg(F.col("lse") - F.col("p")).alias("loss"))


def anchor_loss(df: DataFrame, key: str, vec: str, label: str, by: str, pull_margin: float, push_margin: float, weight: float = 1.0) -> DataFrame:
    """(loss) over the pairs of each group ``by``: weighted sum of the mean hinge of distances above the pull margin, for like
    labels, and of distances below the push margin, for unlike ones.  A block of rows gives four sums."""
    fields = ("pull", "push", "n_pull", "n_push")
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in fields])

    def sums(d, l, r, zl, zr):
        once, like = l[:, None] < r[None, :], zl[:, None] == zr[None, :]
        a, b = d[once & like], d[once & ~like]
        return [np.array([float(x)]) for x in (np.maximum(0, a - pull_margin).sum(), np.maximum(0, push_margin - b).sum(), len(a), len(b))]

    t = reduced(df, key, vec, df, key, vec, schema, sums, [by], label, label).agg(*[F.sum(c).alias(c) for c in fields])
    part = lambda c: F.coalesce(F.col(c) / F.nullif(F.col(f"n_{c}"), F.lit(0.0)), F.lit(0.0))
    return t.select((weight * (part("pull") + part("push"))).alias("loss"))


def cross_type_loss(df: DataFrame, key: str, vec: str, other: DataFrame, okey: str, ovec: str, pairs: DataFrame, temperature: float) -> DataFrame:
    """(loss): cross entropy of each row's partner (pairs: key, okey) among all rows of the other type."""
    x = pairs.join(df.select(key, F.col(vec).cast("array<double>").alias("v")), key).join(other.select(okey, F.col(ovec).cast("array<double>").alias("w")), okey)
    near = x.select(F.col(key).alias("l"), (cosine(F.col("v"), F.col("w")) / temperature).alias("p"))
    return near.join(log_sum_exp(df, key, vec, other, okey, ovec, temperature, False), "l").agg(F.avg(F.col("lse") - F.col("p")).alias("loss"))


def weighted_neighbours(edges: DataFrame, nodes: DataFrame, key: str, vec: str, hot: list | None = None) -> DataFrame:
    """(key, agg): for each ``dst`` the sum of ``w`` times the vector of ``src`` over its in-edges (src, dst, w), place by place.

    Sums are taken map-side, so hubs are no hot spots; vectors go to senders with very many edges by broadcast.
    """
    v = nodes.select(F.col(key).alias("src"), F.col(vec).cast("array<double>").alias("v"))
    each = skew_join(edges.select("src", "dst", "w"), v, "src", hot_keys(edges, "src") if hot is None else hot).select("dst", "w", F.posexplode("v").alias("i", "x"))
    m = each.groupBy("dst", "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return m.groupBy(F.col("dst").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("agg"))


def neighbour_mean(edges: DataFrame, nodes: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, agg): mean vector of the sources, of those that have one, of a node's in-edges."""
    stage = Stage(edges.sparkSession)
    edges, nodes = stage.write(edges.select("src", "dst")), stage.write(nodes.select(key, F.col(vec).cast("array<double>").alias(vec)))
    hot = hot_keys(edges, "src")
    have = stage.write(skew_join(edges, nodes.select(F.col(key).alias("src")), "src", hot))
    size = have.groupBy("dst").agg((1.0 / F.count(F.lit(1))).alias("w"))
    return weighted_neighbours(skew_join(have, size, "dst", hot_keys(have, "dst")), nodes, key, vec, hot)


def two_views(co_edges: DataFrame, incidence: DataFrame, nodes: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, co, both): each node's vector smoothed over the co-edges, and over the groups it is in and back.

    The first view is D^-1/2 (A + I) D^-1/2 x, A having the distinct edges (src, dst) and D its row sums; the second takes
    the mean of the members of each group (``incidence``: src a node, dst a group) and the mean of those over a node's groups.
    Nodes without a group get zeros there.
    """
    nodes = Stage(nodes.sparkSession).write(nodes.select(key, F.col(vec).cast("array<double>").alias(vec)))
    same = nodes.select(F.col(key).alias("src"), F.col(key).alias("dst"))
    a = Stage(nodes.sparkSession).write(co_edges.select("src", "dst").filter("src != dst").unionByName(same).distinct())
    degree = a.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    hot = hot_keys(a, "src")
    a = skew_join(a, degree, "src", hot).join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    # the row sum belongs to the first end: messages run from dst to src
    a = Stage(nodes.sparkSession).write(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (1 / F.sqrt(F.col("d") * F.col("e"))).alias("w")))
    co = weighted_neighbours(a, nodes, key, vec)
    i = incidence.select("src", "dst").distinct()
    groups = neighbour_mean(i, nodes, key, vec).withColumnRenamed(key, "g")
    back = neighbour_mean(i.select(F.col("dst").alias("src"), F.col("src").alias("dst")), groups, "g", "agg")
    out = nodes.join(co.withColumnRenamed("agg", "co"), key, "left").join(back.select(F.col("g").alias(key), F.col("agg").alias("both")), key, "left")
    zero = F.transform(F.col(vec), lambda x: F.lit(0.0))
    return out.select(key, F.coalesce("co", zero).alias("co"), F.coalesce("both", zero).alias("both"))


def dense(v, weights: np.ndarray):
    """Column of v times a matrix of literal weights (in, out)."""
    return F.array(*[F.aggregate(F.zip_with(v, F.array(*[F.lit(float(w)) for w in column]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for column in np.asarray(weights).T])


def relu(v):
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def attend(a, b, q: np.ndarray):
    """(fused, weight of a): both views weighted by the softmax of q . tanh(view)."""
    s = lambda v: F.get(dense(F.transform(v, F.tanh), np.asarray(q)[:, None]), F.lit(0))
    w = 1 / (1 + F.exp(s(b) - s(a)))
    return F.zip_with(a, b, lambda x, y: w * x + (1 - w) * y), w


def gated(raw, agg, project: np.ndarray, by_raw: np.ndarray, by_agg: np.ndarray, bias: np.ndarray):
    """g * project(raw) + (1 - g) * agg with g = sigmoid(by_raw . raw + by_agg . agg + bias), place by place."""
    terms = F.arrays_zip(dense(raw, by_raw).alias("r"), dense(agg, by_agg).alias("a"), F.array(*[F.lit(float(x)) for x in bias]).alias("b"), dense(raw, project).alias("p"), agg.alias("x"))

    def place(t):
        g = 1 / (1 + F.exp(-(t["r"] + t["a"] + t["b"])))
        return g * t["p"] + (1 - g) * t["x"]

    return F.transform(terms, place)
