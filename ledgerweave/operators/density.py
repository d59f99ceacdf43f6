"""Density clustering of vectors on top of the radius join."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ledgerweave.operators.graphs import components
from ledgerweave.operators.vectors import nearest, reduced, within
from ledgerweave.plans.ordered import quantiles, running_totals
from ledgerweave.plans.staging import Stage


def dbscan(df: DataFrame, key: str, vec: str, eps: float, min_pts: int) -> DataFrame:
    """(key, cluster): core points (``min_pts`` within ``eps``, itself included) are joined; border points take the smallest cluster next to them; noise -1.

    Clusters are named by their smallest core key.
    """
    stage = Stage(df.sparkSession)
    near = stage.write(within(df, key, vec, df, key, vec, eps).select("l", "r"))
    core = stage.write(near.groupBy("l").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pts).select("l"))
    inner = near.join(core, "l").join(core.withColumnRenamed("l", "r"), "r").select(F.col("l").alias("src"), F.col("r").alias("dst"))
    comp = components(inner, core.select(F.col("l").alias("node")))
    reach = near.join(comp.select(F.col("node").alias("r"), F.col("component").alias("c")), "r").groupBy("l").agg(F.min("c").alias("border"))
    named = df.select(F.col(key).alias("l")).join(comp.select(F.col("node").alias("l"), "component"), "l", "left").join(reach, "l", "left")
    return named.select(F.col("l").alias(key), F.coalesce("component", "border", F.lit(-1)).cast("long").alias("cluster"))


#: Numbers of points and quantiles of the k-distance that parameters are chosen from.
MIN_PTS, QUANTILES = (3, 5, 10, 20, 30, 40, 50), (0.80, 0.85, 0.90, 0.95, 0.98)


def choose_parameters(df: DataFrame, key: str, vec: str, label: str, c_fp: float, c_fn: float, min_pts: tuple[int, ...] = MIN_PTS, qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(setting, min_pts, q, eps, tp, fp, fn, cost, n_clusters, noise, chosen): pair costs of density clustering on a grid.

    The least cost is chosen, of equal ones the first.  All settings are clustered at once: neighbours within the largest
    radius are found once, and a node of the one graph is a pair of setting and row.  ``key`` is LONG and not negative.
    """
    stage, spark = Stage(df.sparkSession), df.sparkSession
    rows = stage.write(df.select(F.col(key).alias("k"), F.col(vec).alias("v"), F.col(label).cast("long").alias("y")).filter("k is not null and v is not null"))
    n = rows.count()
    sizes = [m for m in min_pts if m <= n // 2] or [min(3, max(1, n // 2))]
    far = stage.write(nearest(rows, "k", "v", rows, "k", "v", max(sizes)).filter(F.col("rank").isin(sizes)).select("rank", "dist"))
    settings = []
    for m in sizes:
        for q, eps in zip(qs, quantiles(far.filter(F.col("rank") == m), "dist", list(qs), discrete=True)):
            settings.append((len(settings), m, q, eps))
    known = spark.createDataFrame(settings, "setting int, min_pts int, q double, eps double")  # one row a setting
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("setting"), F.lit(m).alias("min_pts"), F.lit(float(e)).alias("eps")) for s, m, _, e in settings]))
    near = within(rows, "k", "v", rows, "k", "v", max(e for *_, e in settings)).withColumn("s", each).filter(F.col("dist") <= F.col("s.eps"))
    node = lambda c: F.col(c) * len(settings) + F.col("s.setting")
    near = stage.write(near.select(node("l").alias("l"), node("r").alias("r"), F.col("s.min_pts").alias("min_pts")))
    core = stage.write(near.groupBy("l", "min_pts").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.col("min_pts")).select("l"))
    near = near.select("l", "r")
    inner = near.join(core, "l").join(core.withColumnRenamed("l", "r"), "r").select(F.col("l").alias("src"), F.col("r").alias("dst"))
    comp = stage.write(components(stage.write(inner), core.select(F.col("l").alias("node"))))
    border = near.join(comp.select(F.col("node").alias("r"), F.col("component").alias("b")), "r").groupBy("l").agg(F.min("b").alias("b"))
    every = rows.select((F.col("k") * len(settings)).alias("k"), "y").withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1))))
    every = every.select((F.col("k") + F.col("setting")).alias("l"), "setting", "y")
    c = every.join(comp.select(F.col("node").alias("l"), "component"), "l", "left").join(border, "l", "left").select("setting", "y", F.coalesce("component", "b", F.lit(-1)).alias("c"))
    c2 = lambda x: (x * (x - 1) / 2).cast("long")
    cell = stage.write(c.groupBy("setting", "y", "c").agg(F.count(F.lit(1)).alias("n")))
    found = cell.filter("c != -1")
    tp = found.groupBy("setting").agg(F.sum(c2(F.col("n"))).alias("tp"))
    called = found.groupBy("setting", "c").agg(F.sum("n").alias("n")).groupBy("setting").agg(F.sum(c2(F.col("n"))).alias("called"), F.count(F.lit(1)).alias("n_clusters"))
    same = cell.groupBy("setting", "y").agg(F.sum("n").alias("n")).groupBy("setting").agg(F.sum(c2(F.col("n"))).alias("same"))
    noise = cell.groupBy("setting").agg((F.sum(F.when(F.col("c") == -1, F.col("n")).otherwise(0)) / F.sum("n")).alias("noise"))
    x = known.join(same, "setting").join(noise, "setting").join(tp, "setting", "left").join(called, "setting", "left").fillna(0, ["tp", "called", "n_clusters"])
    fp, fn = F.col("called") - F.col("tp"), F.col("same") - F.col("tp")
    x = x.select("setting", "min_pts", "q", "eps", "tp", fp.alias("fp"), fn.alias("fn"), (c_fp * fp + c_fn * fn).alias("cost"), "n_clusters", "noise")
    best = x.agg(F.min_by("setting", F.struct("cost", "setting")).alias("best"))
    return x.join(F.broadcast(best)).withColumn("chosen", F.col("setting") == F.col("best")).drop("best")


def k_distance(df: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """(key, dist): distance to the k-th nearest point, itself counting as the first."""
    return nearest(df, key, vec, df, key, vec, k).filter(F.col("rank") == k).select(F.col("l").alias(key), "dist")


def select_eps(df: DataFrame, key: str, vec: str, k: int, q: float) -> DataFrame:
    """(eps): order statistic ceil(q n) of the k-distances."""
    eps = quantiles(k_distance(df, key, vec, k), "dist", [q], discrete=True)[0]
    return df.sparkSession.createDataFrame([(eps,)], "eps double")


def split_large(df: DataFrame, clusters: DataFrame, key: str, vec: str, max_size: int, seed: int = 42) -> DataFrame:
    """(key, cluster, part): members of clusters above ``max_size`` cut by k-means into ceil(size / max_size) parts, one task a cluster."""
    sizes = clusters.filter("cluster >= 0").groupBy("cluster").count()
    x = df.select(key, F.col(vec).cast("array<double>").alias("v")).join(clusters, key)
    big = x.join(sizes.filter(F.col("count") > max_size), "cluster")
    schema = T.StructType([df.schema[key], T.StructField("cluster", T.LongType()), T.StructField("part", T.IntegerType())])

    def run(pdf):
        pdf = pdf.sort_values(key)
        v = np.stack(pdf["v"].to_numpy())
        k = math.ceil(len(v) / max_size)
        rng = np.random.default_rng(seed)
        c = v[rng.choice(len(v), k, replace=False)]
        for _ in range(25):
            at = ((v[:, None] - c[None]) ** 2).sum(2).argmin(1) if len(v) * k < 5_000_000 else np.array([((c - y) ** 2).sum(1).argmin() for y in v])
            c = np.array([v[at == i].mean(0) if (at == i).any() else c[i] for i in range(k)])
        return pdf.assign(part=at.astype("int32"))[[key, "cluster", "part"]]

    small = x.join(sizes.filter(F.col("count") > max_size), "cluster", "left_anti").select(key, "cluster", F.lit(0).alias("part"))
    return small.unionByName(big.select(key, "cluster", "v").groupBy("cluster").applyInPandas(run, schema))


def silhouette(df: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """(silhouette): mean of (b - a) / max(a, b) from exact mean distances to the own and the nearest other cluster; 0 with one cluster.

    A block gives, for each of its rows and each cluster it holds, the sum of the distances: no pair is a row.
    """
    schema = T.StructType([df.schema[key], T.StructField("own", T.LongType()), T.StructField("c", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])

    def sums(d, l, r, zl, zr):
        order = np.argsort(zr, kind="stable")
        names, start, size = np.unique(zr[order], return_index=True, return_counts=True)
        total = np.add.reduceat(d[:, order], start, axis=1)
        k = len(names)
        me = np.isin(l, r)  # a row is no neighbour of its own
        n = size[None, :] - (me[:, None] & (zl[:, None] == names[None, :]))
        return np.repeat(l, k), np.repeat(zl, k), np.tile(names, len(l)), total.ravel(), n.ravel()

    lab = df.filter(F.col(label).isNotNull()).withColumn("__label", F.col(label).cast("long"))
    d = reduced(lab, key, vec, lab, key, vec, schema, sums, llabel="__label", rlabel="__label").groupBy(key, "own", "c").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    per = d.groupBy(key).agg(F.min(F.when(F.col("c") == F.col("own"), F.col("m"))).alias("a"), F.min(F.when(F.col("c") != F.col("own"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("silhouette"))


#: Cells of the map x / (1 + x) of distances.
DISTANCE_CELLS = 1 << 16


def _cell(d: np.ndarray) -> np.ndarray:
    return np.floor(d / (1 + d) * DISTANCE_CELLS).astype(np.int64)


def median_distances(df: DataFrame, key: str, vec: str, group: str, anchors: DataFrame, akey: str, avec: str) -> DataFrame:
    """(group, median): exact median distance of the rows of each group to all anchors.

    The first pass counts distances by group and cell; the second gives the distances in the cells that hold the middle, and
    how many lie below them.  So few distances become rows, and no pair does.
    """
    stage = Stage(df.sparkSession)
    kind = lambda name, t: T.StructField(name, t)

    def counts(d, l, r, zl, zr):
        codes = zl.astype(np.int64)[:, None] * DISTANCE_CELLS + _cell(d)
        u, n = np.unique(codes.ravel(), return_counts=True)
        return u // DISTANCE_CELLS, u % DISTANCE_CELLS, n

    rows = df.filter(F.col(group).isNotNull()).withColumn("__g", F.col(group).cast("long"))
    schema = T.StructType([kind("g", T.LongType()), kind("cell", T.LongType()), kind("n", T.LongType())])
    hist = stage.write(reduced(rows, key, vec, anchors, akey, avec, schema, counts, llabel="__g").groupBy("g", "cell").agg(F.sum("n").alias("n")))
    w = W.partitionBy("g").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    cum = hist.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(W.partitionBy("g")))
    # the middle one or two, and a cell more on either side
    mid = cum.groupBy("g").agg((F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("cell"))) - 1).alias("lo"), (F.min(F.when(F.col("upto") * 2 >= F.col("all") + 2, F.col("cell"))) + 1).alias("hi"), F.first("all").alias("all"), F.max("cell").alias("top"))
    bounds = {r["g"]: (r["lo"], r["top"] if r["hi"] is None else r["hi"]) for r in mid.collect()}  # one row a group

    def middle(d, l, r, zl, zr):
        g, c = zl.astype(np.int64), _cell(d)
        lo, hi = (np.array([bounds[x][i] for x in g.tolist()])[:, None] for i in (0, 1))
        at, _ = np.nonzero((c >= lo) & (c <= hi))
        inside = d[(c >= lo) & (c <= hi)]
        below = (c < lo).sum(axis=1)
        names, which = np.unique(g, return_inverse=True)
        return np.concatenate([g[at], names]), np.concatenate([inside, np.full(len(names), -1.0)]), np.concatenate([np.ones(len(at), np.int64), np.bincount(which, weights=below).astype(np.int64)])

    schema = T.StructType([kind("g", T.LongType()), kind("d", T.DoubleType()), kind("n", T.LongType())])
    x = stage.write(reduced(rows, key, vec, anchors, akey, avec, schema, middle, llabel="__g").groupBy("g", "d").agg(F.sum("n").alias("n")))
    order = running_totals(x, "d", ["n"], by=["g"]).join(F.broadcast(mid.select("g", "all")), "g")  # one row a group
    at = lambda k: F.min(F.when((F.col("d") >= 0) & (F.col("cum_n") >= k), F.col("d")))
    both = order.groupBy("g").agg(at(F.floor((F.col("all") + 1) / 2)).alias("a"), at(F.floor(F.col("all") / 2) + 1).alias("b"))
    return both.select(F.col("g").cast(df.schema[group].dataType).alias(group), ((F.col("a") + F.col("b")) / 2).alias("median"))
