"""Two-sample differences, trends, partial correlation and bootstrap intervals, from mergeable sums.

Sums are aggregated in one pass; what the driver solves are systems as large as the number of columns.  Null and NaN values are
left out pairwise.  An empty sample gives null statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerweave.functions.hashes import md5_heads
from ledgerweave.plans.ordered import running_totals


def cohen_d(df: DataFrame, value: str, after: str, by: list[str]) -> DataFrame:
    """(by, cohen_d): difference of means over the pooled deviation (ddof 1); 0 where that is 0."""
    a, b = F.when(F.col(after), F.col(value)), F.when(~F.col(after), F.col(value))
    g = df.groupBy(*by).agg(F.count(a).alias("n1"), F.avg(a).alias("m1"), F.var_samp(a).alias("v1"), F.count(b).alias("n0"), F.avg(b).alias("m0"), F.var_samp(b).alias("v0"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return g.select(*by, F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled).otherwise(0.0).alias("cohen_d"))


def ks_two_sample(df: DataFrame, value: str, after: str, by: list[str]) -> DataFrame:
    """(by, n, m, ks_D, ks_p): largest difference of the distribution functions over grouped distinct values; asymptotic p.

    A group's values are ordered over as many tasks as they need.
    """
    pts = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & F.col(after).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(
        F.sum(F.when(F.col(after), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(after), 0).otherwise(1)).alias("b")
    )
    sizes = pts.groupBy(*by).agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    cum = running_totals(pts, "v", ["a", "b"], by=by).withColumnsRenamed({"cum_a": "ca", "cum_b": "cb"}).join(F.broadcast(sizes), by)  # one row per group
    d = cum.groupBy(*by).agg(F.max(F.abs(F.col("ca") / F.col("n") - F.col("cb") / F.col("m"))).alias("ks_D"), F.first("n").alias("n"), F.first("m").alias("m"))
    return d.withColumn("ks_p", kolmogorov_p(F.col("ks_D"), F.col("n"), F.col("m")))


def kolmogorov_p(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p of the two-sample statistic."""
    x = d * F.sqrt(n * m / (n + m))
    sign = lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + sign(k) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def is_drift(p: Column, d: Column, cohen: Column) -> Column:
    return (p < 0.05) & (d > 0.10) & (F.abs(cohen) > 0.30)


def normal_p(z: float) -> float:
    """Two-sided p of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def _later_signs(v: np.ndarray) -> int:
    """Number of pairs in order minus number of pairs out of order, by a tree of counts: n log n."""
    ranks = np.unique(v, return_inverse=True)[1] + 1
    m = int(ranks.max(initial=0))
    tree = [0] * (m + 1)
    total = 0
    for i, r in enumerate(ranks.tolist()):
        below, upto = 0, 0
        j = r - 1
        while j:
            below += tree[j]
            j &= j - 1
        j = r
        while j:
            upto += tree[j]
            j &= j - 1
        total += below - (i - upto)
        j = r
        while j <= m:
            tree[j] += 1
            j += j & -j
    return total


def mann_kendall(series: DataFrame, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, s, var_s, z): trend statistic with tie correction and continuity correction.

    A series has one row per step and is one task's; pairs are counted, not made.  Series are spread by ``by``.
    """
    by = by or []
    x = series.filter(F.col(value).isNotNull()).select(*by, F.col(order).alias("__o"), F.col(value).cast("double").alias("__v"))
    kind = T.StructType([*[x.schema[b] for b in by], T.StructField("s", T.LongType())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("__o")
        return pa.table([*[t.column(b).slice(0, 1) for b in by], pa.array([_later_signs(t.column("__v").to_numpy())], pa.int64())], names=kind.names)

    s = x.groupBy(*by).applyInArrow(run, kind)
    n = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    ties = x.groupBy(*by, "__v").count().groupBy(*by).agg(F.sum(F.col("count") * (F.col("count") - 1) * (2 * F.col("count") + 5)).alias("ties"))
    j = s.join(n, by).join(ties, by) if by else s.join(F.broadcast(n)).join(F.broadcast(ties))  # one row
    var = (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("ties")) / 18
    z = F.when(F.col("var_s") <= 0, 0.0).when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt("var_s")).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt("var_s")).otherwise(0.0)
    return j.withColumn("var_s", var).withColumn("z", z).select(*by, "n", "s", "var_s", "z")


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, centred cross products) of complete rows: one aggregation of two passes' worth of sums around the means."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    df = df.filter(ok)
    first = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns]).first()
    n, mean = first[0], [float(v or 0) for v in first[1:]]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.sum((F.col(columns[i]) - mean[i]) * (F.col(columns[j]) - mean[j])) for i, j in pairs]).first()
    c = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, row):
        c[i, j] = c[j, i] = v or 0.0
    return n, np.array(mean), c


def partial_correlation(df: DataFrame, x: str, y: str, z: list[str]) -> tuple[float, float, int]:
    """(r, p, n): correlation of x and y given z, with the Fisher-z p; (0, 1) if undefined or without degrees of freedom."""
    n, _, c = moments(df, [x, y, *z])
    k = len(z)
    s = c[:2, :2] - (c[:2, 2:] @ np.linalg.pinv(c[2:, 2:]) @ c[2:, :2] if k else 0)
    d = s[0, 0] * s[1, 1]
    dof = n - 3 - k
    if d <= 0 or dof < 1:
        return 0.0, 1.0, n
    r = float(np.clip(s[0, 1] / math.sqrt(d), -1 + 1e-15, 1 - 1e-15))
    return r, normal_p(math.atanh(r) * math.sqrt(dof)), n


def ols_last(df: DataFrame, y: str, xs: list[str]) -> tuple[float, float, float]:
    """(coefficient, t, p) of the last regressor of y on xs with a constant, homoskedastic errors."""
    n, _, c = moments(df, [y, *xs])
    a = np.linalg.pinv(c[1:, 1:])
    beta = a @ c[1:, 0]
    dof = n - len(xs) - 1
    if dof < 1:
        return 0.0, 0.0, 1.0
    var = max(0.0, float(c[0, 0] - beta @ c[1:, 0])) / dof
    se = math.sqrt(var * a[-1, -1])
    t = float(beta[-1] / se) if se > 0 else 0.0
    return float(beta[-1]), t, normal_p(t)


#: Distribution function of the Poisson law of mean 1.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402)


def poisson_weight(key: Column, replicate: Column) -> Column:
    """Poisson(1) weight of a row in a bootstrap replicate, from a hash of both: the same on every engine and run."""
    u = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("|"), replicate.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.size(F.filter(F.array(*[F.lit(s) for s in POISSON]), lambda s: s <= u))


def poisson_weights(keys: pa.Array, replicates: int) -> np.ndarray:
    """(replicates, keys): ``poisson_weight`` of all keys in the replicates 1 .. ``replicates``; 0 for a null key."""
    heads = md5_heads(keys, [f"|{r}".encode() for r in range(1, replicates + 1)])
    out = np.zeros(heads.shape, np.uint8)
    for s in POISSON:
        out += heads >= np.uint32(math.ceil(s * 2**32))
    if keys.null_count:
        out[:, keys.is_null().to_numpy(zero_copy_only=False)] = 0
    return out


def bootstrap_means(df: DataFrame, key: str, value: str, replicates: int) -> DataFrame:
    """(replicate, mean): weighted mean of each replicate; rows stay where they are, only sums per replicate are shuffled."""
    each = df.filter(F.col(value).isNotNull()).select(key, value, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    w = poisson_weight(F.col(key), F.col("replicate"))
    return each.groupBy("replicate").agg((F.sum(w * F.col(value)) / F.nullif(F.sum(w), F.lit(0))).alias("mean"))


def percentile_interval(replicates: DataFrame, value: str = "mean", level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return replicates.agg(F.expr(f"percentile({value}, {a})").alias("lo"), F.expr(f"percentile({value}, {1 - a})").alias("hi"))


def power_n_min(effect: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Rows needed to find a correlation of that size with that power, by Fisher's z; at least 4."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    r = F.least(F.greatest(F.abs(effect), F.lit(1e-6)), F.lit(0.999999))
    return F.greatest(F.lit(4), F.ceil(F.pow(z / (0.5 * F.log((1 + r) / (1 - r))), 2) + 3)).cast("long")


def power_gate(n: Column, effect: Column, alpha: float = 0.05, power: float = 0.8) -> tuple[Column, Column, Column]:
    """Needed rows, whether ``n`` is enough, and the status in words."""
    need = power_n_min(effect, alpha, power)
    return need, n >= need, F.when(n >= need, "ok").otherwise("insufficient data")


def weighted_moments(df: DataFrame, columns: list[str], key: Column, replicates: int, derived: dict[str, tuple[Column, float]] | None = None) -> dict[int, tuple[float, np.ndarray]]:
    """(n, centred cross products) of complete rows in each bootstrap replicate; replicate 0 is the table itself.

    ``derived`` columns follow ``columns``: an expression that is never null nor NaN, and a number near its mean.  One pass over
    the rows, batch by batch: a batch's weights are hashed together and its sums are a matrix product.  What comes back is as
    large as replicates times squared columns.
    """
    derived = derived or {}
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    df = df.filter(ok)
    mean = [float(v or 0) for v in df.agg(*[F.avg(c) for c in columns]).first()]
    about = [*[(F.col(c), m) for c, m in zip(columns, mean)], *derived.values()]
    x = df.select((key.cast("string") if replicates else F.lit(None).cast("string")).alias("__k"), *[(c - m).cast("double").alias(f"__{i}") for i, (c, m) in enumerate(about)])
    width = len(about)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates + 1, 1 + width + len(pairs)))
        for b in batches:
            v = [b.column(i + 1).to_numpy() for i in range(width)]
            terms = np.stack([np.ones(b.num_rows), *v, *[v[i] * v[j] for i, j in pairs]], axis=1)
            total[0] += terms.sum(axis=0)
            if replicates:
                total[1:] += poisson_weights(b.column(0), replicates).astype(np.float64) @ terms
        if total[0, 0]:
            yield pa.RecordBatch.from_pydict({"r": pa.array(range(replicates + 1), pa.int32()), "s": pa.array(list(total), pa.list_(pa.float64()))})

    parts = x.mapInArrow(run, "r int, s array<double>")
    rows = parts.groupBy("r").agg(*[F.sum(F.get("s", F.lit(i))) for i in range(1 + width + len(pairs))]).collect()
    out = {}
    for r in rows:
        n, s = float(r[1]), np.array([float(v) for v in r[2 : 2 + width]])
        c = np.zeros((width, width))
        for (i, j), v in zip(pairs, r[2 + width :]):
            c[i, j] = c[j, i] = v
        out[r[0]] = (n, c - np.outer(s, s) / max(n, 1.0))
    return out


def _partial(n: float, c: np.ndarray, x: int, y: int, z: list[int]) -> tuple[float, float]:
    """(r, p) of the partial correlation of places x and y given places z."""
    own = [x, y]
    s = c[np.ix_(own, own)] - (c[np.ix_(own, z)] @ np.linalg.pinv(c[np.ix_(z, z)]) @ c[np.ix_(z, own)] if z else 0)
    d, dof = s[0, 0] * s[1, 1], n - 3 - len(z)
    if d <= 0 or dof < 1:
        return 0.0, 1.0
    r = float(np.clip(s[0, 1] / math.sqrt(d), -1 + 1e-15, 1 - 1e-15))
    return r, normal_p(math.atanh(r) * math.sqrt(dof))


def evaluate_candidates(df: DataFrame, y: str, anchors: list[str], pool: list[str], candidates: dict[str, list[str]], key: Column, alpha: float = 0.05, replicates: int = 100) -> DataFrame:
    """(name, edge, kind, r, p, p_low, p_high, rejected): tests of what each candidate set of confounders implies.

    An edge from an anchor to ``y`` should be there given the confounders: it is rejected unless p and its whole bootstrap
    interval lie below ``alpha``.  A variable of the pool outside the set, and a placebo made from the key, should add nothing to
    a regression of ``y`` on the confounders: they are rejected if they do.  One pass over the rows serves all candidates.
    """
    from ledgerweave.operators.matrix import hashed_unit

    columns = [y, *anchors, *pool, "__placebo"]
    at = {c: i for i, c in enumerate(columns)}
    m = weighted_moments(df, columns[:-1], key, replicates, {"__placebo": (hashed_unit(F.abs(F.xxhash64(key) % 1_000_003), F.lit(1), 72), 0.5)})
    out = []
    for name, confounders in candidates.items():
        z = [at[c] for c in confounders]
        tests = [(a, "present") for a in anchors] + [(v, "absent") for v in pool if v not in confounders] + [("__placebo", "placebo")]
        for c, kind in tests:
            each = {k: _partial(n, s, at[c], 0, z) for k, (n, s) in m.items()}
            r, p = each[0]
            low, high = (float(v) for v in np.quantile([each[k][1] for k in each if k] or [p], [0.025, 0.975]))
            n = m[0][0]
            dof = n - len(z) - 2
            t = r * math.sqrt(max(dof, 0) / max(1e-300, 1 - r * r))
            rejected = not (p < alpha and high < alpha) if kind == "present" else dof >= 1 and normal_p(t) < alpha
            out.append((name, c.strip("_"), kind, r, p, low, high, bool(rejected), len(confounders) + len(anchors)))
    return df.sparkSession.createDataFrame(out, "name string, edge string, kind string, r double, p double, p_low double, p_high double, rejected boolean, num_edges int")
