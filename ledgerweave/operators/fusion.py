"""Fusing pair signals: pseudo-observations, copulas, priors, selection of a model and of clustering parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerweave.plans.ordered import ordinal_rank

#: Parameter grids of the copula families.
GRIDS = {"clayton": (0.2, 0.5, 1.0, 2.0, 5.0), "gumbel": (1.1, 1.5, 2.0, 3.0, 5.0), "frank": (0.5, 1.0, 2.0, 5.0, 9.0)}
EDGE = 1e-6


def pseudo_observations(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Adds u_<c>: ordinal rank over n + 1, ties by key, ranked cell by cell rather than in one task."""
    n = df.count()
    out = df
    for c in columns:
        out = ordinal_rank(out, c, key).withColumn(f"u_{c}", F.least(F.greatest(F.col("rank") / (n + 1), F.lit(EDGE)), F.lit(1 - EDGE))).drop("rank")
    return out


def prior(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.least(F.greatest(F.avg(F.col(label).cast("double")), F.lit(EDGE)), F.lit(1 - EDGE)).alias("prior"))


def copula_density(family: str, u: Column, v: Column, theta: Column) -> Column:
    """Bivariate density in textbook form."""
    if family == "clayton":
        s = F.pow(u, -theta) + F.pow(v, -theta) - 1
        return (1 + theta) * F.pow(u * v, -1 - theta) * F.pow(s, -2 - 1 / theta)
    if family == "gumbel":
        x, y = -F.log(u), -F.log(v)
        s = F.pow(x, theta) + F.pow(y, theta)
        root = F.pow(s, 1 / theta)
        return F.exp(-root) / (u * v) * F.pow(x * y, theta - 1) * F.pow(s, 1 / theta - 2) * (root + theta - 1)
    if family == "frank":
        e = 1 - F.exp(-theta)
        d = e - (1 - F.exp(-theta * u)) * (1 - F.exp(-theta * v))
        return theta * e * F.exp(-theta * (u + v)) / (d * d)
    raise ValueError(family)


def fit_copula(df: DataFrame, family: str, u: str, v: str) -> DataFrame:
    """(theta, loglik) of the grid, best first; equal likelihoods keep the smaller theta.  One pass for the whole grid."""
    grid = F.explode(F.array(*[F.lit(t) for t in GRIDS[family]]))
    x = df.select(F.col(u).alias("u"), F.col(v).alias("v"), grid.alias("theta"))
    ll = x.groupBy("theta").agg(F.sum(F.log(F.greatest(copula_density(family, F.col("u"), F.col("v"), F.col("theta")), F.lit(1e-300)))).alias("loglik"))
    return ll.orderBy(F.desc("loglik"), "theta")


def copula_posterior(match: Column, other: Column, p: float) -> Column:
    return p * match / (p * match + (1 - p) * other)


def select_model(df: DataFrame) -> DataFrame:
    """One row of (name, ap, ece, brier, rank): highest ap, then lowest ece, brier, rank, name."""
    return df.orderBy(F.desc("ap"), "ece", "brier", "rank", "name").limit(1)


def binned_bayes(df: DataFrame, columns: list[str], label: str, laplace: float = 1.0) -> DataFrame:
    """(column, value, log_ratio): smoothed log ratio of a value's share among positives and negatives; columns are binned before."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    x = df.select(F.col(label).alias("y"), pairs.alias("x")).select("y", "x.*").filter("value is not null")
    counts = x.groupBy("column", "value").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    tot = counts.groupBy("column").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"), F.count(F.lit(1)).alias("k"))
    share = lambda a, t: (F.col(a) + laplace) / (F.col(t) + laplace * F.col("k"))
    return counts.join(tot, "column").select("column", "value", F.log(share("pos", "tp") / share("neg", "tn")).alias("log_ratio"))


def pair_counts(df: DataFrame, truth: str, found: str, noise: int = -1) -> DataFrame:
    """(tp, fp, fn) of pairs from the contingency table: sums of n (n - 1) / 2; noise never pairs, a true label -1 is a cluster."""
    c2 = lambda n: n * (n - 1) / 2
    cell = df.groupBy(truth, found).agg(F.count(F.lit(1)).alias("n"))
    both = cell.filter(F.col(found) != noise).agg(F.coalesce(F.sum(c2(F.col("n"))), F.lit(0.0)).alias("tp"))
    called = cell.filter(F.col(found) != noise).groupBy(found).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(c2(F.col("n"))), F.lit(0.0)).alias("called"))
    same = cell.groupBy(truth).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(c2(F.col("n"))), F.lit(0.0)).alias("same"))
    one = both.join(F.broadcast(called)).join(F.broadcast(same))  # single rows
    return one.select(F.col("tp").cast("long").alias("tp"), (F.col("called") - F.col("tp")).cast("long").alias("fp"), (F.col("same") - F.col("tp")).cast("long").alias("fn"))


def cluster_purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(plain, weighted, n_scored, n_pure): share of pure clusters among those with two labelled members or more; (1, 1, 0, 0) if none."""
    g = df.filter(F.col(label).isNotNull()).groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("a"), F.max(label).alias("b")).filter("n >= 2")
    pure = F.col("a") == F.col("b")
    return g.agg(
        F.coalesce(F.avg(pure.cast("double")), F.lit(1.0)).alias("plain"), F.coalesce(F.sum(F.when(pure, F.col("n")).otherwise(0)) / F.sum("n"), F.lit(1.0)).alias("weighted"),
        F.count(F.lit(1)).alias("n_scored"), F.coalesce(F.sum(pure.cast("long")), F.lit(0)).alias("n_pure"),
    )
