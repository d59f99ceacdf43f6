"""Point-process features of counts per step: dense steps, burstiness, Hawkes intensity, time since the last event.

A series has one row per step; its length is the number of steps, not of rows, so windows over it are small.  Rows with a null
step belong to no step.  An empty table gives a dense series of zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W


def dense_counts(df: DataFrame, step: str, first: int, last: int, flag: str | None = None) -> DataFrame:
    """(t, n[, flagged]): rows per step of first..last; other steps are left out."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(F.when(F.col(flag), 1).otherwise(0)).alias("flagged")] if flag else [])
    counts = df.filter(F.col(step).between(first, last)).groupBy(F.col(step).cast("int").alias("t")).agg(*aggs)
    spine = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("t"))
    return spine.join(F.broadcast(counts), "t", "left").fillna(0)


def burstiness(series: DataFrame, width: int = 3) -> DataFrame:
    """Adds (s - m) / (s + m) of the counts of steps t - width + 1 .. t, population deviation; 0 where undefined."""
    w = W.orderBy("t").rangeBetween(-(width - 1), 0)
    m, s = F.avg("n").over(w), F.stddev_pop("n").over(w)
    return series.withColumn("burstiness", F.when(s + m > 0, (s - m) / (s + m)).otherwise(0.0))


#: Largest exponent within a block of steps: its exponential is a finite double.
BLOCK = 600.0


def hawkes(series: DataFrame, alpha: float = 0.5, beta: float = 1.0, trailing_mean: bool = False) -> DataFrame:
    """Adds mu + alpha * sum over k < t of exp(-beta (t - k)) n_k; mu the mean of all steps, or of those before t.

    The sum over pairs of steps is a running sum of exp(beta k) n_k.  It is taken in blocks of steps, exponents relative to the
    block, so that it cannot overflow; what came before the block before is lighter than exp(-600) and adds nothing to a double.
    """
    before = W.orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    mu = F.coalesce(F.avg("n").over(before), F.lit(0.0)) if trailing_mean else F.avg("n").over(W.partitionBy())
    at = beta * (F.col("t") - F.min("t").over(W.partitionBy()))
    x = series.withColumn("__mu", mu).withColumn("__b", F.floor(at / BLOCK)).withColumn("__x", at - BLOCK * F.col("__b"))
    weight = F.exp("__x") * F.col("n")
    last = x.groupBy((F.col("__b") + 1).alias("__b")).agg(F.sum(weight).alias("__last"))
    here = F.coalesce(F.sum(weight).over(W.partitionBy("__b").orderBy("t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    x = x.withColumn("__here", here).join(last, "__b", "left")
    total = F.exp(-F.col("__x")) * F.col("__here") + F.exp(-BLOCK - F.col("__x")) * F.coalesce("__last", F.lit(0.0))
    return x.select(*series.columns, (F.col("__mu") + alpha * total).alias("hawkes"))


def since_last(series: DataFrame, flagged: str = "flagged", never: int = 49, lag: int = 0) -> DataFrame:
    """Adds steps since the last step with a flagged row (0 on it), ``never`` before the first; lag 1 leaves out the step itself."""
    w = W.orderBy("t").rowsBetween(W.unboundedPreceding, -lag)
    last = F.last(F.when(F.col(flagged) > 0, F.col("t")), ignorenulls=True).over(w)
    return series.withColumn("since_last", F.coalesce(F.col("t") - last, F.lit(never)))


def temporal_features(df: DataFrame, step: str, flag: str, first: int = 1, last: int = 49) -> DataFrame:
    """``df`` with the four features of its step; rows without a step get 0, the mean intensity, 0 and ``never``."""
    s = since_last(hawkes(burstiness(dense_counts(df, step, first, last, flag))))
    s = s.withColumn("__mean", F.avg("hawkes").over(W.partitionBy()))
    mean = s.agg(F.avg("hawkes").alias("__mean"))
    out = df.join(F.broadcast(s.drop("__mean", "flagged").withColumnRenamed("t", "__t").withColumnRenamed("n", "step_count")), F.col(step) == F.col("__t"), "left")
    out = out.join(F.broadcast(mean))
    return out.withColumn("hawkes", F.coalesce("hawkes", "__mean")).fillna({"step_count": 0, "burstiness": 0.0, "since_last": 49}).drop("__t", "__mean")
