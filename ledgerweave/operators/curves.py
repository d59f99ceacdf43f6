"""Threshold sweeps and ranking metrics of scored, labelled rows.

All of them start from one row per distinct score (count and positives), so ties are whole steps and what follows is as large
as the number of distinct scores.  Labels are 0 and 1.  Rows with a null score or label are left out; an empty table gives no
steps, and metrics of it are null or 0 as said at each function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql import Window as W

from ledgerweave.operators.stats import poisson_weight, poisson_weights
from ledgerweave.plans.ordered import running_totals


def score_steps(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """(by, score, n, pos, cum_n, cum_pos): running totals from the highest score down, ties together."""
    by = by or []
    steps = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    return running_totals(steps, "score", ["n", "pos"], descending=True, by=by)


def _totals(steps: DataFrame, by: list[str]) -> DataFrame:
    return steps.groupBy(*by).agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))


def _with_totals(steps: DataFrame, by: list[str]) -> DataFrame:
    totals = _totals(steps, by)
    return steps.join(totals, by) if by else steps.join(F.broadcast(totals))  # one row


def cost_curve(steps: DataFrame, c_fp: float, c_fn: float, by: list[str] | None = None) -> DataFrame:
    """(by, tau, alerts, cost): cost of calling every score at or above tau positive."""
    x = _with_totals(steps, by or [])
    cost = c_fp * (F.col("cum_n") - F.col("cum_pos")) + c_fn * (F.col("all_pos") - F.col("cum_pos"))
    return x.select(*(by or []), F.col("score").alias("tau"), F.col("cum_n").alias("alerts"), cost.alias("cost"))


def best_threshold(curve: DataFrame, budget: int | None = None) -> DataFrame:
    """(tau, alerts, cost, feasible): least cost within the budget, then fewer alerts; if nothing fits, the highest tau, not feasible."""
    fits = F.lit(True) if budget is None else F.col("alerts") <= budget
    order = F.struct((~fits).alias("a"), F.when(fits, F.col("cost")).alias("b"), F.when(fits, F.col("alerts")).alias("c"), (-F.col("tau")).alias("d"))
    return curve.agg(F.min_by(F.struct("tau", "alerts", "cost", fits.alias("feasible")), order).alias("x")).select("x.*").filter("tau is not null")


def average_precision(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, ap): sum of recall gains times precision over distinct scores; 0 where only one class occurs."""
    x = _with_totals(steps, by or [])
    gain = F.when((F.col("all_pos") > 0) & (F.col("all_pos") < F.col("all_n")), F.col("pos") / F.col("all_pos") * F.col("cum_pos") / F.col("cum_n")).otherwise(0.0)
    return x.groupBy(*(by or [])).agg(F.sum(gain).alias("ap"))


def roc_auc(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, auc): share of positive-negative pairs in order, ties half; null where only one class occurs."""
    x = _with_totals(steps, by or [])
    neg = F.col("n") - F.col("pos")
    below = (F.col("all_n") - F.col("all_pos")) - (F.col("cum_n") - F.col("cum_pos"))
    won = F.sum(F.col("pos").cast("double") * (below + 0.5 * neg))
    return x.groupBy(*(by or [])).agg((won / F.nullif(F.first("all_pos") * (F.first("all_n") - F.first("all_pos")), F.lit(0))).alias("auc"))


def fbeta_grid(df: DataFrame, score: str, label: str, beta: float, steps: int = 99) -> DataFrame:
    """(tau, precision, recall, fbeta) on the grid k / (steps + 1); rows are reduced to grid cells before the sweep."""
    k = F.floor(F.col(score) * (steps + 1)).cast("int")
    # a score equal to a grid value counts at it, whatever rounding did
    at = F.when((k + 1) / (steps + 1) <= F.col(score), k + 1).when(k / (steps + 1) > F.col(score), k - 1).otherwise(k)
    cells = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(steps)).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    grid = df.sparkSession.range(0, steps + 1).select(F.col("id").cast("int").alias("k")).join(F.broadcast(cells), "k", "left").fillna(0)
    w = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)  # over the grid only
    total = W.partitionBy()
    tp, called, allp = F.sum("pos").over(w), F.sum("n").over(w), F.sum("pos").over(total)
    p, r = F.when(called > 0, tp / called).otherwise(0.0), F.when(allp > 0, tp / allp).otherwise(0.0)
    x = grid.select("k", p.alias("precision"), r.alias("recall")).filter("k >= 1")
    b2 = beta * beta
    d = b2 * F.col("precision") + F.col("recall")
    return x.select((F.col("k") / (steps + 1)).alias("tau"), "precision", "recall", F.when(d > 0, (1 + b2) * F.col("precision") * F.col("recall") / d).otherwise(0.0).alias("fbeta"))


def calibration_bin(p: Column, bins: int) -> Column:
    """Number of the bin (lo, hi] from 1, the first closed, by comparing with the edges themselves."""
    return F.greatest(F.lit(1), F.size(F.filter(F.array(*[F.lit(i / bins) for i in range(bins)]), lambda e: e < p)))


def reliability(df: DataFrame, p: str, label: str, bins: int) -> DataFrame:
    """(bin, n, mean_p, rate): every bin of the unit interval; the means of an empty bin are null."""
    got = df.filter(F.col(p).isNotNull() & F.col(label).isNotNull()).groupBy(calibration_bin(F.col(p), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("rate"))
    spine = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(F.broadcast(got), "bin", "left").fillna(0, ["n"])


def ece(rel: DataFrame) -> DataFrame:
    """(ece): mean gap between confidence and rate, weighted by bin size; 0 for an empty table."""
    return rel.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("ece"))


def precision_at(df: DataFrame, score: str, label: str, key: str, ks: list[int]) -> DataFrame:
    """(k, hits, precision): among the k highest scores, ties by key, k not above the number of rows."""
    top = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).orderBy(F.desc(score), key).limit(max(ks))
    ranked = top.withColumn("r", F.row_number().over(W.orderBy(F.desc(score), key)))  # over at most max(ks) rows
    each = ranked.select("r", F.col(label).cast("long").alias("y"), F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).filter("r <= k")
    return each.groupBy("k").agg(F.sum("y").alias("hits"), (F.sum("y") / F.count(F.lit(1))).alias("precision"))


def precision_interval(df: DataFrame, score: str, label: str, key: str, k: int, replicates: int, level: float = 0.95) -> DataFrame:
    """(k, lo, hi): percentile interval of the precision among the k highest scores, over Poisson bootstrap replicates.

    A replicate's k highest lie among the highest rows of the table; twice k and 200 more are weighted, and it is an error,
    of a chance below 1e-20, if they should not fill a replicate.
    """
    top = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).orderBy(F.desc(score), key).limit(2 * k + 200)
    top = top.select(F.col(score).alias("s"), F.col(label).cast("long").alias("y"), F.col(key).cast("string").alias("k"), F.row_number().over(W.orderBy(F.desc(score), key)).alias("r"))  # over the limit's rows
    each = top.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    each = each.withColumn("w", poisson_weight(F.col("k"), F.col("replicate")))
    w = W.partitionBy("replicate").orderBy("r").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("before", F.sum("w").over(w) - F.col("w"))
    taken = F.greatest(F.lit(0), F.least(F.col("w"), k - F.col("before")))
    reps = each.groupBy("replicate").agg(F.sum(taken).alias("n"), F.sum(taken * F.col("y")).alias("hits"), F.count(F.lit(1)).alias("rows"))
    enough = (F.col("n") == k) | (F.col("rows") < 2 * k + 200)
    share = F.when(enough, F.col("hits") / F.nullif(F.col("n"), F.lit(0))).otherwise(F.raise_error(F.lit("a replicate was not filled")))
    a = (1 - level) / 2
    return reps.select(share.alias("p")).agg(F.expr(f"percentile(p, {a})").alias("lo"), F.expr(f"percentile(p, {1 - a})").alias("hi")).select(F.lit(k).alias("k"), "lo", "hi")


def rate_gap_interval(df: DataFrame, label: str, predicted: str, group: str, key: Column, replicates: int, level: float = 0.95) -> DataFrame:
    """(tpr_lo, tpr_hi, fpr_lo, fpr_hi): percentile intervals of the largest gaps between groups, over Poisson bootstrap replicates.

    A batch's weights are hashed together and summed by group and kind of row, so only such sums are shuffled.
    """
    flag = lambda c: F.coalesce((F.col(c) == 1).cast("int"), F.lit(2))  # noqa: E731 - 2: not known
    x = df.select(F.col(group).alias("g"), (flag(label) * 3 + flag(predicted)).alias("c"), key.cast("string").alias("k"))
    schema = T.StructType([x.schema["g"], T.StructField("c", T.IntegerType()), T.StructField("replicate", T.IntegerType()), T.StructField("w", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = b.column(0).dictionary_encode()
            n = len(g.dictionary)
            kinds, at = np.unique(g.indices.fill_null(n).to_numpy(zero_copy_only=False).astype(np.int64) * 9 + b.column(1).to_numpy(), return_inverse=True)
            sums = np.stack([np.bincount(at, w, len(kinds)) for w in poisson_weights(b.column(2), replicates)]).astype(np.int64)
            own = np.tile(kinds, replicates)
            groups = g.dictionary.take(pa.array(own // 9, mask=own // 9 == n))
            yield pa.RecordBatch.from_arrays([groups, pa.array(own % 9, pa.int32()), pa.array(np.repeat(np.arange(1, replicates + 1), len(kinds)), pa.int32()), pa.array(sums.ravel())], names=schema.names)

    x = x.mapInArrow(run, schema)
    y, p = F.floor(F.col("c") / 3), F.col("c") % 3
    share = lambda k: F.sum(F.when((y == k) & (p == 1), F.col("w")).otherwise(0)) / F.nullif(F.sum(F.when(y == k, F.col("w")).otherwise(0)), F.lit(0))
    rates = x.groupBy("replicate", "g").agg(share(1).alias("tpr"), share(0).alias("fpr"))
    gaps = rates.groupBy("replicate").agg(*[F.coalesce(F.max(c) - F.min(c), F.lit(0.0)).alias(c) for c in ("tpr", "fpr")])
    a = (1 - level) / 2
    return gaps.agg(*[F.expr(f"percentile({c}, {q})").alias(f"{c}_{n}") for c in ("tpr", "fpr") for n, q in (("lo", a), ("hi", 1 - a))])


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0: reports per alert, cost per alert."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def group_rates(df: DataFrame, label: str, predicted: str, group: str) -> DataFrame:
    """(group, tpr, fpr, and their gaps over all groups); a rate without cases is null and does not count for the gap."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    share = lambda cond, of: F.sum(F.when(cond & of, 1).otherwise(0)) / F.nullif(F.sum(F.when(of, 1).otherwise(0)), F.lit(0))
    rates = df.groupBy(F.col(group).alias("group")).agg(share(p, y).alias("tpr"), share(p, ~y).alias("fpr"))
    w = W.partitionBy()  # one row per group
    return rates.select("group", "tpr", "fpr", *[(F.max(c).over(w) - F.min(c).over(w)).alias(f"{c}_gap") for c in ("tpr", "fpr")])
