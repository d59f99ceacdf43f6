"""Consolidating pairwise matches into groups by hash-to-min.

Every vertex v holds a cluster set, first itself and its neighbours.  In each round v sends its set to the smallest member m
and m to every member; the sets received are united.  Sets are rows (v, u), never arrays, so a set of any size is spread over
the cluster.  At the end the smallest vertex of a group holds the group and every other vertex holds that smallest one alone.

Defined results: pairs with a null end tie nothing; a pair of equal ends names a vertex; repeated and reversed pairs count
once; an empty table has no groups.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerweave.plans.skew import HOT, skew_join
from ledgerweave.plans.staging import Stage

MAX_ROUNDS = 200


def _state(rows: DataFrame) -> tuple:
    """Row count and an order-free fingerprint of (v, u)."""
    return tuple(rows.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(v, u))"), F.expr("bit_xor(hash(u, v))")).first())


def hash_to_min(pairs: DataFrame, left: str, right: str, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(v, group_id): every vertex of a pair with both ends, group_id the smallest vertex of its group."""
    stage = Stage(pairs.sparkSession)
    ends = pairs.select(F.col(left).alias("v"), F.col(right).alias("u")).filter("v is not null and u is not null")
    both = F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")), F.struct("v", F.col("v").alias("u")), F.struct(F.col("u").alias("v"), "u"))
    rows = stage.write(ends.select(F.inline(both)).distinct())
    state = _state(rows)
    for _ in range(max_rounds):
        sizes = stage.write(rows.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("k")))
        # at most 1 / HOT sets hold that share of all rows; their minima are broadcast, so no task gets a whole giant set
        hot = [r[0] for r in sizes.filter(F.col("k") >= max(1000.0, HOT * state[0])).select("v").collect()]
        # a set that is just {m} gives the row (m, m) twice, which is left out before the shuffle: a settled vertex other than the smallest costs nothing
        sent = skew_join(rows, sizes.select("v", "m"), "v", hot)
        sent = sent.select(F.inline(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))))
        new = stage.write(sent.distinct())
        before, state = state, _state(new)
        stage.drop(sizes, rows)
        rows = new
        if state == before:
            break
    else:
        raise RuntimeError(f"hash-to-min did not settle in {max_rounds} rounds")
    return rows.groupBy("v").agg(F.min("u").alias("group_id"))
