"""Running totals, ranks and quantiles over a total order, without one task for the whole order.

Rows are range-partitioned by (group, value) and each partition, a cell, keeps its number: a group that holds most of the rows
spans as many cells as it needs.  Cells' totals are the only thing that is put in order by itself, cell by cell and group by group.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ledgerweave.plans.staging import Stage

#: Rows of a cell, and the most cells an order is cut into.
CELL_ROWS, MOST = 500_000, 65_536


def _cut(df: DataFrame, order: list, cells: int | None) -> DataFrame:
    """Staged ``df`` with ``__cell``: the number of the range its row falls into; rows that are equal in the order share one."""
    stage = Stage(df.sparkSession)
    df = stage.write(df)
    n = cells or min(MOST, max(1, -(-df.count() // CELL_ROWS)))
    out = stage.write(df.repartitionByRange(n, *order).withColumn("__cell", F.spark_partition_id()))
    stage.drop(df)
    return out


def running_totals(df: DataFrame, x: str, sums: list[str], descending: bool = False, cells: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds ``cum_<c>`` for each of ``sums``: total of all rows (of the group ``by``) at or before the row in the order of ``x``.

    ``x`` is distinct (within a group).
    """
    by = by or []
    key = F.desc(x) if descending else F.asc(x)
    cut = _cut(df, [*by, key], cells)
    totals = cut.groupBy(*by, "__cell").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    before = W.partitionBy(*by).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)  # over the cells' totals
    offsets = totals.select(*by, "__cell", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums])
    w = W.partitionBy("__cell", *by).orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    out = cut.withColumns({f"cum_{c}": F.sum(c).over(w) for c in sums}).alias("l").join(offsets.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ["__cell", *by]])
    return out.select(*[F.col(f"l.{c}") for c in df.columns], *[(F.col(f"__o_{c}") + F.col(f"l.cum_{c}")).alias(f"cum_{c}") for c in sums])


def ordinal_rank(df: DataFrame, x: str, tie: str, cells: int | None = None) -> DataFrame:
    """Adds ``rank``: ordinal rank by (x, tie) over all rows, from 1."""
    cut = _cut(df, [F.col(x), F.col(tie)], cells)
    counts = cut.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__cell", F.coalesce(F.sum("__n").over(W.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    w = W.partitionBy("__cell").orderBy(x, tie)
    return cut.withColumn("__r", F.row_number().over(w)).join(F.broadcast(offsets), "__cell").select(*df.columns, (F.col("__o") + F.col("__r")).alias("rank"))


def order_statistics(df: DataFrame, x: str, ranks: list[int], by: list[str] | None = None, cells: int | None = None) -> DataFrame:
    """(by, rank, value): the values at the given ranks, from 1, among the non-null values of ``x`` (of each group ``by``)."""
    by = by or []
    counts = df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    cum = running_totals(counts, "__v", ["__n"], cells=cells, by=by)
    hit = cum.withColumn("rank", F.explode(F.filter(F.array(*[F.lit(r) for r in ranks]), lambda r: (r <= F.col("cum___n")) & (r > F.col("cum___n") - F.col("__n")))))
    return hit.select(*by, "rank", F.col("__v").alias("value"))


def quantiles(df: DataFrame, x: str, qs: list[float], discrete: bool = False, cells: int | None = None) -> list[float | None]:
    """Exact quantiles of the non-null values of ``x``, interpolated linearly or, ``discrete``, the value at rank ceil(q n).

    The values are counted and ordered cell by cell; the one or two order statistics of each quantile are all that is collected.
    """
    n = df.filter(F.col(x).isNotNull()).count()
    if not n:
        return [None] * len(qs)
    # the position is nudged so that a product like 0.95 * 20 that rounding lifts stays the whole number it is
    spots = [(max(1, math.ceil(q * n - 1e-9)),) * 2 + (0.0,) if discrete else (int(math.floor(q * (n - 1))) + 1, min(n, int(math.floor(q * (n - 1))) + 2), q * (n - 1) - math.floor(q * (n - 1))) for q in qs]
    at = {r["rank"]: float(r["value"]) for r in order_statistics(df, x, sorted({r for s in spots for r in s[:2]}), cells=cells).collect()}
    return [at[a] + w * (at[b] - at[a]) if w else at[a] for a, b, w in spots]
