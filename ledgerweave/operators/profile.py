"""Column-level data quality profile of a table, load by load.

One scan gives, per load and column, mergeable partial results: row, null and out-of-range counts, minimum, maximum,
the power sums of orders 1 and 2 and a fixed histogram.  Sums are kept in fixed point, so they do not depend on the order in
which partial results meet.  Neighbouring loads are compared by standardised differences of those sums; where the sums alone
cannot prove a shift of the distribution function, the histogram brackets the largest difference of the two distribution
functions, and only bins in which the bracket contains the threshold are read again for the exact value.  Nothing but the
partial results is shuffled in the first scan.

Defined results: an empty table has no profile.  NaN is null.  Rows with a null load form a load of their own, which has
no predecessor.  Repeated rows count as often as they occur.  Other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql import Window as W

from ledgerweave.plans.staging import Stage

#: Histogram cells on either side of zero of the monotone map x -> x / (1 + |x|).
CELLS = 256
NULL_CELL, OUTSIDE_CELL = -1, -2
#: Undecided cells that are broadcast; more are joined by shuffling.
BROADCAST_CELLS = 200_000
#: Columns that distinct values are counted of in one scan.
COLUMN_GROUP = 48
#: Loads whose partial results a task keeps before it passes them on, bits of each of the two parts of a sum.
LOADS_HELD, BITS = 32, 30

ISSUES = "table_name string, column_name string, load_id int, issue string"


def cell_of(v: Column) -> Column:
    """Histogram cell of an in-range value; monotone in the value."""
    return F.floor((v / (F.abs(v) + 1.0) + 1.0) * CELLS).cast("int")


def unpivot(df: DataFrame, columns: list[str], load: str) -> DataFrame:
    """(load, pos, v): one row per cell, v null for null and NaN."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    long = df.select(F.col(load).cast("int").alias("load_id"), F.posexplode(values).alias("pos", "v"))
    return long.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def _scale(low: float, high: float) -> int:
    """Power of two that is not below any value inside the range."""
    return max(0, math.ceil(math.log2(max(abs(low), abs(high), 1.0))))


def _fixed(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of -1..1 as whole numbers of 2^-30 and, for the rest, of 2^-60."""
    a = np.rint(u * 2.0**BITS)
    return a.astype(np.int64), np.rint((u - a * 2.0**-BITS) * 2.0 ** (2 * BITS)).astype(np.int64)


class _Held:
    """Partial results of one load: counts by column and cell, extremes and sums by column."""

    def __init__(self, width: int):
        self.n = np.zeros((width, 2 * CELLS + 2), np.int64)  # cells moved up by two: outside, null, then the histogram
        self.low, self.high = np.full((width, 2), np.inf), np.full((width, 2), -np.inf)  # inside, outside
        self.sums = np.zeros((width, 4), np.int64)


def partial_profile(df: DataFrame, ranges: Mapping[str, tuple[float, float]], load: str) -> DataFrame:
    """Mergeable partial results by (load_id, pos, cell): n, lo, hi, and in one row of each (load_id, pos) the sums a1, b1, a2, b2.

    One scan in Arrow batches, a row of which is never turned into many; a task passes on what it has counted, load by load.
    """
    names = list(ranges)
    low, high = (np.array([float(ranges[c][i]) for c in names])[:, None] for i in (0, 1))
    unit = np.array([2.0 ** -_scale(*map(float, ranges[c])) for c in names])[:, None]
    schema = T.StructType([
        T.StructField("load_id", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in ("a1", "b1", "a2", "b2")],
    ])

    def result(load_id: int | None, h: _Held) -> pa.RecordBatch:
        pos, cell = np.nonzero(h.n)
        side = np.where(cell == 0, 1, 0)
        lo, hi = h.low[pos, side], h.high[pos, side]
        first = np.concatenate([[True], pos[1:] != pos[:-1]])
        sums = np.where(first[:, None], h.sums[pos], 0)
        none = cell == 1
        return pa.RecordBatch.from_arrays([
            pa.array([load_id] * len(pos), pa.int32()), pa.array(pos.astype(np.int32)), pa.array((cell - 2).astype(np.int32)), pa.array(h.n[pos, cell]),
            pa.array(lo, mask=none), pa.array(hi, mask=none), *[pa.array(np.ascontiguousarray(sums[:, i])) for i in range(4)],
        ], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int | None, _Held] = {}
        for b in batches:
            if not b.num_rows:
                continue
            loads = b.column(0)
            x = np.empty((len(names), b.num_rows))
            for i in range(len(names)):
                x[i] = b.column(i + 1).to_numpy(zero_copy_only=False)
            null = np.isnan(x)
            inside = (x >= low) & (x <= high)
            v = np.where(inside, x, 0.0)
            cell = np.where(inside, np.floor((v / (np.abs(v) + 1.0) + 1.0) * CELLS).astype(np.int64) + 2, np.where(null, 1, 0))
            u = v * unit
            parts = [*_fixed(u), *_fixed(u * u)]
            for key in loads.unique().to_pylist():
                at = loads.is_null() if key is None else pc.equal(loads, key)
                rows = np.flatnonzero(at.to_numpy(zero_copy_only=False).astype(bool))
                if key not in held and len(held) >= LOADS_HELD:
                    for k in list(held):
                        yield result(k, held.pop(k))
                h = held.setdefault(key, _Held(len(names)))
                y, c, ok = x[:, rows], cell[:, rows], inside[:, rows]
                flat = c + np.arange(len(names))[:, None] * h.n.shape[1]
                h.n += np.bincount(flat.ravel(), minlength=h.n.size).reshape(h.n.shape)
                for side, mask in ((0, ok), (1, c == 0)):
                    h.low[:, side] = np.minimum(h.low[:, side], np.where(mask, y, np.inf).min(axis=1))
                    h.high[:, side] = np.maximum(h.high[:, side], np.where(mask, y, -np.inf).max(axis=1))
                h.sums += np.stack([p[:, rows].sum(axis=1) for p in parts], axis=1)
        for k, h in held.items():
            yield result(k, h)

    return df.select(F.col(load).cast("int").alias("load_id"), *[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(names)]).mapInArrow(run, schema)


def distinct_counts(df: DataFrame, columns: list[str], load: str) -> DataFrame:
    """(load_id, pos, n_distinct): exact distinct values of each column and load; null and NaN are no values.

    Numbers are compared as doubles, text as it is.  Columns are read in groups of ``COLUMN_GROUP``, so that a task's table of values seen stays small.
    """
    text = [c for c in columns if dict(df.dtypes)[c] == "string"]
    number = [c for c in columns if c not in text]
    out = None
    for kind in (number, text):
        for i in range(0, len(kind), COLUMN_GROUP):
            part = kind[i : i + COLUMN_GROUP]
            at = F.array(*[F.lit(columns.index(c)) for c in part])
            if kind is number:
                long = unpivot(df, part, load)
            else:
                long = df.select(F.col(load).cast("int").alias("load_id"), F.posexplode(F.array(*[F.col(f"`{c}`") for c in part])).alias("pos", "v"))
            # grouped first, so that repeated values are left out before the shuffle
            seen = long.groupBy("load_id", "pos", "v").agg(F.lit(1).alias("one")).groupBy("load_id", "pos").agg(F.count("v").alias("n_distinct"))
            seen = seen.select("load_id", F.get(at, F.col("pos")).alias("pos"), "n_distinct")
            out = seen if out is None else out.unionByName(seen)
    return out


def merge_profile(parts: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """One row per (load_id, pos): counts, extremes and moments of all partial results."""
    inside, null = F.col("cell") >= 0, F.col("cell") == NULL_CELL
    out = parts.groupBy("load_id", "pos").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(null, F.col("n")).otherwise(0)).alias("n_null"),
        F.sum(F.when(F.col("cell") == OUTSIDE_CELL, F.col("n")).otherwise(0)).alias("n_outside"),
        F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("n_inside"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("a1", "b1", "a2", "b2")],
    )
    unit = F.get(F.array(*[F.lit(2.0 ** _scale(*map(float, r))) for r in ranges.values()]), F.col("pos"))
    total = lambda a, b: F.col(a).cast("double") * 2.0**-BITS + F.col(b).cast("double") * 2.0 ** (-2 * BITS)
    out = out.withColumn("s1", total("a1", "b1") * unit).withColumn("s2", total("a2", "b2") * unit * unit).drop("a1", "b1", "a2", "b2")
    n = F.col("n_inside")
    mean = F.when(n > 0, F.col("s1") / n)
    var = F.when(n > 1, F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1)))
    return out.withColumn("mean", mean).withColumn("sd", F.sqrt(var))


def standardised_shift(merged: DataFrame) -> DataFrame:
    """Each (load_id, pos) beside the load before it: sizes, standardised difference and what it proves about the distributions.

    With means d apart and population deviations p and q, Cantelli's inequality gives a difference of the distribution
    functions of at least (z^2 - 1) / (z^2 + 1), z = d / (p + q), at a point between the means.
    """
    square = F.col("s2") / F.col("n_inside")
    # the difference of the two terms may cancel: a deviation that is not below the true one keeps the proof sound
    psd = F.sqrt(F.greatest(F.lit(0.0), square - F.pow(F.col("s1") / F.col("n_inside"), 2)) + 1e-13 * square)
    cur = merged.filter("n_inside > 0").select("load_id", "pos", F.col("n_inside").alias("n"), "mean", "sd", psd.alias("psd"))
    prev = cur.select((F.col("load_id") + 1).alias("load_id"), "pos", F.col("n").alias("m"), F.col("mean").alias("mean0"), F.col("sd").alias("sd0"), F.col("psd").alias("psd0"))
    both = cur.join(prev, ["load_id", "pos"])
    n, m = F.col("n"), F.col("m")
    pooled = F.sqrt(((n - 1) * F.pow(F.coalesce("sd", F.lit(0.0)), 2) + (m - 1) * F.pow(F.coalesce("sd0", F.lit(0.0)), 2)) / F.greatest(n + m - 2, F.lit(1)))
    gap = F.abs(F.col("mean") - F.col("mean0"))
    z2 = F.pow(gap / (F.col("psd") + F.col("psd0")), 2)
    # a zero spread on both sides leaves z null: nothing is proved, the histogram decides
    return both.withColumn("std_diff", F.when(pooled > 0, (F.col("mean") - F.col("mean0")) / pooled)).withColumn(
        "proved", F.when((F.col("psd") + F.col("psd0")) > 1e-9, F.greatest(F.lit(0.0), (z2 - 1) / (z2 + 1))).otherwise(0.0)
    )


def threshold(n: Column, m: Column) -> Column:
    return 0.15 + 1.5 * F.sqrt((n + m) / (n * m))


def _brackets(parts: DataFrame, shift: DataFrame) -> DataFrame:
    """Per (load_id, pos, cell): shares of both loads below and up to the cell's end, in counts."""
    inside = parts.filter("cell >= 0").select("load_id", "pos", "cell", "n")
    sides = inside.select("load_id", "pos", "cell", F.col("n").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(
        inside.select((F.col("load_id") + 1).alias("load_id"), "pos", "cell", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    )
    cells = sides.groupBy("load_id", "pos", "cell").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    cells = cells.join(shift.select("load_id", "pos", "n", "m", "proved"), ["load_id", "pos"])
    w = W.partitionBy("load_id", "pos").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    cells = cells.withColumn("ca", F.sum("a").over(w)).withColumn("cb", F.sum("b").over(w))
    fa, fb = F.col("ca") / F.col("n"), F.col("cb") / F.col("m")
    ga, gb = (F.col("ca") - F.col("a")) / F.col("n"), (F.col("cb") - F.col("b")) / F.col("m")
    return cells.withColumn("least", F.abs(fa - fb)).withColumn("most", F.greatest(fa - gb, fb - ga))


def _exact(stage: Stage, df: DataFrame, names: list[str], load: str, ranges: Mapping[str, tuple[float, float]], open_cells: DataFrame) -> DataFrame:
    """Largest difference of the distribution functions inside the open cells, from the grouped distinct values of those cells."""
    need = sorted({r[0] for r in open_cells.select("pos").distinct().collect()})  # column numbers: metadata
    if not need:
        return open_cells.select("load_id", "pos", F.lit(0.0).alias("ks")).limit(0)
    long = unpivot(df, [names[p] for p in need], load)
    real = F.array(*[F.lit(p) for p in need])
    low = F.array(*[F.lit(float(ranges[names[p]][0])) for p in need])
    high = F.array(*[F.lit(float(ranges[names[p]][1])) for p in need])
    long = long.filter((F.col("v") >= F.get(low, F.col("pos"))) & (F.col("v") <= F.get(high, F.col("pos"))))
    long = long.select("load_id", F.get(real, F.col("pos")).alias("pos"), "v", cell_of(F.col("v")).alias("cell"))
    # values of open cells only, of the load and of the one before: what is grouped and written is a small part of the column
    wanted = open_cells.select("load_id", "pos", "cell").unionByName(open_cells.select((F.col("load_id") - 1).alias("load_id"), "pos", "cell")).distinct()
    wanted = F.broadcast(wanted) if open_cells.count() <= BROADCAST_CELLS else wanted
    values = long.join(wanted, ["load_id", "pos", "cell"]).groupBy("load_id", "pos", "cell", "v").agg(F.count(F.lit(1)).alias("k"))
    values = stage.write(values)
    sides = values.select("load_id", "pos", "cell", "v", F.col("k").alias("x"), F.lit(0).cast("long").alias("y")).unionByName(
        values.select((F.col("load_id") + 1).alias("load_id"), "pos", "cell", "v", F.lit(0).cast("long").alias("x"), F.col("k").alias("y"))
    )
    open_ = open_cells.select("load_id", "pos", "cell", "n", "m", (F.col("ca") - F.col("a")).alias("la"), (F.col("cb") - F.col("b")).alias("lb"))
    near = sides.join(open_, ["load_id", "pos", "cell"])
    near = near.groupBy("load_id", "pos", "cell", "v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), *[F.first(c).alias(c) for c in ("n", "m", "la", "lb")])
    w = W.partitionBy("load_id", "pos", "cell").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    diff = F.abs((F.col("la") + F.sum("x").over(w)) / F.col("n") - (F.col("lb") + F.sum("y").over(w)) / F.col("m"))
    return near.select("load_id", "pos", diff.alias("ks")).groupBy("load_id", "pos").agg(F.max("ks").alias("ks"))


def profile_issues(
    df: DataFrame, table: str, ranges: Mapping[str, tuple[float, float]], patterns: Mapping[str, str] | None = None, load: str = "load_id", min_values: int = 10, max_null: float = 0.05
) -> DataFrame:
    """Faults per column and load (see TESTDATA, problem 1): null_rate, out_of_range, constant, drift, pattern."""
    stage, names = Stage(df.sparkSession), list(ranges)
    label = F.array(*[F.lit(c) for c in names])
    found = []
    if names:
        parts = stage.write(partial_profile(df, ranges, load))
        merged = stage.write(merge_profile(parts, ranges))
        some = F.col("n_rows") - F.col("n_null")
        flags = merged.select(
            "load_id", "pos",
            F.explode(F.array_compact(F.array(
                F.when(F.col("n_null") > max_null * F.col("n_rows"), F.lit("null_rate")),
                F.when(F.col("n_outside") > 0, F.lit("out_of_range")),
                F.when((some >= min_values) & (F.col("lo") == F.col("hi")), F.lit("constant")),
            ))).alias("issue"),
        )
        shift = stage.write(standardised_shift(merged).filter((F.col("n") >= min_values) & (F.col("m") >= min_values)))
        cells = stage.write(_brackets(parts, shift))
        tau = threshold(F.col("n"), F.col("m"))
        sure = cells.groupBy("load_id", "pos").agg(F.max(F.greatest("least", "proved")).alias("ks"), F.first("n").alias("n"), F.first("m").alias("m")).filter(F.col("ks") > tau)
        sure = stage.write(sure)
        open_cells = cells.join(sure.select("load_id", "pos"), ["load_id", "pos"], "left_anti").filter(F.col("most") > tau)
        open_cells = stage.write(open_cells)
        exact = _exact(stage, df, names, load, ranges, open_cells).join(shift.select("load_id", "pos", "n", "m"), ["load_id", "pos"]).filter(F.col("ks") > tau)
        drift = sure.select("load_id", "pos").unionByName(exact.select("load_id", "pos")).withColumn("issue", F.lit("drift"))
        both = flags.unionByName(drift)
        found.append(both.select(F.lit(table).alias("table_name"), F.get(label, F.col("pos")).alias("column_name"), "load_id", "issue"))
    for c, regex in (patterns or {}).items():
        x = F.col(f"`{c}`")
        agg = df.groupBy(F.col(load).cast("int").alias("load_id")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(x.isNull(), 1).otherwise(0)).alias("n_null"), F.sum(F.when(~x.rlike(regex), 1).otherwise(0)).alias("n_bad")
        )
        issue = F.array_compact(F.array(F.when(F.col("n_null") > max_null * F.col("n_rows"), F.lit("null_rate")), F.when(F.col("n_bad") > 0, F.lit("pattern"))))
        found.append(agg.select(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), "load_id", F.explode(issue).alias("issue")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
