"""Problems 1, 2, 5 and 6: brute force on small tables, and the edge cases their docstrings define."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions.dates import spelled_date
from ledgerweave.operators.orphans import probe
from ledgerweave.operators.packed import split_packed
from ledgerweave.operators.profile import profile_issues
from ledgerweave.operators.snapshots import SnapshotIndex

NAN, INF = float("nan"), float("inf")


def brute_issues(rows, ranges):
    out = set()
    loads = sorted({r["load_id"] for r in rows if r["load_id"] is not None})
    vals = {}
    for load in loads:
        for c, (lo, hi) in ranges.items():
            col = [r[c] for r in rows if r["load_id"] == load]
            some = [v for v in col if v is not None and v == v]
            vals[c, load] = [v for v in some if lo <= v <= hi]
            if len(col) - len(some) > 0.05 * len(col):
                out.add((c, load, "null_rate"))
            if len(vals[c, load]) < len(some):
                out.add((c, load, "out_of_range"))
            if len(some) >= 10 and len(set(some)) == 1:
                out.add((c, load, "constant"))
    for (c, load), a in vals.items():
        b = vals.get((c, load - 1), [])
        n, m = len(a), len(b)
        if n >= 10 and m >= 10:
            a, b = sorted(a), sorted(b)
            d = max(abs(bisect.bisect_right(a, x) / n - bisect.bisect_right(b, x) / m) for x in a + b)
            if d > 0.15 + 1.5 * ((n + m) / (n * m)) ** 0.5:
                out.add((c, load, "drift"))
    return out


def found(df):
    return {(r.column_name, r.load_id, r.issue) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_profile_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for load in (1001, 1002, 1003, 1005):
        for _ in range(rng.randint(150, 400)):
            # b shifts by about the threshold, c is a step function of few values, d goes empty and leaves its range
            rows.append({
                "load_id": load, "a": rng.gauss(0, 1), "b": rng.gauss(0.55 * (load % 2), 1), "c": float(rng.randint(0, 1 + load % 3)),
                "d": rng.choice([None, NAN, 1.0, 70.0, -INF]) if load == 1002 else 3.25, "pos": 1, "v": 2.0, "cell": 0,
            })
    ranges = {c: (-50.0, 50.0) for c in "abcd"}
    schema = "load_id int, a double, b double, c double, d double, pos int, v double, cell int"
    df = spark.createDataFrame([tuple(r[k] for k in ("load_id", "a", "b", "c", "d", "pos", "v", "cell")) for r in rows], schema)
    assert found(profile_issues(df, "t", ranges)) == brute_issues(rows, ranges)


def test_all_columns_are_profiled_and_counted(spark, sf):
    import pandas as pd

    from ledgerweave.queries import quality

    distinct = {(r.table_name, r.column_name, r.load_id): r.n_distinct for r in quality.QUERIES["p1_distinct"](spark, sf).collect()}
    profile = {(r.table_name, r.column_name, r.load_id): r for r in quality.QUERIES["p1_profile"](spark, sf).collect()}
    want = {}
    for name, more, ranges in (("report", ["step", "feature", "n"], quality.REPORT_RANGES), ("elliptic_txs_features", [], quality.FEATURE_RANGES)):
        for load, x in pd.read_parquet(f"{sf}/{name}.parquet").groupby("load_id"):
            want |= {(name, c, load): x[c].dropna().nunique() for c in [*more, *ranges]}
            for c, (lo, hi) in ranges.items():
                some, r = x[c].dropna(), profile[name, c, load]
                v = some[(some >= lo) & (some <= hi)]
                assert (r.n_rows, r.n_null, r.n_outside) == (len(x), len(x) - len(some), len(some) - len(v))
                assert len(some) == 0 or (r.min_value, r.max_value) == (some.min(), some.max())
                assert len(v) < 2 or (abs(r.mean_value - v.mean()) < 1e-5 and abs(r.sd_value - v.std()) < 1e-5)
    assert distinct == want


def test_sums_do_not_depend_on_the_order(spark):
    from ledgerweave.operators.profile import merge_profile, partial_profile

    rng = random.Random(2)
    rows = [(1 if i % 3 else None, rng.uniform(-50, 50), rng.gauss(0, 1e-3) + 40, rng.choice([None, 1.0, NAN])) for i in range(3000)]
    ranges = {"a": (-50, 50), "b": (0, 50), "c": (0, 1)}
    out = []
    for parts, x in ((1, rows), (7, rows[::-1]), (3, sorted(rows, key=lambda r: r[1]))):
        df = spark.createDataFrame(x, "load_id int, a double, b double, c double").repartition(parts)
        out.append(sorted(merge_profile(partial_profile(df, ranges, "load_id"), ranges).collect(), key=lambda r: (r.pos, r.load_id or 0)))
    assert out[0] == out[1] == out[2]
    b = [r[2] for r in rows if r[0] is None]
    one = next(r for r in out[0] if r.pos == 1 and r.load_id is None)
    mean = sum(b) / len(b)
    assert one.n_rows == len(b) and abs(one.mean - mean) < 1e-12 and abs(one.sd - (sum((x - mean) ** 2 for x in b) / (len(b) - 1)) ** 0.5) < 1e-8


def test_profile_patterns_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "feat_2"), (1, "feat_2\n"), (2, None), (2, "feat_3"), (None, "feat_x")], "load_id int, f string")
    got = found(profile_issues(df, "t", {}, {"f": r"\Afeat_\d\z"}))
    assert got == {("f", 1, "pattern"), ("f", 2, "null_rate"), ("f", None, "pattern")}
    assert profile_issues(spark.createDataFrame([], "load_id int, x double"), "t", {"x": (0, 1)}).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []), ("", []), ("  ", []), ("-0-", []), (" -0-. ", []), (";;\n;", []),
        ("a; b;;c", ["a", "b", "c"]),
        ("a, b", ["a", "b"]), ("a, b; c", ["a, b", "c"]), ("\na, b;", ["a", "b"]),
        ('"x; ""y"""; «p | q»', ['x; "y"', "p | q"]),
        ('"a \\"b\\" c".', ['a "b" c']), ('a.k.a. "P, Q"; z.', ['a.k.a. "P, Q"', "z"]),
        ("Passport 1 (A; B) // C", ["Passport 1 (A; B)", "C"]), ("http://x//y; z", ["http://x//y", "z"]),
        ("•a\n• b", ["a", "b"]), ("a；b\tc|d", ["a", "b", "c", "d"]), ('«a "b; c"»; "d', ['a "b; c"', '"d']), ("(a; b", ["(a", "b"]), ('"A" and "B"; c', ['"A" and "B"', "c"]),
        ("a\ue000b\ue101; \ue001\ue100", ["a\ue000b\ue101", "\ue001\ue100"]), ('"\ue101; x" ; y', ["\ue101; x", "y"]),
        ("x (a; b (c (d; e))) ; y", ["x (a; b (c (d; e)))", "y"]), ("a ) b (c; (d; e) f; g", ["a ) b (c", "(d; e) f", "g"]), ("(a, b), c", ["(a, b)", "c"]),
        ('("a; b" c); d', ['("a; b" c)', "d"]), ('"a" (b "c; d") ; «e» ("f', ['"a" (b "c; d")', '«e» ("f']), ('"a\\"; "b"', ['"a\\"; "b"']),
    ],
)
def test_packed_values(spark, text, want):
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x")], "k long, t string, value string").withColumn("pos", F.lit(9))
    got = sorted((r.pos, r.value) for r in split_packed(df, "k", "t").collect())
    assert got == list(enumerate(want, 1))


def test_packed_long_and_empty(spark):
    df = spark.createDataFrame([(1, "; ".join(f'"v{i}; (x"' for i in range(4_000))), (2, "; ".join(f"v{i}" for i in range(200_000)))], "k long, t string")
    assert split_packed(df, "k", "t").count() == 204_000
    assert split_packed(df.limit(0), "k", "t").count() == 0


def snapshots(rng, days):
    return [{f"k{i}": rng.randint(0, 2) for i in range(40) if rng.random() < 0.7} for _ in range(days)]


def brute_changes(a, b):
    return {(k, "added") for k in b.keys() - a.keys()} | {(k, "removed") for k in a.keys() - b.keys()} | {(k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}


def test_snapshot_index_agrees_with_brute_force_and_survives_a_restart(spark, tmp_path):
    days = snapshots(random.Random(5), 5)
    path = str(tmp_path / "i")
    make = lambda: SnapshotIndex(spark, path, ["k"], ["v"], 4)
    index = make()
    for o, day in enumerate(days, 1):
        rows = [(k, v, "x") for k, v in day.items()] * 2 + [(None, 1, "x")]
        got = index.advance(spark.createDataFrame(rows, "k string, v int, h string"))
        if o == 1:
            assert got is None
            continue
        before = days[o - 2]
        assert {(r.k, r.change) for r in got.collect()} == brute_changes(before, day)
        assert all(r.old == (None if r.change == "added" else [f'{{"v":{before[r.k]}}}']) and r.version == o for r in got.collect())
        if o == 3:  # another process, after a delivery that was interrupted
            (tmp_path / "i" / "v4" / "index").mkdir(parents=True)
            index = make()
            assert index.version == 3 and not (tmp_path / "i" / "v4").exists()
    assert sorted(p.name for p in (tmp_path / "i").iterdir() if (p / "index").exists()) == ["v5"]
    assert index.changes().count() == sum(len(brute_changes(a, b)) for a, b in zip(days, days[1:]))
    plan = spark.table(index._name(5, "index")).join(spark.table(index._name(5, "index")).withColumnRenamed("h", "g"), "k", "full_outer")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_snapshot_series_nulls_and_empty(spark, tmp_path):
    index = SnapshotIndex(spark, str(tmp_path / "i"), ["s", "k"], ["v"], 2, "s")
    make = lambda rows: spark.createDataFrame(rows, "s string, k string, v int")
    assert index.advance(make([("a", "x", None), ("b", "y", 1), ("b", "z", 1), ("b", "z", 2)]), ["a", "b"]) is None
    # b is not delivered: its rows are neither removed nor lost
    assert [tuple(r)[1:4] for r in index.advance(make([("a", "x", 0), ("b", "y", 7)]), ["a"]).collect()] == [("a", "x", "changed")]
    assert sorted(tuple(r)[1:] for r in index.advance(make([("b", "z", 2), ("b", "z", 1)]), ["b"]).collect()) == [("b", "y", "removed", ['{"v":1}'])]
    assert [r.change for r in index.advance(make([]), ["a", "b"]).collect()] == ["removed", "removed"]
    assert index.advance(make([])).count() == 0


def test_spelled_dates(spark):
    df = spark.createDataFrame([("2025-04-05",), ("20250405",), ("2025/04/05",), (" 05.04.2025 ",), ("5 Apr 2025",), ("2025-04-05T06:00:00",), ("x",), (None,)], "d string")
    assert [str(r[0]) for r in df.select(spelled_date(F.col("d"))).collect()] == ["2025-04-05"] * 6 + ["None"] * 2


def test_probe_splits_ranges_and_hot_keys(spark):
    rng = random.Random(3)
    keys = {rng.randint(-(10**12), 10**12): rng.randint(0, 9) for _ in range(500)}
    refs = [(rng.choice([*keys, 5, 7]), i) for i in range(1500)] + [(next(iter(keys)), i) for i in range(1500)]
    r = spark.createDataFrame(refs, "k long, of long")
    p = spark.createDataFrame([*keys.items()], "k long, f long")
    got = {(x.k, x.of): x.f for x in probe(r, p, "k", ["f"], "of", range_keys=60, slot_rows=200).collect()}
    assert got == {(k, of): keys.get(k) for k, of in refs}
    assert all(x.f is None for x in probe(r, p.limit(0), "k", ["f"], "of").collect())
    assert probe(r.limit(0), p, "k", ["f"], "of").count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p1_profile", "p1_distinct", "p2_found", "p5_found", "p5_old_values", "p6_found"])
def test_queries_run(spark, sf, name):
    from ledgerweave.queries import quality

    df = quality.QUERIES[name](spark, sf)
    assert df.count() == df.distinct().count() > 0
