"""Hand-computed values of the risk operators."""

import hashlib
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import curves, density, evidence, fusion, graphs, losses, matrix, series, stats, vectors
from ledgerweave.plans.ordered import ordinal_rank, running_totals
from ledgerweave.sources import sanctions
from ledgerweave.sources.elliptic import labelled, load_elliptic, with_split


def one(df):
    return df.first()[0]


def test_series_values(spark):
    df = spark.createDataFrame([(t,) for t, n in zip(range(1, 6), [1, 1, 4, 1, 1]) for _ in range(n)], "t0 int")
    s = series.hawkes(series.burstiness(series.dense_counts(df, "t0", 1, 5))).orderBy("t").collect()
    assert [round(r.burstiness, 12) for r in s] == [-1, -1, *[round(-0.17157287525380988, 12)] * 3]
    want = [1.6, 1.7839397205857213, 1.8516073622040277, 2.428320058145123, 2.0886616406872456]
    assert all(abs(r.hawkes - w) < 1e-12 for r, w in zip(s, want))


def test_since_last(spark):
    df = spark.createDataFrame([(1, False), (2, True), (4, False), (None, True)], "t0 int, f boolean")
    s = series.since_last(series.dense_counts(df, "t0", 1, 5, "f")).orderBy("t").collect()
    assert [r.since_last for r in s] == [49, 0, 1, 2, 3]
    lagged = series.since_last(series.dense_counts(df, "t0", 1, 5, "f"), lag=1).orderBy("t").collect()
    assert [r.since_last for r in lagged] == [49, 49, 1, 2, 3]
    assert [r.n for r in series.dense_counts(df.limit(0), "t0", 1, 3).collect()] == [0, 0, 0]
    x = series.temporal_features(df, "t0", "f", 1, 5).filter("t0 is null").first()
    assert (x.step_count, x.since_last) == (0, 49)


def scores(spark, rows):
    return spark.createDataFrame(rows, "id int, y int, s double")


def test_costs_and_ties(spark):
    df = scores(spark, [(1, 0, 0.5), (2, 1, 0.5)])
    c = {r.tau: r.cost for r in curves.cost_curve(curves.score_steps(df, "s", "y"), 1.0, 10.0).collect()}
    assert c == {0.5: 1.0}
    x = curves.best_threshold(curves.cost_curve(curves.score_steps(df, "s", "y"), 1.0, 10.0), 1).first()
    assert (x.tau, x.feasible) == (0.5, False)
    assert curves.best_threshold(curves.cost_curve(curves.score_steps(df.limit(0), "s", "y"), 1.0, 10.0)).count() == 0


def test_ranking_metrics(spark):
    df = scores(spark, [(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.7), (4, 0, 0.1), (5, None, 0.3)])
    st = curves.score_steps(df, "s", "y")
    assert abs(one(curves.average_precision(st)) - (0.5 + 0.5 * 2 / 3)) < 1e-12
    assert one(curves.roc_auc(st)) == 0.75
    assert one(curves.average_precision(curves.score_steps(df.filter("y = 1"), "s", "y"))) == 0.0
    p = {r.k: r.precision for r in curves.precision_at(df, "s", "y", "id", [2, 9]).collect()}
    assert p == {2: 0.5, 9: 0.5}
    g = curves.fbeta_grid(df, "s", "y", 1.0).filter("tau = 0.7").first()
    assert abs(g.precision - 2 / 3) < 1e-12 and g.recall == 1.0


def test_group_rates(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 0, 0), ("b", 1, 1), ("b", 0, 1), ("b", 0, 0), ("c", 0, 0)], "g string, y int, p int")
    r = {x.group: x for x in curves.group_rates(df, "y", "p", "g").collect()}
    assert (r["a"].tpr, r["b"].tpr, r["a"].fpr, r["b"].fpr, r["c"].tpr) == (0.5, 1.0, 0.0, 0.5, None) and r["a"].tpr_gap == r["a"].fpr_gap == 0.5


def test_reliability_edges(spark):
    df = scores(spark, [(1, 0, 0.0), (2, 1, 0.1), (3, 1, 0.1000001), (4, 1, 1.0)])
    assert [r.n for r in curves.reliability(df, "s", "y", 10).orderBy("bin").collect()] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 1]


def test_running_totals_and_ranks(spark):
    df = spark.range(5000).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(100000)) / 7).alias("x"), F.lit(1).alias("n")).dropDuplicates(["x"])
    rows = running_totals(df, "x", ["n"], descending=True, cells=32).collect()
    order = sorted((r.x for r in rows), reverse=True)
    assert {r.x: r.cum_n for r in rows} == {x: i + 1 for i, x in enumerate(order)}
    assert {r.id: r["rank"] for r in ordinal_rank(df, "x", "id", 32).collect()} == {r.id: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r.x, r.id)))}


def test_running_totals_by_group(spark):
    rng = random.Random(6)
    rows = [(None if rng.random() < 0.1 else rng.choice("aab"), i, rng.randint(0, 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, x int, n long")
    got = {(r.g, r.x): r.cum_n for r in running_totals(df, "x", ["n"], descending=True, cells=11, by=["g"]).collect()}
    assert got == {(g, x): sum(m for h, y, m in rows if h == g and y >= x) for g, x, _ in rows}


def test_statistics(spark):
    d = spark.createDataFrame([(float(i), i >= 50) for i in range(100)], "v double, post boolean").withColumn("f", F.lit("x"))
    assert one(stats.ks_two_sample(d, "v", "post", ["f"]).select("ks_D")) == 1.0
    assert one(stats.cohen_d(d, "v", "post", ["f"]).select("cohen_d")) > 3
    mk = stats.mann_kendall(spark.createDataFrame([(i, float(i)) for i in range(6)], "t int, v double"), "t", "v").first()
    assert (mk.n, mk.s) == (6, 15) and abs(mk.var_s - 6 * 5 * 17 / 18) < 1e-12
    r, p, n = stats.partial_correlation(spark.createDataFrame([(float(i), 2.0 * i + (i % 3), float(i % 5)) for i in range(60)], "x double, y double, z double"), "x", "y", ["z"])
    assert r > 0.99 and p < 1e-6 and n == 60
    assert stats.partial_correlation(spark.createDataFrame([], "x double, y double"), "x", "y", [])[:2] == (0.0, 1.0)
    b, t, p = stats.ols_last(spark.createDataFrame([(3.0 * i + (i % 2), float(i)) for i in range(40)], "y double, x double"), "y", ["x"])
    assert abs(b - 3) < 0.01 and p < 1e-9
    w = spark.range(20000).select(stats.poisson_weight(F.col("id"), F.lit(1)).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.05


EDGES = [(1, 2), (1, 3), (2, 3), (5, 6), (1, 2), (None, 4)]


def test_graph(spark):
    e = graphs.clean_edges(spark.createDataFrame(EDGES, "a int, b int"), "a", "b")
    d = {r.node: r for r in graphs.degrees(e, spark.createDataFrame([(i,) for i in range(1, 7)], "node int")).collect()}
    assert len(d) == 6 and (d[4].in_degree, d[4].out_degree, d[4].ratio) == (0, 0, 1.0) and d[1].out_degree == 2
    assert {r.node: r.component for r in graphs.components(e).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    p = {r.node: r["rank"] for r in graphs.pagerank(e, rounds=50).collect()}
    assert abs(sum(p.values()) - 1) < 1e-9 and p[3] > p[2] > p[1]
    assert {r.node: r.hops for r in graphs.hops_from(e, 1).collect()} == {1: 0, 2: 1, 3: 1}
    assert graphs.components(e.limit(0)).count() == 0 and graphs.pagerank(e.limit(0)).count() == 0
    chain = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in graphs.components(chain).collect()} == {0}


def test_capped_union(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    c = {r.node: r.cluster for r in graphs.capped_union(e, ["src", "dst"], 3).collect()}
    assert c == {"a": "a", "b": "a", "c": "a", "d": "d", "x": "x", "y": "x"}


def test_hops_of_any_length(spark, sf):
    from ledgerweave.queries import risk

    pairs = [(r.src, r.dst) for r in risk._edges(spark, sf).collect()]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    start = min(x for p in pairs for x in p)
    hops, front = {start: 0}, [start]
    for a in front:
        for b in near[a] - hops.keys():
            hops[b] = hops[a] + 1
            front.append(b)
    assert max(hops.values()) > 6
    assert {r.node: r.hops for r in risk.QUERIES["r100_proximity"](spark, sf).collect()} == hops
    chain = spark.createDataFrame([(i, i + 1) for i in range(5)], "src int, dst int")
    assert graphs.hops_from(chain, 0, bound=5).count() == 6
    with pytest.raises(RuntimeError):
        graphs.hops_from(chain, 0, bound=4)


def unions(edges, cap):
    member = {x: {x} for e in edges for x in e}
    for a, b in sorted(edges):
        if member[a] is not member[b] and len(member[a]) + len(member[b]) <= cap:
            both = member[a] | member[b]
            for x in both:
                member[x] = both
    return {x: min(m) for x, m in member.items()}


@pytest.mark.parametrize("cap, replay_rows", [(4, 0), (4, 40), (25, 0)])
def test_capped_union_of_a_giant_component(spark, cap, replay_rows):
    rng = random.Random(cap)
    pairs = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(240)})
    e = spark.createDataFrame(pairs, "src int, dst int")
    assert {r.node: r.cluster for r in graphs.capped_union(e, ["src", "dst"], cap, replay_rows).collect()} == unions(pairs, cap)


def test_cospend_queries_take_all_spends(spark, sf):
    from ledgerweave.queries import risk

    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").collect()
    tx = {}
    for r in rows:
        if r.l_returnflag != "R":
            tx.setdefault(r.l_orderkey, []).append((r.l_linenumber * 10_000_000 + r.l_partkey, r.l_partkey))
    stars = {(min(t)[1], a) for t in tx.values() for _, a in t}
    whole = unions([*stars, *((r.l_partkey, r.l_partkey) for r in rows)], len(rows))
    assert {r.node: r.component for r in risk.QUERIES["r092_cospend_clusters"](spark, sf).collect()} == whole
    cut = {(a, b) for a, b in stars if a != b}
    assert {r.node: r.cluster for r in risk.QUERIES["r093_capped_union"](spark, sf).collect()} == unions(cut, 4)
    want = {("co_spend", str(x), str(y)) for a, b in cut for x, y in ((a, b), (b, a))}
    want |= {e for r in rows for e in (("addr_tx", str(r.l_partkey), str(r.l_orderkey)), ("tx_addr", str(r.l_orderkey), str(r.l_partkey)))}
    got = [tuple(r) for r in risk.QUERIES["r097_account_graph"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want


def test_mentions(spark):
    m = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("c", 2), ("b", 3), ("c", 3), ("a", 4), ("d", 4)], "e string, x int")
    assert {(r.a, r.b): r.weight for r in graphs.comention(m, "x", "e").collect()} == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1, ("a", "d"): 1}
    a = graphs.mention_features(m, "x", "e").filter("entity = 'a'").first()
    assert (a.n_mentions, a.n_articles, a.mean_co) == (3, 3, 1.0)


def test_vectors(spark):
    pts = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(30)] + [(99, None)], "k int, v array<double>")
    n = vectors.nearest(pts, "k", "v", pts, "k", "v", 2, exclude_self=True, part_rows=7)
    assert {(r.l, r.r) for r in n.filter("l = 10").collect()} == {(10, 9), (10, 11)} and n.count() == 60
    assert {(r.l, r.r) for r in n.filter("l = 0").collect()} == {(0, 1), (0, 2)}
    assert vectors.within(pts, "k", "v", pts, "k", "v", 1.0, part_rows=9).count() == 30 + 58
    assert one(vectors.recall_at(n, n, 2)) == 1.0
    assert vectors.nearest(pts, "k", "v", pts.limit(0), "k", "v", 2).count() == 0
    c = density.dbscan(pts.filter("k < 10 or k > 20").filter("k < 30"), "k", "v", 1.0, 3)
    assert {r.cluster for r in c.collect()} == {1, 22}
    h = vectors.hard_negatives(spark.createDataFrame([(1, 0, 5, "a"), (2, 1, 6, "a"), (3, 1, 9, "a"), (4, 0, 6, "b")], "k int, y int, t int, e string"), "k", "y", "t", "e", 1)
    assert [tuple(r) for r in h.collect()] == [(1, 2)]


def test_index_recall(spark, sf):
    from ledgerweave.queries import risk

    assert one(risk.QUERIES["r111_pq_recall"](spark, sf)) >= 0.9 and one(risk.QUERIES["r104_index_recall"](spark, sf)) >= 0.9
    v = risk._vec(spark, sf)
    index = vectors.CellIndex(v, "vec_id", "vec", cells=20, part_rows=15)  # crowded cells are cut into blocks
    assert max(index.blocks) > 1
    near = vectors.nearest(v, "vec_id", "vec", v, "vec_id", "vec", 5)
    whole = index.nearest(v, "vec_id", "vec", 5, 20)
    assert one(vectors.recall_at(whole, near, 5)) == 1.0 and whole.count() == near.count()
    assert one(vectors.recall_at(index.nearest(v, "vec_id", "vec", 5, 10), near, 5)) >= 0.9
    assert vectors.CellIndex(v.limit(0), "vec_id", "vec").nearest(v, "vec_id", "vec", 5, 3).count() == 0


def test_quantiles_and_order_statistics(spark):
    from ledgerweave.plans.ordered import order_statistics, quantiles

    rng = random.Random(4)
    x = [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(999)]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(x)] + [(None, 0)], "x double, g int")
    want = np.quantile(x, [0, 0.1, 0.5, 0.95, 1]).tolist()
    assert quantiles(df, "x", [0, 0.1, 0.5, 0.95, 1], cells=9) == pytest.approx(want, abs=1e-12)
    assert quantiles(df, "x", [0.25], discrete=True, cells=5) == [sorted(x)[math.ceil(0.25 * 999) - 1]]
    assert quantiles(df.limit(0), "x", [0.5]) == [None]
    got = {(r.g, r["rank"]): r.value for r in order_statistics(df, "x", [1, 250, 5000], by=["g"], cells=7).collect()}
    assert got == {(g, k): sorted(x[g::2])[k - 1] for g in (0, 1) for k in (1, 250)}


def test_rerank(spark):
    v = spark.createDataFrame([(1, [0.0]), (2, [3.0]), (3, [1.0]), (4, [9.0])], "k int, v array<double>")
    short = spark.createDataFrame([(1, 4), (1, 2), (1, 3)], "l int, r int")
    assert [(r.l, r.r, r.dist, r["rank"]) for r in vectors.rerank(short, v, "k", "v", v, "k", "v", 2).orderBy("rank").collect()] == [(1, 3, 1.0, 1), (1, 2, 3.0, 2)]


def test_losses(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0])], "k long, v array<double>")
    want = math.log(math.e**2 + 2) - 2
    assert abs(one(losses.nt_xent(d, "k", "v", 0.5)) - want) < 1e-9
    agg = losses.neighbour_mean(spark.createDataFrame([(0, 3), (2, 3)], "src long, dst long"), d, "k", "v").first()
    assert agg.k == 3 and agg.agg == [0.5, 0.5]


def test_matrix(spark):
    df = spark.createDataFrame([([4.0, 2.0, 0.0, 6.0], [1.0, 0.0])], "distances array<double>, anchor_type_freqs array<double>")
    x, names = matrix.feature_matrix(df, 4, {"anchor_type_freqs": 2})
    assert names[:4] == ["d_1", "d_2", "d_3", "d_4"] and names[-1] == "anchor_source_diversity"
    assert x.first().features == pytest.approx([4, 2, 0, 6, 3, 0, 6, math.sqrt(5), 1.5, 3, 4.5, 1, 0, 1])
    assert one(df.select(matrix.haar_level2(F.col("distances")))) == [3.0, 0.0, 1.0, -3.0]
    with pytest.raises(ValueError):
        matrix.feature_matrix(df.drop("distances"), 4)
    assert one(df.select(matrix.sample_size(F.lit(0.05), 0.01))) == 1825
    assert one(df.select(matrix.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")))) == 1.0


def test_copula_is_independent_at_one(spark):
    assert abs(one(spark.range(1).select(fusion.copula_density("gumbel", F.lit(0.3), F.lit(0.7), F.lit(1.0)))) - 1) < 1e-12


def test_evidence(spark):
    for n in (1, 2, 3, 5, 8):
        leaves = spark.createDataFrame([(i, f"leaf{i}") for i in range(n)], "p int, t string")
        root = one(evidence.merkle_root(leaves, "p", "t"))
        for at in range(n):
            proof = [(r.sibling, r.left) for r in evidence.merkle_proof(leaves, "p", "t", at).orderBy("level").collect()] if n > 1 else []
            assert len(proof) == math.ceil(math.log2(n)) and evidence.verify_proof(f"leaf{at}".encode(), proof, root)
            assert not evidence.verify_proof(b"x", proof, root)
    x = spark.createDataFrame([("b" * 64 + " paid 5 BTC", "paid 5 BTC by " + "b" * 64), ("0xabcdef12 moved", "nothing")], "t string, c string")
    assert [r[0] for r in x.select(evidence.grounded(F.col("t"), F.col("c"))).collect()] == [True, False]
    c = spark.range(1).select(evidence.digest(evidence.canonical({"b": F.lit("2"), "a": F.lit("1"), "n": F.lit(None).cast("string")})))
    assert one(c) == hashlib.sha256(b'{"a":1,"b":2}').hexdigest()
    top = one(spark.range(1).select(evidence.top_contributions(F.array(F.lit(0.1), F.lit(-3.0), F.lit(2.0)), ["x", "y", "z"], 2)))
    assert top == {"y": -3.0, "z": 2.0}


def test_sanctions(spark, tmp_path):
    a = "4" + "A" * 94
    df = spark.createDataFrame([(1, f"Digital Currency Address - XMR {a}; alt. Digital Currency Address - XBT 1{'B' * 30};"), (2, None)], "k int, r string")
    assert [(r.pos, r.currency, r.address) for r in sanctions.ofac_addresses(df, "k", "r").collect()] == [(1, "XMR", a), (2, "BTC", "1" + "B" * 30)]
    low = spark.createDataFrame([(1, "alt.  Digital Currency Address -  eth   ab1; Digital Currency Address - TOOLONGCODEX zz; Digital Currency Address-ARB Q")], "k int, r string")
    assert [(r.currency, r.address) for r in sanctions.ofac_addresses(low, "k", "r").collect()] == [("ETH", "ab1"), ("ARB", "Q")]
    from ledgerweave.queries.risk import EU_BLOCKS

    got = sanctions.eu_addresses(spark.createDataFrame(list(EU_BLOCKS.items()), "k string, r string"), "k", "r").collect()
    boat, three, tron = "1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "TN3W4H6rK2ce4vX9YnFQHwKENnHjoxb3m9"
    assert sorted((r.k, r.line, r.currency, r.address) for r in got) == sorted([
        ("e1", 0, "LTC", "LhyLV9YvGeM3yQ5mRZkbPqKBmSvTmNkdW2"), ("e1", 1, "XRP", "rw2ciyaNshpHe7bCHo4bRWq6pqqynnWKQg"), ("e1", 1, "DOGE", "D8mFyXy1wE1oVb3kJvYvSPWYLwfHh6gYkW"),
        ("e2", 0, "ETH", "0x" + "1" * 40), ("e2", 1, "BTC", boat), ("e2", 2, "BTC", three),
        ("e3", 1, "ETH", "0x" + "2" * 40), ("e3", 2, "ETH", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq"),
        ("e4", 0, "TRX", tron), ("e4", 2, "BTC", "abc"), ("e4", 3, "BTC", boat),
    ])
    eth, btc = "0x" + "a" * 40, "1" + "C" * 30
    eu = spark.createDataFrame([(1, f"BTC: {btc}\n{'1' + 'D' * 30}\nETH: {eth}\n{'1' + 'E' * 30}")], "k int, r string")
    assert {(r.line, r.currency) for r in sanctions.eu_addresses(eu, "k", "r").collect()} == {(0, "BTC"), (1, "BTC"), (2, "ETH")}
    (tmp_path / "eu.xml").write_text(f"<x><sanctionEntity a='1'><remark>BTC: {btc}\nmore</remark></sanctionEntity><sanctionEntity/></x>")
    assert [(r.n_entities, r.block) for r in sanctions.read_eu_remarks(spark, str(tmp_path / "eu.xml")).collect()] == [(2, f"BTC: {btc}\nmore")]
    assert sanctions.read_pool(spark, str(tmp_path / "none.csv")).count() == 0
    sanctions.write_manifest(spark.createDataFrame([("eu.xml", "ab")], "file string, sha256 string"), str(tmp_path / "m"))
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.txt").write_text("data")
    sha = hashlib.sha256(b"data").hexdigest().upper()
    files = sanctions.read_manifest(spark, str(tmp_path / "m")).select("file", "sha256").unionByName(spark.createDataFrame([("x.txt", sha), ("x.txt", None)], "file string, sha256 string"))
    assert sorted((r.file, r.valid) for r in sanctions.manifest_valid(spark, files, str(tmp_path / "files")).collect()) == [("eu.xml", False), ("x.txt", False), ("x.txt", True)]
    (tmp_path / "p.csv").write_text("address,currency\n x ,BTC\n,ETH\n")
    assert [r.address for r in sanctions.read_pool(spark, str(tmp_path / "p.csv")).collect()] == ["x"]


def test_load_elliptic(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_elliptic(spark, str(tmp_path / "none"))
    (tmp_path / "elliptic_txs_features.csv").write_text("1,3.0," + ",".join(["0.5"] * 165) + "\n2,41.0," + ",".join(["0.5"] * 165) + "\n")
    (tmp_path / "elliptic_txs_classes.csv").write_text("txId,class\n1,1\n2,unknown\n")
    (tmp_path / "elliptic_txs_edgelist.csv").write_text("txId1,txId2\n1,2\n")
    tx, edges = load_elliptic(spark, str(tmp_path))
    assert {r.txId: r.split for r in with_split(tx, "time_step").collect()} == {1: "train", 2: "test"}
    assert [(r.txId, r.y) for r in labelled(tx).select("txId", "y").collect()] == [(1, 1)] and edges.count() == 1


def test_streaming_matches_batch(spark, tmp_path):
    from ledgerweave.streaming.steps import last_flagged, step_counts

    df = spark.createDataFrame([(i % 3, f"2024-01-0{1 + i % 4} 10:00:00", i % 5 == 0) for i in range(40)], "k long, ts string, f boolean").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, x, mode in (("a", step_counts(stream, "ts", "f"), "complete"), ("b", last_flagged(stream, "k", "ts", "f"), "update")):
        q = x.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(str(r.start)[:10], r.n) for r in spark.table("a").collect()} == {(f"2024-01-0{d}", 10) for d in range(1, 5)}
    assert sum(r.n for r in spark.table("b").collect()) == 40


def test_learning(spark):
    from ledgerweave.ml import models

    base = spark.range(600).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("b"))
    df = base.select("id", F.array("a", "b").alias("features"), (F.col("a") + 0.2 * F.col("b") > 0.6).cast("int").alias("y"))
    train, valid, test = df.filter("id % 3 = 0"), df.filter("id % 3 = 1"), df.filter("id % 3 = 2")
    pipe = models.RiskPipeline(["a", "b"], "id", rounds=5).fit(train, valid)
    m = pipe.evaluate(test).first()
    assert m.ap > 0.95 and m.auc > 0.95 and m.brier < 0.08
    row = pipe.predict(test).first()
    assert set(row.contributions) == {"a", "b"} and 0 <= row.calibrated <= 1
    for m in (models.fit_logistic(train), models.fit_forest(train, 5, 3)):
        x = models.metrics(models.score(m, test)).first()
        assert x.ap > test.agg(F.avg("y")).first()[0] + 0.2 and x.auc > 0.9
    focal = models.metrics(models.FocalBoost(6, 3, 0.3).fit(train).score(test)).first()
    assert focal.ap > 0.9 and focal.auc > 0.95
    z, e = 0.37, 1e-5
    loss = lambda z, y: (lambda q: -(0.25 if y else 0.75) * (1 - q) ** 2 * math.log(q))(1 / (1 + math.exp(-z if y else z)))
    got = spark.range(2).select("id", models.focal_gradient(F.lit(z), F.col("id"), 0.25, 2.0).alias("g")).collect()
    assert all(abs(r.g - (loss(z + e, r.id) - loss(z - e, r.id)) / (2 * e)) < 1e-6 for r in got)
    raw = models.score(pipe.model, valid)
    for how in (models.Isotonic, models.Beta, models.Sigmoid, lambda d: models.calibrate(d, "id")):
        x = models.metrics(how(raw).transform(models.score(pipe.model, test)), "calibrated").first()
        assert x.ap > 0.9 and x.brier < 0.15 and x.ece < 0.3
    assert models.metrics(models.score(models.fit_forest(train, 5, 3), test)).first().brier < 0.15


def test_shapley_values_against_all_coalitions(spark):
    import itertools

    from ledgerweave.ml import models

    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 4))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0.3) | (x[:, 3] > 1.5)).astype(int)
    df = spark.createDataFrame([(i, r.tolist(), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, features array<double>, y int")
    model = models.fit_gbt(df, 3, 4)
    trees = models.tree_nodes(model)

    def value(row, known, weight, nodes, at=0):
        f, t, left, right, v, rows = nodes[at]
        if f < 0:
            return weight * v
        if f in known:
            return value(row, known, weight, nodes, left if row[f] <= t else right)
        return sum(nodes[c][5] / rows * value(row, known, weight, nodes, c) for c in (left, right))

    got = {r.id: r.contributions for r in models.contributions(model, df.filter("id < 12"), "id").collect()}
    for i in range(12):
        v = {s: sum(value(x[i], set(s), w, n) for w, n in trees) for k in range(5) for s in itertools.combinations(range(4), k)}
        for j in range(4):
            others = [o for o in range(4) if o != j]
            want = sum(math.factorial(k) * math.factorial(3 - k) / 24 * (v[tuple(sorted((*s, j)))] - v[s]) for k in range(4) for s in itertools.combinations(others, k))
            assert abs(got[i][j] - want) < 1e-9


@pytest.mark.parametrize("beta", [0.001, 0.3, 1.0, 40.0])
def test_hawkes_of_any_decay(spark, beta):
    import math

    rng = random.Random(1)
    n = [rng.randint(0, 5) for _ in range(1500)]
    got = {r.t: r.hawkes for r in series.hawkes(spark.createDataFrame(list(enumerate(n, 1)), "t int, n long"), 0.5, beta).collect()}
    run = 0.0
    for t in range(1, 1501):
        assert abs(got[t] - (sum(n) / 1500 + 0.5 * run)) < 1e-9 * (1 + got[t])
        run = math.exp(-beta) * (run + n[t - 1])


def test_rounds_that_do_not_settle_are_errors(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src int, dst int")
    with pytest.raises(RuntimeError):
        graphs.components(chain, max_rounds=1)
    with pytest.raises(RuntimeError):
        graphs.pagerank(chain, rounds=2)
    assert {r.component for r in graphs.components(chain).collect()} == {0}


def test_pagerank_to_tolerance(spark, sf):
    from ledgerweave.queries import risk

    pairs = [(r.src, r.dst) for r in risk._edges(spark, sf).collect()]
    nodes = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for x, y in pairs:
        a[at[y], at[x]] += 1
    out = a.sum(0)
    a /= np.maximum(out, 1)
    r = np.full(len(nodes), 1 / len(nodes))
    for _ in range(300):
        r = 0.15 / len(nodes) + 0.85 * (a @ r + r[out == 0].sum() / len(nodes))
    got = {x.node: x.rank for x in risk.QUERIES["r090_pagerank"](spark, sf).collect()}
    assert got.keys() == set(nodes) and sum(abs(got[x] - r[at[x]]) for x in nodes) < len(nodes) * 1e-5


def test_comention_of_a_crowded_article(spark):
    m = spark.createDataFrame([(1, i) for i in range(60)] + [(2, 0), (2, 1), (None, 3)], "x int, e int")
    got = {(r.a, r.b): r.weight for r in graphs.comention(m, "x", "e", salts=4).collect()}
    assert len(got) == 60 * 59 // 2 and got[0, 1] == 2 and got[3, 9] == 1


def test_sinks(spark, tmp_path):
    from pyspark.errors import AnalysisException, ParseException

    from ledgerweave.sources import sinks

    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "c")], "cluster_id long, node string")
    rows = sorted(map(tuple, df.collect()))
    sinks.write_clusters(df, str(tmp_path / "c"))
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.write_metrics(df, str(tmp_path / "m"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "c")).collect())) == rows
    assert sorted(map(tuple, spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "csv")).collect())) == rows
    assert sorted((r.cluster_id, r.node) for r in spark.read.json(str(tmp_path / "m")).collect()) == rows
    assert sinks.create_iceberg(spark, "lw_test_iceberg", "a int") is False
    with pytest.raises((AnalysisException, ParseException)):
        sinks.create_iceberg(spark, "lw_test_iceberg", "a nonsense_type_x")


def test_staged_tables_are_cleared(spark, sf, monkeypatch):
    from pathlib import Path

    from ledgerweave.plans import staging
    from ledgerweave.queries import registry

    roots = []
    make = staging.Stage.__init__
    monkeypatch.setattr(staging.Stage, "__init__", lambda self, s: (make(self, s), roots.append(self.root))[0])
    for name in ("p1_found", "p5_found", "p6_found", "r051_select_tau", "r094_components"):
        with staging.clearing(spark):
            registry.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            assert any(Path(r.removeprefix("file:")).exists() for r in roots)
        assert roots and not any(Path(r.removeprefix("file:")).exists() for r in roots)


def test_candidates_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 400
    z, w = rng.standard_normal(n), rng.standard_normal(n)
    x = z + 0.5 * rng.standard_normal(n)
    y = 0.8 * x + z + rng.standard_normal(n)
    df = spark.createDataFrame([(i, float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(y, x, z, w))], "id long, y double, x double, z double, w double")
    got = {(r.name, r.edge): r for r in stats.evaluate_candidates(df, "y", ["x"], ["z", "w"], {"none": [], "z": ["z"]}, F.col("id"), replicates=30).collect()}
    assert abs(got["none", "x"].r - np.corrcoef(x, y)[0, 1]) < 1e-9
    a, b = (v - np.polyval(np.polyfit(z, v, 1), z) for v in (x, y))
    assert abs(got["z", "x"].r - np.corrcoef(a, b)[0, 1]) < 1e-9
    assert not got["z", "x"].rejected and got["none", "z"].rejected and not got["z", "w"].rejected and ("z", "z") not in got
    assert got["z", "x"].p_low <= got["z", "x"].p_high < 0.05 and {k for _, k in got} == {"x", "z", "w", "placebo"}


def test_merkle_folds_and_chains(spark):
    n = 37
    leaves = spark.createDataFrame([(i, f"leaf{i}") for i in range(n)], "p int, t string")
    level = [hashlib.sha256(f"leaf{i}".encode()).digest() for i in range(n)]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
    for fold in (1, 2, 3, 10):
        assert one(evidence.merkle_root(leaves, "p", "t", fold)) == level[0].hex()
    proof = [(r.sibling, r.left) for r in evidence.merkle_proof(leaves, "p", "t", 36, 2).orderBy("level").collect()]
    assert evidence.verify_proof(b"leaf36", proof, level[0].hex())
    assert evidence.merkle_root(leaves.limit(0), "p", "t").first().root is None
    rows = [("a", i, None if i == 3 else f"x{i}") for i in range(50)] + [("b", 1, "y"), (None, 1, "z")]
    got = {(r.s, r.o): r.chain for r in evidence.chained(spark.createDataFrame(rows, "s string, o int, p string"), "s", "o", "p").collect()}
    for s in ("a", "b", None):
        h = "genesis"
        for _, o, p in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            h = hashlib.sha256(f"{h}|{p or ''}".encode()).hexdigest()
            assert got[s, o] == h


@pytest.mark.parametrize("step", [1.0, 1e-4, 1e-13])
def test_explained_pairs_near_the_threshold(spark, step):
    """Rounding decides no pair: distances are off the threshold by much, by little and by next to nothing."""
    eps, hub, n = 5.0, 0, 40
    vec = {hub: [0.0, 0.0, 0.3], 99: [1.0, 1.0, float("inf")], 98: [float("nan")] * 3} | {i: [eps + (i - n // 2) * step, 0.1 * i, 0.3] for i in range(1, n)}
    edges = [(hub, i) for i in vec if i != hub] + [(i, i % (n - 1) + 1) for i in range(1, n)] + [(99, 1), (1, 99), (98, 1), (5, 500), (500, 600)]
    rows = [(k, 1, [9.0, 9.0, 9.0]) for k in (1, 2, hub)] + [(k, None, [7.0] * 3) for k in (3, hub)] + [(k, 2, v) for k, v in vec.items()] + [(None, 1, [0.0] * 3)]
    e = spark.createDataFrame(edges, "src long, dst long")
    got = graphs.explained_pairs(e, e, spark.createDataFrame([(hub,)], "node long"), spark.createDataFrame(rows, "k long, version int, v array<double>"), "k", "v", eps, "version").collect()
    near = {x for a, b in edges for x, y in ((a, b), (b, a)) if y == hub}
    apart = lambda a, b: math.sqrt(sum((p - q) ** 2 for p, q in zip(vec[a], vec[b])))
    want = {(a, b): (a in near and b in near, a in near and b in near and abs(apart(a, b) - apart(hub, b)) < eps) for a, b in edges if a in vec and b in vec}
    assert {(r.src, r.dst): (r.confounded, r.explained) for r in got} == want and all(r.passed != r.explained for r in got) and len(got) == len(want)
    assert {x for c, x in want.values() if c} == {True, False}


def test_explained_pairs_move_no_vectors_they_do_not_need(spark, monkeypatch):
    """Vectors are staged rounded, of confounded pairs only; whole ones only where rounding leaves the answer open."""
    staged = []
    from ledgerweave.plans.staging import Stage

    write = Stage.write
    monkeypatch.setattr(Stage, "write", lambda self, df, by=None: staged.append((df.schema, n := write(self, df, by), n.count())) or n)
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 2), *[(i, i + 1) for i in range(10, 400)]], "src long, dst long")
    v = spark.range(401).select(F.col("id").alias("k"), F.array(*[(F.col("id") % 7 + j).cast("double") for j in range(3)]).alias("v"))
    assert graphs.explained_pairs(e, e, spark.createDataFrame([(0,)], "node long"), v, "k", "v", 5.0).filter("confounded").count() == 1
    kinds = [(s["x"].dataType["v"].dataType.elementType.typeName(), n) for s, _, n in staged if "x" in s.names and s["x"].dataType.typeName() == "struct"]
    assert kinds and all(k == "byte" and n <= 40 for k, n in kinds)


def test_weights_of_a_batch_equal_those_of_rows(spark):
    texts = [None, "", "é|1", "x" * 52, "x" * 53, "x" * 60, "y" * 130, *[f"{i * 37}-{i}" for i in range(300)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, k string").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(101))))
    want = {(r.i, r.r): r.w for r in rows.select("i", "r", stats.poisson_weight(F.col("k"), F.col("r")).alias("w")).collect()}
    got = stats.poisson_weights(pa.array(texts), 101)
    assert all(got[r - 1, i] == w for (i, r), w in want.items()) and (got[:, 5:9] == stats.poisson_weights(pa.array(texts).slice(5, 4), 101)).all()
    assert stats.poisson_weights(pa.array([], pa.string()), 3).shape == (3, 0)


def test_candidates_of_many_rows_in_time(spark):
    """All 20 replicates over 400,000 rows; row by row they took minutes."""
    n = 400_000
    df = spark.range(0, n, 1, 4).select("id", *[((F.col("id") * k) % 10_007).cast("double").alias(c) for k, c in ((7919, "y"), (104_729, "x"), (31, "z"))])
    began = time.monotonic()
    got = stats.evaluate_candidates(df, "y", ["x"], ["z"], {"none": [], "z": ["z"]}, F.col("id"), replicates=20).collect()
    assert time.monotonic() - began < 40
    i = np.arange(n)
    y, x = (i * k % 10_007 for k in (7919, 104_729))
    w = stats.poisson_weights(pa.array([str(k) for k in i]), 20)
    p = [stats._partial(float(v.sum()), np.cov(np.stack([y, x]).astype(float), fweights=v, ddof=0) * v.sum(), 1, 0, [])[1] for v in w]
    one = next(r for r in got if (r.name, r.edge) == ("none", "x"))
    assert abs(one.r - np.corrcoef(x, y)[0, 1]) < 1e-9 and np.allclose([one.p_low, one.p_high], np.quantile(p, [0.025, 0.975]), atol=1e-7)


def test_present_edges_need_no_replicates(spark, sf, monkeypatch):
    from ledgerweave.queries import audits

    made, moments = [], stats.weighted_moments
    monkeypatch.setattr(stats, "weighted_moments", lambda df, columns, key, replicates, *a: made.append(replicates) or moments(df, columns, key, replicates, *a))
    b = {(r.name, r.edge): r.r for r in audits.r148b_present_edges(spark, sf).collect()}
    assert made == [0]
    assert b == {(r.name, r.edge): round(r.r, 7) for r in audits.r148_evaluate_candidates(spark, sf).filter("kind = 'present' and name != 'C'").collect()} and made == [0, 20]


def test_gap_interval_of_many_rows_in_time_and_of_null_keys(spark, tmp_path):
    """Weights of 20 replicates over a million rows; a row without a whole key weighs nothing, as in SQL."""
    import duckdb

    from ledgerweave.queries import audits

    big = spark.range(0, 1_000_000, 1, 4).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 7 < 2).cast("int").alias("p"), (F.col("id") % 2).cast("string").alias("g"))
    began = time.monotonic()
    r = curves.rate_gap_interval(big, "y", "p", "g", F.col("id"), 20).first()
    assert time.monotonic() - began < 25 and 0 <= r.tpr_lo <= r.tpr_hi < 0.01
    rows = [(i, i * 7 if i % 3 else None, 1, float(i), "R" if i % 2 else "N" if i % 5 else None, ("F", "O", None)[i % 4 % 3]) for i in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string").selectExpr("*", "double(1) l_quantity", "timestamp'2020-01-01' l_shipdate").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert np.allclose(list(audits.r060b_gap_interval(spark, str(tmp_path)).first()), con.execute(audits.SQL["r060b_gap_interval"]).fetchone(), atol=1e-9)
