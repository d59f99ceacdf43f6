"""Further queries: era joins, hub overlap, pivots, selection rules, samples and slices."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerweave.operators import curves, density, fusion, graphs, matrix, stats, vectors
from ledgerweave.plans.ordered import quantiles, running_totals
from ledgerweave.queries.risk import DEGREES, EDGES, SCORED, STEPS, VEC, _edges, _events, _vec, scored
from ledgerweave.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT DISTINCT src, dst FROM (SELECT txId1 src, txId2 dst FROM elliptic_txs_edgelist) WHERE src IS NOT NULL AND dst IS NOT NULL AND ('0x' || substr(md5(src || '|' || dst), 1, 8))::BIGINT % 100 < 80")
def r033b_drop_edges(spark, sf_dir):
    """Edges kept with probability 0.8, by a hash of the edge (the sampling is the operator)."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("src").cast("string"), F.col("dst").cast("string"))), 1, 8), 16, 10).cast("long")
    return _edges(spark, sf_dir).filter(F.pmod(h, F.lit(100)) < 80)


@query(f"WITH t AS (SELECT DISTINCT txId FROM elliptic_txs_features WHERE time_step <= 30) SELECT src, dst FROM {EDGES} WHERE src IN (SELECT txId FROM t WHERE txId IS NOT NULL) AND dst IN (SELECT txId FROM t WHERE txId IS NOT NULL)")
def r045_era_graph(spark, sf_dir):
    t = table(spark, sf_dir, "elliptic_txs_features").filter("time_step <= 30").select("txId").distinct()
    return _edges(spark, sf_dir).join(t.withColumnRenamed("txId", "src"), "src", "left_semi").join(t.withColumnRenamed("txId", "dst"), "dst", "left_semi").select("src", "dst")


@query(f"""WITH q AS (SELECT quantile_cont(in_degree + out_degree, 0.999) q FROM {DEGREES}), h AS (SELECT node FROM {DEGREES}, q WHERE in_degree + out_degree >= q),
n AS (SELECT src x, dst h FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), b AS (SELECT x, h FROM n WHERE h IN (SELECT node FROM h))
SELECT e.src, e.dst, count(DISTINCT a.h) shared_hubs FROM {EDGES} e JOIN b a ON a.x = e.src JOIN b c ON c.x = e.dst AND c.h = a.h GROUP BY e.src, e.dst""")
def r046_shared_hubs(spark, sf_dir):
    """Edges whose two ends neighbour a common hub, with the number of such hubs."""
    e = _edges(spark, sf_dir)
    d = graphs.degrees(e)
    q = d.agg(F.expr("percentile(total_degree, 0.999)").alias("q"))
    hubs = d.join(F.broadcast(q)).filter("total_degree >= q").select(F.col("node").alias("h"))
    near = e.select(F.col("src").alias("x"), F.col("dst").alias("h")).unionByName(e.select(F.col("dst").alias("x"), F.col("src").alias("h"))).distinct().join(hubs, "h", "left_semi")
    a, b = near.select(F.col("x").alias("src"), "h"), near.select(F.col("x").alias("dst"), "h")
    return e.join(a, "src").join(b, ["dst", "h"]).groupBy("src", "dst").agg(F.countDistinct("h").alias("shared_hubs"))


@query("SELECT day(ts)::INTEGER d, count(*) FILTER (WHERE event_type = 'click') click, count(*) FILTER (WHERE event_type = 'error') error, count(*) FILTER (WHERE event_type = 'purchase') purchase, count(*) FILTER (WHERE event_type = 'signup') signup, count(*) FILTER (WHERE event_type = 'view') AS view, count(DISTINCT user_id) users, arg_min(event_type, (value, event_id)) cheapest FROM events GROUP BY 1")
def r049_crosstab(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.dayofmonth("ts"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    return e.groupBy("d").agg(*[F.count(F.when(F.col("event_type") == k, 1)).alias(k) for k in kinds], F.countDistinct("user_id").alias("users"), F.min_by("event_type", F.struct("value", "event_id")).alias("cheapest"))


@query(f"WITH {STEPS}, k AS (SELECT score tau, cn alerts, 1.0 * (cn - cp) + 20.0 * (ap - cp) AS cost FROM c UNION ALL SELECT 1.0, 0, 20.0 * max(ap) FROM c) SELECT round(tau, 9) tau, cost::DOUBLE AS cost FROM k ORDER BY cost, tau DESC LIMIT 1")
def r052_select_tau_star(spark, sf_dir):
    """Least cost among the distinct scores and 1.0; ties keep the larger threshold."""
    c = curves.cost_curve(curves.score_steps(scored(spark, sf_dir), "score", "y"), 1.0, 20.0).select("tau", "cost")
    none = scored(spark, sf_dir).agg(F.lit(1.0).alias("tau"), (20.0 * F.sum("y")).alias("cost"))
    x = c.unionByName(none).agg(F.min_by(F.struct("tau", "cost"), F.struct("cost", (-F.col("tau")).alias("t"))).alias("x")).select("x.*")
    return x.select(F.round("tau", 9).alias("tau"), "cost")


_CANDIDATES = "(SELECT grp || step AS name, count(*) FILTER (WHERE y = 1 AND score >= 0.5) rejections, count(*) edges FROM " + SCORED + " GROUP BY grp, step)"


@query(f"SELECT name, rejections, edges FROM {_CANDIDATES} ORDER BY rejections, edges, name LIMIT 1")
def r079_select_candidate(spark, sf_dir):
    """Fewest rejections, then fewest edges, then name."""
    hit = F.count(F.when((F.col("y") == 1) & (F.col("score") >= 0.5), 1))
    return scored(spark, sf_dir).groupBy(F.concat("grp", F.col("step").cast("string")).alias("name")).agg(hit.alias("rejections"), F.count(F.lit(1)).alias("edges")).orderBy("rejections", "edges", "name").limit(1)


@query(f"WITH m AS (SELECT grp AS name, round(avg(y), 9) ap, round(abs(avg(score) - avg(y)), 9) ece, round(avg((score - y) * (score - y)), 9) brier, length(grp)::INTEGER rank FROM {SCORED} GROUP BY grp) SELECT * FROM m ORDER BY ap DESC, ece, brier, rank, name LIMIT 1")
def r080_select_model(spark, sf_dir):
    d = F.col("score") - F.col("y")
    m = scored(spark, sf_dir).groupBy(F.col("grp").alias("name")).agg(F.round(F.avg("y"), 9).alias("ap"), F.round(F.abs(F.avg("score") - F.avg("y")), 9).alias("ece"), F.round(F.avg(d * d), 9).alias("brier"), F.first(F.length("grp")).alias("rank"))
    return fusion.select_model(m)


@query(f"""WITH d AS (SELECT a.vec_id l, b.label c, a.label own, avg(list_distance(a.vec, b.vec)) m FROM {VEC} a JOIN {VEC} b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3), p AS (SELECT l, min(m) FILTER (WHERE c = own) a, min(m) FILTER (WHERE c <> own) b FROM d GROUP BY l)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) silhouette FROM p""")
def r084_silhouette(spark, sf_dir):
    return density.silhouette(_vec(spark, sf_dir), "vec_id", "vec", "label").select(F.round("silhouette", 6).alias("silhouette"))


_GRID = "(SELECT row_number() OVER (ORDER BY m, q) - 1 setting, m, q FROM (SELECT unnest([3, 5, 10, 20, 30, 40, 50]) m), (SELECT unnest([0.80, 0.85, 0.90, 0.95, 0.98]) q) WHERE m <= (SELECT count(*) // 2 FROM embeddings))"


@query(f"""WITH RECURSIVE d AS MATERIALIZED (SELECT a.vec_id l, b.vec_id r, list_distance(a.vec, b.vec) dist FROM {VEC} a, {VEC} b), k AS MATERIALIZED (SELECT l, dist, row_number() OVER (PARTITION BY l ORDER BY dist) k FROM d),
s AS MATERIALIZED (SELECT setting, m, q, (SELECT list_sort(list(dist))[ceil(q * count(*) - 1e-9)::BIGINT] FROM k WHERE k.k = g.m) eps FROM {_GRID} g),
n AS MATERIALIZED (SELECT setting, m, l, r FROM d JOIN s ON dist <= eps + 1e-12), core AS MATERIALIZED (SELECT setting, l FROM n GROUP BY setting, m, l HAVING count(*) >= m),
e AS MATERIALIZED (SELECT n.setting, n.l a, n.r b FROM n JOIN core x ON x.setting = n.setting AND x.l = n.l JOIN core y ON y.setting = n.setting AND y.l = n.r),
t(setting, v, u) AS (SELECT setting, l, l FROM core UNION SELECT t.setting, e.b, t.u FROM t JOIN e ON e.setting = t.setting AND e.a = t.v WHERE t.u < e.b), c AS MATERIALIZED (SELECT setting, v, min(u) c FROM t GROUP BY setting, v),
b AS (SELECT n.setting, n.l, min(c.c) b FROM n JOIN c ON c.setting = n.setting AND c.v = n.r GROUP BY n.setting, n.l),
f AS MATERIALIZED (SELECT s.setting, v.label y, coalesce(c.c, b.b, -1) c FROM s JOIN embeddings v ON true LEFT JOIN c ON c.setting = s.setting AND c.v = v.vec_id LEFT JOIN b ON b.setting = s.setting AND b.l = v.vec_id),
tp AS (SELECT setting, sum(n * (n - 1) // 2) tp FROM (SELECT setting, count(*) n FROM f WHERE c <> -1 GROUP BY setting, y, c) GROUP BY setting), cl AS (SELECT setting, sum(n * (n - 1) // 2) called, count(*) k FROM (SELECT setting, count(*) n FROM f WHERE c <> -1 GROUP BY setting, c) GROUP BY setting),
sm AS (SELECT setting, sum(n * (n - 1) // 2) same FROM (SELECT setting, count(*) n FROM f GROUP BY setting, y) GROUP BY setting), no AS (SELECT setting, avg((c = -1)::INTEGER) noise FROM f GROUP BY setting),
x AS (SELECT s.setting::INTEGER setting, m min_pts, q, round(eps, 6) eps, coalesce(tp, 0)::BIGINT tp, (coalesce(called, 0) - coalesce(tp, 0))::BIGINT fp, (same - coalesce(tp, 0))::BIGINT fn, coalesce(k, 0) n_clusters, round(noise, 9) noise FROM s JOIN sm USING (setting) JOIN no USING (setting) LEFT JOIN tp USING (setting) LEFT JOIN cl USING (setting))
SELECT setting, min_pts::INTEGER min_pts, q::DOUBLE q, eps, tp, fp, fn, (fp + 2.0 * fn)::DOUBLE AS cost, n_clusters, noise, setting = (SELECT arg_min(setting, (fp + 2.0 * fn, setting)) FROM x) chosen FROM x""")
def r096b_choose_parameters(spark, sf_dir):
    """Pair costs of density clustering over the whole grid, against the labels; the first least cost is chosen."""
    x = density.choose_parameters(_vec(spark, sf_dir), "vec_id", "vec", "label", 1.0, 2.0)
    return x.withColumn("eps", F.round("eps", 6)).withColumn("noise", F.round("noise", 9))


@query(f"""WITH u AS (SELECT src a, dst b FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), d AS (SELECT a node, count(*) degree FROM u GROUP BY a), s AS (SELECT time_step t, count(*) n FROM elliptic_txs_features GROUP BY time_step), f AS (SELECT txId, min(time_step) t FROM elliptic_txs_features GROUP BY txId)
SELECT node, degree, degree >= (SELECT quantile_cont(degree, 0.95) FROM d) hub, coalesce(n, 0) step_rows FROM d LEFT JOIN f ON f.txId = d.node LEFT JOIN s ON s.t = f.t""")
def r101_confounders(spark, sf_dir):
    """Undirected degree, hub flag and activity of the node's step."""
    e, f = _edges(spark, sf_dir), table(spark, sf_dir, "elliptic_txs_features")
    u = e.select(F.col("src").alias("node"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("b"))).distinct()
    d = u.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    q = d.agg(F.expr("percentile(degree, 0.95)").alias("q"))
    steps = f.groupBy(F.col("time_step").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    at = f.groupBy(F.col("txId").alias("node")).agg(F.min("time_step").alias("t"))
    x = d.join(F.broadcast(q)).join(at, "node", "left").join(F.broadcast(steps), "t", "left")  # one row per step
    return x.select("node", "degree", (F.col("degree") >= F.col("q")).alias("hub"), F.coalesce("n", F.lit(0)).alias("step_rows"))


@query(f"WITH x AS (SELECT vec_id, label, step, CASE WHEN step <= 30 THEN 'train' WHEN step <= 40 THEN 'valid' ELSE 'test' END era FROM {VEC}), p AS (SELECT a.vec_id a, b.vec_id b, (a.label = b.label)::INTEGER same FROM x a JOIN x b ON a.step = b.step AND a.era = b.era AND a.vec_id < b.vec_id) SELECT a, b, same FROM p QUALIFY row_number() OVER (PARTITION BY same ORDER BY md5('72|' || a || '|' || b), a, b) <= 200")
def r103_sample_pairs(spark, sf_dir):
    """Equal numbers of like and unlike pairs of one step, chosen by hash (the sampling is the operator)."""
    v = _vec(spark, sf_dir)
    a, b = v.select("step", F.col("vec_id").alias("a"), F.col("label").alias("la")), v.select("step", F.col("vec_id").alias("b"), F.col("label").alias("lb"))
    p = a.join(b, "step").filter("a < b").select("a", "b", (F.col("la") == F.col("lb")).cast("int").alias("same"))
    w = W.partitionBy("same").orderBy(F.md5(F.concat_ws("|", F.lit("72"), F.col("a").cast("string"), F.col("b").cast("string"))), "a", "b")
    return p.withColumn("r", F.row_number().over(w)).filter("r <= 200").drop("r")


@query(f"WITH d AS (SELECT a.vec_id q, b.vec_id anchor, list_distance(a.vec, b.vec) dist FROM {VEC} a, {VEC} b WHERE b.label = 0) SELECT q, anchor, round(dist, 6) dist FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, anchor) <= 3")
def r108_with_fallback(spark, sf_dir):
    """Nearest sanctioned anchors, or those of the training era where there are none: chosen once for the pool."""
    v = _vec(spark, sf_dir)
    first, second = v.filter("label = 0"), v.filter("label = 1 and step <= 30")
    pool = second if first.isEmpty() else first
    return vectors.nearest(v, "vec_id", "vec", pool, "vec_id", "vec", 3).select(F.col("l").alias("q"), F.col("r").alias("anchor"), F.round("dist", 6).alias("dist"))


_U = "((((({0}) * 7919 + 2232) % 1000003) * (((({0}) * 7919 + 2232) % 1000003) + 1) + 12345) % 1000003)"


@query(f"""WITH d AS (SELECT node, pow(in_degree + out_degree, -0.75) w FROM {DEGREES}), c AS (SELECT node, sum(w) OVER (ORDER BY node) / (SELECT sum(w) FROM d) hi, w / (SELECT sum(w) FROM d) p FROM d),
u AS (SELECT draw, list_transform([{_U.format('draw % 1000003')}], lambda x: ((x * x + x + 54321) % 1000003))[1] x FROM range(2000) t(draw)), v AS (SELECT draw, ((x * x + x + 777) % 1000003) / 1000003.0::DOUBLE u FROM u)
SELECT draw, c.node FROM v ASOF JOIN c ON v.u < c.hi""")
def r116_sample_negatives(spark, sf_dir):
    """Draws with replacement in proportion to degree ** -0.75: hashed uniforms looked up among cumulated weights, cell by cell."""
    d = vectors.sampling_probabilities(graphs.degrees(_edges(spark, sf_dir)), "total_degree", 0.75).select("node", "p")
    hi = running_totals(d, "node", ["p"]).select("node", (F.col("cum_p") - F.col("p")).alias("lo"), F.col("cum_p").alias("hi"))
    draws = spark.range(2000).select(F.col("id").alias("draw"), matrix.hashed_unit(F.col("id"), F.lit(0), 72).alias("u")).withColumn("cell", F.floor(F.col("u") * 256).cast("int"))
    cells = hi.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * 256).cast("int"), F.floor(F.col("hi") * 256).cast("int"))))
    return draws.join(cells, "cell").filter("u >= lo and u < hi").select("draw", "node")


@query(f"WITH d AS (SELECT a.vec_id q, b.vec_id n, a.label la, b.label lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.vec, b.vec), b.vec_id) r FROM {VEC} a, {VEC} b WHERE a.vec_id <> b.vec_id) SELECT q, n FROM d WHERE r <= 10 AND la <> lb")
def r118_neighbour_negatives(spark, sf_dir):
    """Neighbours of another label among the ten nearest."""
    v = _vec(spark, sf_dir)
    n = vectors.nearest(v, "vec_id", "vec", v, "vec_id", "vec", 10, exclude_self=True).select(F.col("l").alias("q"), F.col("r").alias("n"))
    lab = v.select("vec_id", "label")
    return n.join(lab.toDF("q", "la"), "q").join(lab.toDF("n", "lb"), "n").filter("la != lb").select("q", "n")


@query(f"""WITH s AS (SELECT avg(vec[1]) m1, stddev_samp(vec[1]) s1, avg(vec[2]) m2, stddev_samp(vec[2]) s2 FROM {VEC} WHERE step <= 30)
SELECT CASE WHEN step <= 30 THEN 'train' WHEN step <= 40 THEN 'valid' ELSE 'test' END era, count(*) n, round(corr((vec[1] - m1) / s1, (vec[2] - m2) / s2), 6) r, round(avg(abs((vec[1] - m1) / s1)), 6) z FROM {VEC}, s GROUP BY 1""")
def r149_pass_by_era(spark, sf_dir):
    """Association per era of values standardised by the training era."""
    v = _vec(spark, sf_dir).select("step", F.get("vec", F.lit(0)).alias("a"), F.get("vec", F.lit(1)).alias("b"))
    s = v.filter("step <= 30").agg(F.avg("a").alias("m1"), F.stddev_samp("a").alias("s1"), F.avg("b").alias("m2"), F.stddev_samp("b").alias("s2"))
    x = v.join(F.broadcast(s)).select(vectors.era_of(F.col("step"), 30).alias("era"), F.expr("(a - m1) / s1").alias("x"), F.expr("(b - m2) / s2").alias("y"))
    return x.groupBy("era").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("r"), F.round(F.avg(F.abs("x")), 6).alias("z"))


@query(f"""WITH d AS (SELECT a.vec_id q, b.vec_id n, a.vec x, b.vec y FROM {VEC} a, {VEC} b WHERE a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.vec, b.vec), b.vec_id) <= 3),
p AS (SELECT q, n, unnest(x) x, unnest(y) y FROM d), c AS (SELECT q, n, corr(x, y) r FROM p GROUP BY q, n) SELECT q, round(max(1 + 2 * abs(r)), 6) gamma_max, round(avg(r), 6) r_mean FROM c GROUP BY q""")
def r151_sensitivity_block(spark, sf_dir):
    """Correlation of each row with its three nearest, over the places of the vectors."""
    v = _vec(spark, sf_dir)
    n = vectors.nearest(v, "vec_id", "vec", v, "vec_id", "vec", 3, exclude_self=True).select("l", "r")
    x = n.join(v.select(F.col("vec_id").alias("l"), F.col("vec").alias("x")), "l").join(v.select(F.col("vec_id").alias("r"), F.col("vec").alias("y")), "r")
    p = x.select("l", "r", F.explode(F.arrays_zip("x", "y")).alias("z")).groupBy("l", "r").agg(F.corr("z.x", "z.y").alias("c"))
    return p.groupBy(F.col("l").alias("q")).agg(F.round(F.max(matrix.sensitivity(F.col("c"))[1]), 6).alias("gamma_max"), F.round(F.avg("c"), 6).alias("r_mean"))


@query(f"WITH q AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) e FROM {SCORED}) SELECT len(list_filter(e, lambda x: x < score))::INTEGER AS bin, count(*) n, round(avg(y), 9) rate FROM {SCORED}, q GROUP BY 1")
def r156_decile_reliability(spark, sf_dir):
    s = scored(spark, sf_dir)
    e = F.array(*[F.lit(x) for x in quantiles(s, "score", [i / 10 for i in range(1, 10)])])
    return s.groupBy(F.size(F.filter(e, lambda x: x < F.col("score"))).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 9).alias("rate"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) d FROM events), s AS (SELECT user_id, avg(d / 1e6) m, stddev_pop(d / 1e6) s FROM g WHERE d IS NOT NULL GROUP BY user_id)
SELECT user_id, round(CASE WHEN s + m > 0 THEN (s - m) / (s + m) ELSE 0 END, 6) burstiness FROM s""")
def r201_gap_burstiness(spark, sf_dir):
    """Burstiness over the gaps between a user's events."""
    e = _events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    g = e.withColumn("d", (F.col("us") - F.lag("us").over(W.partitionBy("user_id").orderBy("ts", "event_id"))) / 1e6).filter("d is not null")
    s = g.groupBy("user_id").agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("s"))
    return s.select("user_id", F.round(F.when(F.col("s") + F.col("m") > 0, F.expr("(s - m) / (s + m)")).otherwise(0.0), 6).alias("burstiness"))


@query("SELECT txId1 node, count(*) moves, count(DISTINCT txId2) peers, round(count(DISTINCT txId2) / count(*), 9) diversity, count(DISTINCT load_id) loads FROM elliptic_txs_edgelist WHERE txId1 IS NOT NULL AND txId2 IS NOT NULL GROUP BY txId1")
def r202_counterparties(spark, sf_dir):
    """Counterparty diversity of a sender: distinct peers over moves."""
    e = table(spark, sf_dir, "elliptic_txs_edgelist").filter("txId1 is not null and txId2 is not null")
    x = e.groupBy(F.col("txId1").alias("node")).agg(F.count(F.lit(1)).alias("moves"), F.countDistinct("txId2").alias("peers"), F.countDistinct("load_id").alias("loads"))
    return x.select("node", "moves", "peers", F.round(F.col("peers") / F.col("moves"), 9).alias("diversity"), "loads")


@query(f"SELECT grp, id, l_partkey FROM {SCORED} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY md5('audit|' || id || '|' || l_partkey), id, l_partkey) <= 100")
def r203_audit_sample(spark, sf_dir):
    """A hundred rows per stratum, chosen by hash (the sampling is the operator)."""
    w = W.partitionBy("grp").orderBy(F.md5(F.concat_ws("|", F.lit("audit"), F.col("id").cast("string"), F.col("l_partkey").cast("string"))), "id", "l_partkey")
    return scored(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r <= 100").select("grp", "id", "l_partkey")
