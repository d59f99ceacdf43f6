"""Queries of the risk-analytics operators over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from ledgerweave.functions.dates import spelled_date
from ledgerweave.operators import curves, density, evidence, fusion, graphs, matrix, series, stats, vectors
from ledgerweave.plans.ordered import ordinal_rank
from ledgerweave.sources import sanctions
from ledgerweave.sources.elliptic import labelled, with_split
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


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a scored, labelled row: the stand-in for a model's output on labelled data."""
    x = table(spark, sf_dir, "lineitem")
    score = F.pmod(F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit(10007)).cast("double") / 10007
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", score.alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_linestatus").alias("grp"), F.month("l_shipdate").alias("step"), F.col("l_quantity").alias("qty"))


SCORED = "(SELECT l_orderkey * 10 + l_linenumber id, l_partkey, ((round(l_extendedprice * 100)::BIGINT % 10007)::DOUBLE / 10007) score, (l_returnflag = 'R')::INTEGER y, l_linestatus grp, month(l_shipdate)::INTEGER step, l_quantity qty FROM lineitem)"
STEPS = f"s AS (SELECT score, count(*) n, sum(y) pos FROM {SCORED} GROUP BY score), c AS (SELECT *, sum(n) OVER w cn, sum(pos) OVER w cp, sum(n) OVER () an, sum(pos) OVER () ap FROM s WINDOW w AS (ORDER BY score DESC))"


# sources, projections, splits


@query("SELECT f.txId, f.time_step, c.class FROM elliptic_txs_features f JOIN elliptic_txs_classes c ON f.txId = c.txId")
def r001_load_labelled(spark, sf_dir):
    f, c = table(spark, sf_dir, "elliptic_txs_features"), table(spark, sf_dir, "elliptic_txs_classes")
    return f.select("txId", "time_step").join(c.select("txId", "class"), "txId")


@query("SELECT DISTINCT txId1::VARCHAR src, txId2::VARCHAR dst FROM elliptic_txs_edgelist WHERE txId1 IS NOT NULL AND txId2 IS NOT NULL")
def r002_pruned_edges(spark, sf_dir):
    e = graphs.clean_edges(table(spark, sf_dir, "elliptic_txs_edgelist"), "txId1", "txId2")
    return e.select(F.col("src").cast("string"), F.col("dst").cast("string"))


@query("""WITH r AS (SELECT DISTINCT ent_num, remark FROM sdn_rows WHERE contains(remark, 'Digital Currency Address')),
p AS (SELECT ent_num, x, n FROM (SELECT ent_num, remark, unnest(x) x, generate_subscripts(x, 1) n FROM (SELECT ent_num, remark, string_split(remark, 'Digital Currency Address') x FROM r))),
q AS (SELECT ent_num, n, string_split_regex(ltrim(regexp_replace(x, '^\\s*-\\s*', '')), '[^A-Za-z0-9]+') w, x FROM p WHERE n > 1 AND regexp_matches(x, '^\\s*-\\s*[A-Za-z]{2,10}\\s+[A-Za-z0-9]'))
SELECT DISTINCT ent_num, (row_number() OVER (PARTITION BY ent_num, h ORDER BY n))::INTEGER pos, CASE WHEN upper(w[1]) = 'XBT' THEN 'BTC' ELSE upper(w[1]) END currency, w[2] address
FROM (SELECT q.ent_num, q.n, w, 0 h FROM q)""")
def r004_ofac_remarks(spark, sf_dir):
    return sanctions.ofac_addresses(table(spark, sf_dir, "sdn_rows").select("ent_num", "remark").distinct(), "ent_num", "remark").distinct()


#: Blocks as the European list writes them, by hand: labels of several currencies, lines without, words that are no labels.
EU_BLOCKS = {
    "e1": "LTC: LhyLV9YvGeM3yQ5mRZkbPqKBmSvTmNkdW2\nXRP : rw2ciyaNshpHe7bCHo4bRWq6pqqynnWKQg and DOGE: D8mFyXy1wE1oVb3kJvYvSPWYLwfHh6gYkW",
    "e2": "NOTE: see 0x1111111111111111111111111111111111111111\nBTC: 1BoatSLRHtKNngkdXEeobR76b53LETtpyT\n3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy",
    "e3": "1BoatSLRHtKNngkdXEeobR76b53LETtpyT\nETH: 0x2222222222222222222222222222222222222222\nbc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq\n3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy",
    "e4": "TN3W4H6rK2ce4vX9YnFQHwKENnHjoxb3m9\r\nxbt:\t3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy\rXBT:abc\n1BoatSLRHtKNngkdXEeobR76b53LETtpyT",
    "e5": "no address here", "e6": "",
}
_EU_VALUES = ", ".join("('" + k + "', '" + v.replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '").replace("\t", "' || chr(9) || '") + "')" for k, v in EU_BLOCKS.items())
_EU_CODES = "BTC XBT ETH BSC TRX XMR LTC BCH DOGE XRP USDT USDC SOL BNB DASH ZEC ETC ARB"


@query(f"""WITH b AS (SELECT * FROM (VALUES {_EU_VALUES}) t(block, txt) UNION SELECT md5(remark), regexp_replace(replace(remark, '; ', chr(10)), 'Digital Currency Address - ([A-Za-z]+) ', '\\1: ', 'g') FROM sdn_rows WHERE remark IS NOT NULL),
l AS (SELECT block, unnest(x) t, generate_subscripts(x, 1) - 1 line FROM (SELECT block, string_split_regex(txt, '\\r\\n|[\\n\\r]') x FROM b)),
k AS (SELECT block, line, t, regexp_extract_all(t, '\\b[A-Z]{{3,4}}\\s*:\\s*[A-Za-z0-9]+') x FROM l),
m AS (SELECT block, line, t, list_filter(list_transform(x, lambda y: [rtrim(split_part(y, ':', 1)), ltrim(split_part(y, ':', 2), ' ' || chr(9))]), lambda y: list_contains(string_split('{_EU_CODES}', ' '), y[1])) x FROM k),
c AS (SELECT *, last_value(CASE WHEN len(x) > 0 THEN replace(x[-1][1], 'XBT', 'BTC') END IGNORE NULLS) OVER (PARTITION BY block ORDER BY line) now FROM m),
f AS (SELECT block, line, now, t, unnest([('ETH', '0x[a-fA-F0-9]{{40}}'), ('BTC', 'bc1[a-z0-9]{{25,62}}'), ('TRX', '\\bT[A-Za-z1-9]{{33}}\\b'), ('XMR', '\\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{{93}}\\b'), ('', '\\b[13][a-km-zA-HJ-NP-Z1-9]{{25,34}}\\b')]) r FROM c WHERE len(x) = 0)
SELECT DISTINCT block, line::INTEGER line, replace(y[1], 'XBT', 'BTC') currency, y[2] address FROM (SELECT block, line, unnest(x) y FROM c)
UNION SELECT block, line::INTEGER, coalesce(now, r[1]), a FROM (
  SELECT block, line, now, r, unnest(regexp_extract_all(t, '0x[a-fA-F0-9]{{40}}')) a FROM f WHERE r[1] = 'ETH' UNION ALL SELECT block, line, now, r, unnest(regexp_extract_all(t, 'bc1[a-z0-9]{{25,62}}')) FROM f WHERE r[1] = 'BTC'
  UNION ALL SELECT block, line, now, r, unnest(regexp_extract_all(t, '\\bT[A-Za-z1-9]{{33}}\\b')) FROM f WHERE r[1] = 'TRX' UNION ALL SELECT block, line, now, r, unnest(regexp_extract_all(t, '\\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{{93}}\\b')) FROM f WHERE r[1] = 'XMR'
  UNION ALL SELECT block, line, now, r, unnest(regexp_extract_all(t, '\\b[13][a-km-zA-HJ-NP-Z1-9]{{25,34}}\\b')) FROM f WHERE r[1] = '' AND now = 'BTC')""")
def r006_eu_blocks(spark, sf_dir):
    """Blocks made by hand, and the remarks of the other list written as blocks."""
    x = table(spark, sf_dir, "sdn_rows").filter("remark is not null")
    x = x.select(F.md5("remark").alias("block"), F.regexp_replace(F.replace("remark", F.lit("; "), F.lit("\n")), "Digital Currency Address - ([A-Za-z]+) ", "$1: ").alias("txt"))
    hand = spark.createDataFrame(list(EU_BLOCKS.items()), "block string, txt string")
    return sanctions.eu_addresses(hand.unionByName(x).distinct(), "block", "txt")


@query("""SELECT lower(trim(address)) address, CASE WHEN upper(trim(currency)) = 'XBT' THEN 'BTC' ELSE upper(trim(currency)) END currency, source, list, date FROM sanctions_addresses
QUALIFY row_number() OVER (PARTITION BY lower(trim(address)) ORDER BY date, source, list, CASE WHEN upper(trim(currency)) = 'XBT' THEN 'BTC' ELSE upper(trim(currency)) END) = 1""")
def r008_first_seen(spark, sf_dir):
    x = table(spark, sf_dir, "sanctions_addresses").withColumn("currency", sanctions.currency(F.col("currency")))
    return sanctions.first_seen(x, "address", ["date", "source", "list", "currency"]).select(F.lower(F.trim("address")).alias("address"), "currency", "source", "list", "date")


@query("SELECT CASE WHEN time_step <= 30 THEN 'train' WHEN time_step <= 40 THEN 'valid' WHEN time_step > 40 THEN 'test' END split, count(*) n, min(time_step) first_step, max(time_step) last_step FROM elliptic_txs_features GROUP BY 1")
def r015_temporal_split(spark, sf_dir):
    x = with_split(table(spark, sf_dir, "elliptic_txs_features"), "time_step")
    return x.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("time_step").alias("first_step"), F.max("time_step").alias("last_step"))


@query("SELECT f.time_step, count(*) n, sum((trim(class) = '1')::INTEGER)::BIGINT illicit FROM elliptic_txs_features f JOIN elliptic_txs_classes c ON f.txId = c.txId WHERE trim(class) IN ('1', '2') GROUP BY 1")
def r016_labels(spark, sf_dir):
    x = labelled(r001_load_labelled(spark, sf_dir))
    return x.groupBy("time_step").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("illicit"))


def _vec(spark, sf_dir, n: int | None = None):
    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    return e.select("vec_id", (F.slice(v, 1, n) if n else v).alias("vec"), "label", (F.pmod("vec_id", F.lit(49)) + 1).cast("int").alias("step"))


VEC = "(SELECT vec_id, embedding::DOUBLE[] vec, label, (vec_id % 49 + 1)::INTEGER step FROM embeddings)"


@query(f"""SELECT vec_id, round(list_avg(vec), 6) d_mean, round(list_min(vec), 6) d_min, round(list_max(vec), 6) d_max, round(list_stddev_pop(vec), 6) d_std, round(list_aggregate(vec, 'quantile_cont', 0.25), 6) d_q25, round(list_aggregate(vec, 'quantile_cont', 0.5), 6) d_q50, round(list_aggregate(vec, 'quantile_cont', 0.75), 6) d_q75, {', '.join(f'round(vec[{i}], 6) d_{i}' for i in range(1, 65))}, 71::INTEGER width FROM {VEC}""")
def r018_feature_matrix(spark, sf_dir):
    x, names = matrix.feature_matrix(_vec(spark, sf_dir), 64, distances="vec")
    return x.select("vec_id", *[F.round(F.get("features", F.lit(i)), 6).alias(n) for i, n in enumerate(names)], F.size("features").alias("width"))


_HAAR = "list_transform(range(1, len({0}) // 2 + 1), lambda i: ({0}[2 * i - 1] {1} {0}[2 * i]) / 2)"


@query(f"""WITH a AS (SELECT vec_id, vec, {_HAAR.format('vec', '+')} l1, {_HAAR.format('vec', '-')} h1 FROM {VEC}),
b AS (SELECT *, {_HAAR.format('l1', '+')} l2, {_HAAR.format('l1', '-')} h2 FROM a),
c AS (SELECT vec_id, list_concat(list_concat(vec, list_concat(l2, h2)), h1) w FROM b)
SELECT vec_id, unnest(range(0, len(w)))::INTEGER pos, round(unnest(w), 6) value FROM c""")
def r020_wavelet(spark, sf_dir):
    x = _vec(spark, sf_dir).select("vec_id", F.posexplode(matrix.wavelet_features(F.col("vec"))).alias("pos", "value"))
    return x.select("vec_id", "pos", F.round("value", 6).alias("value"))


@query("SELECT DISTINCT report_id, round(1 + 4 * abs(cohen_d) + sqrt((1 + 4 * abs(cohen_d)) * 4 * abs(cohen_d)), 6) e_value, round(1 + 2 * abs(cohen_d), 6) gamma FROM report WHERE cohen_d BETWEEN -1 AND 1 AND NOT isnan(cohen_d)")
def r021_sensitivity(spark, sf_dir):
    e, g = matrix.sensitivity(F.col("cohen_d"))
    return table(spark, sf_dir, "report").filter("cohen_d between -1 and 1 and not isnan(cohen_d)").select("report_id", F.round(e, 6).alias("e_value"), F.round(g, 6).alias("gamma")).distinct()


@query("""WITH x AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE day(ts) <= 10) a, list(DISTINCT event_type) FILTER (WHERE day(ts) > 20) b FROM events GROUP BY user_id),
y AS (SELECT user_id, coalesce(a, []) a, coalesce(b, []) b FROM x), z AS (SELECT user_id, len(list_intersect(a, b)) i, len(a) + len(b) - len(list_intersect(a, b)) u FROM y)
SELECT user_id, round(CASE WHEN u = 0 THEN 1 ELSE i / u END, 6) jaccard, round(0.5 * (1 - CASE WHEN u = 0 THEN 1 ELSE i / u END), 6) margin FROM z""")
def r022_jaccard_margin(spark, sf_dir):
    d = F.dayofmonth("ts")
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(d <= 10, F.col("event_type"))).alias("a"), F.collect_set(F.when(d > 20, F.col("event_type"))).alias("b"))
    j = matrix.jaccard(F.col("a"), F.col("b"))
    return x.select("user_id", F.round(j, 6).alias("jaccard"), F.round(matrix.pull_margin(0.5, j), 6).alias("margin"))


@query("SELECT label, count(*) * 64 * 4 raw_bytes, count(*) * 16 pq_bytes, 16.0::DOUBLE ratio, ceil(1.96 * 1.96 * 0.25 / 0.0001)::BIGINT sample_n FROM embeddings GROUP BY label")
def r024_footprint_and_power(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    raw, pq, ratio = matrix.pq_footprint(F.col("n"), F.lit(64), F.lit(16))
    return x.select("label", raw.alias("raw_bytes"), pq.alias("pq_bytes"), ratio.cast("double").alias("ratio"), matrix.sample_size(F.lit(0.5), 0.01).alias("sample_n"))


# threshold sweeps and ranking metrics


@query(f"WITH {STEPS} SELECT round(score, 9) tau, cn::BIGINT alerts, (1.0 * (cn - cp) + 20.0 * (ap - cp))::DOUBLE AS cost FROM c")
def r050_cost_curve(spark, sf_dir):
    x = curves.cost_curve(curves.score_steps(scored(spark, sf_dir), "score", "y"), 1.0, 20.0)
    return x.select(F.round("tau", 9).alias("tau"), "alerts", "cost")


@query(f"WITH {STEPS}, k AS (SELECT score tau, cn alerts, 1.0 * (cn - cp) + 20.0 * (ap - cp) AS cost, an FROM c) SELECT round(tau, 9) tau, alerts::BIGINT alerts, cost::DOUBLE AS cost, true feasible FROM k WHERE alerts <= 0.3 * an ORDER BY cost, alerts, tau DESC LIMIT 1")
def r051_select_tau(spark, sf_dir):
    s = scored(spark, sf_dir)
    budget = int(0.3 * s.count())
    x = curves.best_threshold(curves.cost_curve(curves.score_steps(s, "score", "y"), 1.0, 20.0), budget)
    return x.select(F.round("tau", 9).alias("tau"), "alerts", "cost", "feasible")


@query(f"""WITH t AS (SELECT k / 100 tau FROM range(1, 100) r(k)), x AS (SELECT tau, count(*) FILTER (WHERE score >= tau) n, coalesce(sum(y) FILTER (WHERE score >= tau), 0) tp, sum(y) p FROM t, {SCORED} GROUP BY tau)
SELECT tau, round(CASE WHEN n > 0 THEN tp / n ELSE 0 END, 9) "precision", round(tp / p, 9) recall, round(CASE WHEN tp > 0 THEN 5 * (tp / n) * (tp / p) / (4 * (tp / n) + tp / p) ELSE 0 END, 9) fbeta FROM x""")
def r053_fbeta_grid(spark, sf_dir):
    x = curves.fbeta_grid(scored(spark, sf_dir), "score", "y", 2.0)
    return x.select("tau", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "fbeta")])


@query(f"WITH {STEPS} SELECT round(sum(pos / ap * cp / cn), 9) ap FROM c")
def r054_average_precision(spark, sf_dir):
    return curves.average_precision(curves.score_steps(scored(spark, sf_dir), "score", "y")).select(F.round("ap", 9).alias("ap"))


@query(f"WITH {STEPS} SELECT round(sum(pos * ((an - ap) - (cn - cp) + 0.5 * (n - pos))) / (max(ap) * (max(an) - max(ap))), 9) auc FROM c")
def r055_roc_auc(spark, sf_dir):
    return curves.roc_auc(curves.score_steps(scored(spark, sf_dir), "score", "y")).select(F.round("auc", 9).alias("auc"))


@query(f"SELECT grp, round(avg((score - y) * (score - y)), 9) brier FROM {SCORED} GROUP BY grp")
def r056_brier(spark, sf_dir):
    d = F.col("score") - F.col("y")
    return scored(spark, sf_dir).groupBy("grp").agg(F.round(F.avg(d * d), 9).alias("brier"))


def _bins(n: int) -> str:
    return f"greatest(1, len(list_filter([{', '.join(f'{i / n!r}::DOUBLE' for i in range(n))}], lambda e: e < score)))"


@query(f"SELECT r.k::INTEGER bin, coalesce(n, 0) n, mean_p, rate FROM range(1, 16) r(k) LEFT JOIN (SELECT {_bins(15)} bin, count(*) n, round(avg(score), 9) mean_p, round(avg(y), 9) rate FROM {SCORED} GROUP BY 1) b ON b.bin = r.k")
def r057_reliability(spark, sf_dir):
    x = curves.reliability(scored(spark, sf_dir), "score", "y", 15)
    return x.select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("rate", 9).alias("rate"))


@query(f"SELECT round(sum(n * abs(p - r)) / sum(n), 9) ece FROM (SELECT count(*) n, avg(score) p, avg(y) r FROM {SCORED} GROUP BY {_bins(10)})")
def r057b_ece(spark, sf_dir):
    return curves.ece(curves.reliability(scored(spark, sf_dir), "score", "y", 10)).select(F.round("ece", 9).alias("ece"))


@query(f"""WITH g AS (SELECT grp AS "group", count(*) FILTER (WHERE y = 1 AND score >= 0.5) / nullif(count(*) FILTER (WHERE y = 1), 0) tpr, count(*) FILTER (WHERE y = 0 AND score >= 0.5) / nullif(count(*) FILTER (WHERE y = 0), 0) fpr FROM {SCORED} GROUP BY grp)
SELECT "group", round(tpr, 9) tpr, round(fpr, 9) fpr, round(max(tpr) OVER () - min(tpr) OVER (), 9) tpr_gap, round(max(fpr) OVER () - min(fpr) OVER (), 9) fpr_gap FROM g""")
def r060_equalized_odds(spark, sf_dir):
    x = curves.group_rates(scored(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.5).cast("int")), "y", "pred", "grp")
    return x.select("group", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "tpr_gap", "fpr_gap")])


@query(f"SELECT step, count(*) FILTER (WHERE score >= 0.5) alerts, round(coalesce(count(*) FILTER (WHERE score >= 0.5 AND y = 0) / nullif(count(*) FILTER (WHERE score >= 0.5), 0), 0), 9) fp_share, round(quantile_cont(qty, 0.99), 9) p99, round(quantile_cont(score, 0.95), 9) tau_d FROM {SCORED} GROUP BY step")
def r061_operational(spark, sf_dir):
    a = F.col("score") >= 0.5
    n = F.sum(a.cast("long"))
    return scored(spark, sf_dir).groupBy("step").agg(
        n.alias("alerts"), F.round(F.coalesce(F.sum((a & (F.col("y") == 0)).cast("long")) / F.nullif(n, F.lit(0)), F.lit(0.0)), 9).alias("fp_share"),
        F.round(F.expr("percentile(qty, 0.99)"), 9).alias("p99"), F.round(F.expr("percentile(score, 0.95)"), 9).alias("tau_d"),
    )


@query(f"WITH r AS (SELECT y, row_number() OVER (ORDER BY score DESC, id, l_partkey) r FROM {SCORED}) SELECT k::INTEGER k, sum(y)::BIGINT hits, round(avg(y), 9) \"precision\" FROM r, (VALUES (100), (500), (1000)) t(k) WHERE r <= k GROUP BY k")
def r063_precision_at_k(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("key", F.struct("id", "l_partkey"))
    return curves.precision_at(s, "score", "y", "key", [100, 500, 1000]).select("k", "hits", F.round("precision", 9).alias("precision"))


@query(f"WITH {STEPS}, b AS (SELECT min(1.0 * (cn - cp) + 20.0 * (ap - cp)) AS own FROM c), f AS (SELECT sum(CASE WHEN score >= 0.5 AND y = 0 THEN 1.0 WHEN score < 0.5 AND y = 1 THEN 20.0 ELSE 0 END) AS fixed FROM {SCORED}) SELECT own::DOUBLE own_cost, fixed::DOUBLE fixed_cost, round((fixed - own) / fixed, 9) savings FROM b, f")
def r064_savings(spark, sf_dir):
    s = scored(spark, sf_dir)
    own = curves.cost_curve(curves.score_steps(s, "score", "y"), 1.0, 20.0).agg(F.min("cost").alias("own_cost"))
    a = F.col("score") >= 0.5
    fixed = s.agg(F.sum(F.when(a & (F.col("y") == 0), 1.0).when(~a & (F.col("y") == 1), 20.0).otherwise(0.0)).alias("fixed_cost"))
    return own.join(F.broadcast(fixed)).select("own_cost", "fixed_cost", F.round((F.col("fixed_cost") - F.col("own_cost")) / F.col("fixed_cost"), 9).alias("savings"))


@query("""WITH w AS (SELECT replicate, value, len(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402]::DOUBLE[], lambda s: s <= ('0x' || substr(md5(event_id || '|' || replicate), 1, 8))::BIGINT / 4294967296)) w FROM events, range(1, 51) r(replicate))
SELECT replicate::INTEGER replicate, round(sum(w * value) / sum(w), 6) mean FROM w GROUP BY replicate""")
def r065_bootstrap(spark, sf_dir):
    return stats.bootstrap_means(table(spark, sf_dir, "events"), "event_id", "value", 50).select("replicate", F.round("mean", 6).alias("mean"))


@query(f"WITH s AS (SELECT step, score, count(*) n, sum(y) pos FROM {SCORED} GROUP BY step, score), c AS (SELECT *, sum(n) OVER w cn, sum(pos) OVER w cp, sum(pos) OVER (PARTITION BY step) ap, sum(n) OVER (PARTITION BY step) an FROM s WINDOW w AS (PARTITION BY step ORDER BY score DESC)) SELECT step, round(sum(CASE WHEN ap > 0 AND ap < an THEN pos / ap * cp / cn ELSE 0 END), 9) ap FROM c GROUP BY step")
def r082_ap_by_step(spark, sf_dir):
    x = curves.average_precision(curves.score_steps(scored(spark, sf_dir), "score", "y", ["step"]), ["step"])
    return x.select("step", F.round("ap", 9).alias("ap"))


# series

def series_sql(source: str) -> str:
    """SQL of the four features by step 1..49; ``source`` gives (t, flag)."""
    return f"""e AS ({source}),
d AS (SELECT k t, count(e.t) n, count(*) FILTER (WHERE flag) flagged FROM range(1, 50) r(k) LEFT JOIN e ON e.t = k GROUP BY k),
f AS (SELECT t, n, flagged, avg(n) OVER w m, stddev_pop(n) OVER w s, last_value(CASE WHEN flagged > 0 THEN t END IGNORE NULLS) OVER (ORDER BY t) l FROM d WINDOW w AS (ORDER BY t RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)),
h AS (SELECT a.t, (SELECT avg(n) FROM d) + 0.5 * coalesce(sum(exp(-1.0 * (a.t - b.t)) * b.n), 0) hawkes FROM d a LEFT JOIN d b ON b.t < a.t GROUP BY a.t),
z AS (SELECT f.t, n, flagged, CASE WHEN s + m > 0 THEN (s - m) / (s + m) ELSE 0 END burstiness, hawkes, coalesce(t - l, 49) since_last FROM f JOIN h USING (t))"""


SERIES = series_sql("SELECT date_diff('day', DATE '2024-01-01', ts::DATE) + 1 t, event_type = 'error' AND value >= 250 flag FROM events")


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.withColumn("t0", (F.datediff(F.to_date("ts"), F.lit("2024-01-01")) + 1).cast("int")).withColumn("flag", (F.col("event_type") == "error") & (F.col("value") >= 250))


@query(f"WITH {SERIES} SELECT t::INTEGER t, n, flagged, round(burstiness, 9) burstiness, round(hawkes, 9) hawkes, since_last::INTEGER since_last FROM z")
def r058_temporal_series(spark, sf_dir):
    s = series.since_last(series.hawkes(series.burstiness(series.dense_counts(_events(spark, sf_dir), "t0", 1, 49, "flag"))))
    return s.select("t", "n", "flagged", F.round("burstiness", 9).alias("burstiness"), F.round("hawkes", 9).alias("hawkes"), "since_last")


@query(f"WITH {SERIES} SELECT event_id, z.n step_count, round(burstiness, 9) burstiness, round(hawkes, 9) hawkes, since_last::INTEGER since_last FROM events v JOIN z ON z.t = date_diff('day', DATE '2024-01-01', v.ts::DATE) + 1")
def r085_temporal_features(spark, sf_dir):
    x = series.temporal_features(_events(spark, sf_dir), "t0", "flag")
    return x.select("event_id", "step_count", F.round("burstiness", 9).alias("burstiness"), F.round("hawkes", 9).alias("hawkes"), "since_last")


# drift, trends, association

CUT = "l_shipdate >= TIMESTAMP '1998-01-01'"
LONG_LINE = f"(SELECT {CUT} post, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) v FROM lineitem)"


def _long_line(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in cols]))
    return table(spark, sf_dir, "lineitem").select((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("post"), pairs.alias("x")).select("post", "x.*")


@query(f"""WITH d AS (SELECT grp, step, avg(qty) v FROM {SCORED} GROUP BY grp, step), s AS (SELECT a.grp, sum(sign(b.v - a.v)) s FROM d a JOIN d b ON a.grp = b.grp AND a.step < b.step GROUP BY a.grp),
n AS (SELECT grp, count(*) n FROM d GROUP BY grp) SELECT grp, n::BIGINT n, s::BIGINT s, round(n * (n - 1) * (2 * n + 5) / 18, 9) var_s, round(CASE WHEN s > 0 THEN (s - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18) WHEN s < 0 THEN (s + 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18) ELSE 0 END, 9) z FROM s JOIN n USING (grp)""")
def r070_mann_kendall(spark, sf_dir):
    d = scored(spark, sf_dir).groupBy("grp", "step").agg(F.avg("qty").alias("v"))
    x = stats.mann_kendall(d, "step", "v", ["grp"])
    return x.select("grp", "n", F.col("s").cast("long").alias("s"), F.round("var_s", 9).alias("var_s"), F.round("z", 9).alias("z"))


@query("""WITH c AS (SELECT corr(l_discount, l_extendedprice) xy, corr(l_discount, l_quantity) xz, corr(l_extendedprice, l_quantity) yz, count(*) n FROM lineitem) SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) r, n::BIGINT n FROM c""")
def r074_partial_correlation(spark, sf_dir):
    r, _, n = stats.partial_correlation(table(spark, sf_dir, "lineitem"), "l_discount", "l_extendedprice", ["l_quantity"])
    return spark.range(1).select(F.lit(round(r, 6)).alias("r"), F.lit(n).cast("long").alias("n"))


@query("SELECT anchor, round(r, 6) r, round(1 + 4 * abs(r) + sqrt((1 + 4 * abs(r)) * 4 * abs(r)), 5) e_value, round(1 + 2 * abs(r), 6) gamma FROM (SELECT a.label anchor, corr(embedding[1]::DOUBLE, embedding[2]::DOUBLE) r FROM embeddings a GROUP BY a.label)")
def r075_association_filter(spark, sf_dir):
    x = _vec(spark, sf_dir).groupBy(F.col("label").alias("anchor")).agg(F.corr(F.get("vec", F.lit(0)), F.get("vec", F.lit(1))).alias("r"))
    e, g = matrix.sensitivity(F.col("r"))
    return x.select("anchor", F.round("r", 6).alias("r"), F.round(e, 5).alias("e_value"), F.round(g, 6).alias("gamma"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) coefficient FROM lineitem")
def r077_falsification(spark, sf_dir):
    b, _, _ = stats.ols_last(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.range(1).select(F.lit(round(b, 4)).alias("coefficient"))


@query(f"""WITH s AS (SELECT step, count(*) FILTER (WHERE y = 1 AND grp = 'F') + 0.5 a, count(*) FILTER (WHERE y = 1 AND grp <> 'F') + 0.5 b, count(*) FILTER (WHERE y = 0 AND grp = 'F') + 0.5 c, count(*) FILTER (WHERE y = 0 AND grp <> 'F') + 0.5 d FROM {SCORED} GROUP BY step)
SELECT step, round(a * d / (b * c), 6) odds_ratio, round((a + b + c + d) * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * (a + c) * (b + d)), 6) chi2 FROM s""")
def r081_odds_ratio(spark, sf_dir):
    f = F.col("grp") == "F"
    n = lambda y, g: (F.sum(((F.col("y") == y) & g).cast("long")) + 0.5)
    x = scored(spark, sf_dir).groupBy("step").agg(n(1, f).alias("a"), n(1, ~f).alias("b"), n(0, f).alias("c"), n(0, ~f).alias("d"))
    det = F.expr("a * d - b * c")
    return x.select("step", F.round(F.expr("a * d / (b * c)"), 6).alias("odds_ratio"), F.round(F.expr("a + b + c + d") * det * det / F.expr("(a + b) * (c + d) * (a + c) * (b + d)"), 6).alias("chi2"))


LEAD = """a AS (SELECT user_id, min(date_diff('day', DATE '2024-01-01', ts::DATE) + 1) a FROM events WHERE value >= 200 GROUP BY user_id), s AS (SELECT user_id, max(date_diff('day', DATE '2024-01-01', ts::DATE) + 1) s FROM events WHERE event_type = 'error' GROUP BY user_id),
j AS (SELECT s.user_id, s.s, a.a FROM s LEFT JOIN a USING (user_id) WHERE a.a IS NULL OR a.a <= s.s)"""


@query(f"WITH {LEAD} SELECT CASE WHEN s <= 20 THEN 'train' ELSE 'test' END era, round(median(s - a), 9) median_lead, round(quantile_cont(s - a, 0.9), 9) p90_lead, count(*) FILTER (WHERE a IS NULL) censored, count(a) matched FROM j GROUP BY 1")
def r071_lead_time(spark, sf_dir):
    e = _events(spark, sf_dir)
    a = e.filter("value >= 200").groupBy("user_id").agg(F.min("t0").alias("a"))
    s = e.filter("event_type = 'error'").groupBy("user_id").agg(F.max("t0").alias("s"))
    j = s.join(a, "user_id", "left").filter("a is null or a <= s")
    era = F.when(F.col("s") <= 20, "train").otherwise("test")
    return j.groupBy(era.alias("era")).agg(F.round(F.expr("percentile(s - a, 0.5)"), 9).alias("median_lead"), F.round(F.expr("percentile(s - a, 0.9)"), 9).alias("p90_lead"), F.sum(F.col("a").isNull().cast("long")).alias("censored"), F.count("a").alias("matched"))


# graphs

EDGES = "(SELECT DISTINCT txId1 src, txId2 dst FROM elliptic_txs_edgelist WHERE txId1 IS NOT NULL AND txId2 IS NOT NULL)"
DEGREES = f"(SELECT node, sum(i) in_degree, sum(o) out_degree FROM (SELECT src node, 1 o, 0 i FROM {EDGES} UNION ALL SELECT dst, 0, 1 FROM {EDGES}) GROUP BY node)"


def _edges(spark, sf_dir):
    return graphs.clean_edges(table(spark, sf_dir, "elliptic_txs_edgelist"), "txId1", "txId2")


@query(f"SELECT node, in_degree::BIGINT in_degree, out_degree::BIGINT out_degree, (in_degree + out_degree)::BIGINT total_degree, round((in_degree + 1) / (out_degree + 1), 9) ratio FROM {DEGREES}")
def r089_degrees(spark, sf_dir):
    return graphs.degrees(_edges(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


def _pagerank_sql(rounds: int) -> str:
    n = "(SELECT count(*) FROM v)"
    parts = [f"e AS MATERIALIZED {EDGES}", "v AS MATERIALIZED (SELECT src node FROM e UNION SELECT dst FROM e)", "o AS MATERIALIZED (SELECT src, count(*) k FROM e GROUP BY src)", f"p0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / {n} r FROM v)"]
    for i in range(rounds):
        parts.append(f"p{i + 1} AS MATERIALIZED (SELECT v.node, 0.15 / {n} + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(r), 0) FROM p{i} LEFT JOIN o ON o.src = p{i}.node WHERE o.src IS NULL) / {n}) r FROM v LEFT JOIN (SELECT e.dst, sum(p{i}.r / o.k) got FROM e JOIN o ON o.src = e.src JOIN p{i} ON p{i}.node = e.src GROUP BY e.dst) g ON g.dst = v.node)")
    return f"WITH {', '.join(parts)} SELECT node, round(r * {n}, 6) rank FROM p{rounds}"


@query(_pagerank_sql(20))
def r090b_pagerank_rounds(spark, sf_dir):
    """A fixed number of rounds, which SQL can state; r090 runs to its tolerance."""
    x = graphs.pagerank(_edges(spark, sf_dir), rounds=20, tolerance=None)
    n = x.count()
    return x.select("node", F.round(F.col("rank") * n, 6).alias("rank"))


@query()
def r090_pagerank(spark, sf_dir):
    return graphs.pagerank(_edges(spark, sf_dir))


@query(f"WITH p AS ({_pagerank_sql(20)}) SELECT f.txId, coalesce(in_degree, 0)::BIGINT in_degree, coalesce(out_degree, 0)::BIGINT out_degree, coalesce(in_degree + out_degree, 0)::BIGINT total_degree, round(coalesce((in_degree + 1) / (out_degree + 1), 0), 9) ratio, coalesce(p.rank, 0) pagerank FROM (SELECT DISTINCT txId FROM elliptic_txs_features WHERE txId IS NOT NULL) f LEFT JOIN {DEGREES} d ON d.node = f.txId LEFT JOIN p ON p.node = f.txId")
def r091_graph_features(spark, sf_dir):
    """Transactions with all features of the graph, 0 for those without an edge; ranks times the number of nodes."""
    f = table(spark, sf_dir, "elliptic_txs_features").select("txId").filter("txId is not null").distinct()
    e = _edges(spark, sf_dir)
    g = graphs.degrees(e).join(r090b_pagerank_rounds(spark, sf_dir), "node").withColumnRenamed("node", "txId").withColumnRenamed("rank", "pagerank")
    return f.join(g, "txId", "left").fillna(0).select("txId", "in_degree", "out_degree", "total_degree", F.round("ratio", 9).alias("ratio"), "pagerank")


def _components_sql(edges: str, nodes: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT src a, dst b FROM {edges} UNION SELECT dst, src FROM {edges}), r(v, u) AS (SELECT node, node FROM {nodes} UNION SELECT e.b, r.u FROM r JOIN e ON e.a = r.v WHERE r.u < e.b)
SELECT v node, min(u) component FROM r GROUP BY v"""


@query(_components_sql(EDGES, f"(SELECT src node FROM {EDGES} UNION SELECT dst FROM {EDGES})"))
def r094_components(spark, sf_dir):
    return graphs.components(_edges(spark, sf_dir))


def _spends(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_orderkey").alias("tx"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("pos"), F.col("l_partkey").alias("addr"), (F.col("l_returnflag") == "R").alias("mixing"))


SPENDS = "(SELECT l_orderkey tx, l_linenumber * 10000000 + l_partkey pos, l_partkey addr, l_returnflag = 'R' mixing FROM lineitem)"
STARS = f"(SELECT DISTINCT f.addr src, s.addr dst FROM {SPENDS} s JOIN (SELECT tx, arg_min(addr, pos) addr FROM {SPENDS} WHERE NOT mixing GROUP BY tx) f ON f.tx = s.tx WHERE NOT s.mixing)"


@query(_components_sql(STARS, f"(SELECT DISTINCT addr node FROM {SPENDS})"))
def r092_cospend_clusters(spark, sf_dir):
    return graphs.cluster_cospend(_spends(spark, sf_dir), "tx", "pos", "addr", ["mixing"])


@query()
def r093_capped_union(spark, sf_dir):
    e = graphs.cospend_edges(_spends(spark, sf_dir), "tx", "pos", "addr", ["mixing"]).filter("src != dst")
    return graphs.capped_union(e, ["src", "dst"], 4)


@query(f"SELECT 'co_spend' edge_type, src::VARCHAR src, dst::VARCHAR dst FROM {STARS} WHERE src <> dst UNION SELECT 'co_spend', dst::VARCHAR, src::VARCHAR FROM {STARS} WHERE src <> dst UNION SELECT 'addr_tx', addr::VARCHAR, tx::VARCHAR FROM {SPENDS} UNION SELECT 'tx_addr', tx::VARCHAR, addr::VARCHAR FROM {SPENDS}")
def r097_account_graph(spark, sf_dir):
    return graphs.account_graph(_spends(spark, sf_dir), "tx", "pos", "addr", ["mixing"])


MENTIONS = "(SELECT l_orderkey article, p_brand entity FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _mentions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("article"), F.col("p_brand").alias("entity"))


@query(f"WITH m AS (SELECT DISTINCT * FROM {MENTIONS}) SELECT x.entity a, y.entity b, count(*) weight FROM m x JOIN m y ON x.article = y.article AND x.entity < y.entity GROUP BY 1, 2")
def r098_comention(spark, sf_dir):
    return graphs.comention(_mentions(spark, sf_dir), "article", "entity")


@query(f"WITH m AS (SELECT article, entity, count(*) c FROM {MENTIONS} GROUP BY 1, 2), k AS (SELECT article, count(*) k FROM m GROUP BY 1) SELECT entity, sum(c)::BIGINT n_mentions, count(*) n_articles, round(avg(k - 1), 4) mean_co FROM m JOIN k USING (article) GROUP BY entity")
def r099_mention_features(spark, sf_dir):
    return graphs.mention_features(_mentions(spark, sf_dir), "article", "entity")


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src a, dst b FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), r(node, hops) USING KEY (node) AS (SELECT min(a), 0 FROM e UNION SELECT e.b, min(r.hops) + 1 FROM r JOIN e ON e.a = r.node WHERE e.b NOT IN (SELECT node FROM recurring.r) GROUP BY e.b)
SELECT node, hops::INTEGER hops, round(1 / (1 + hops), 9) proximity FROM r""")
def r100_proximity(spark, sf_dir):
    e = _edges(spark, sf_dir)
    x = graphs.hops_from(e, e.agg(F.least(F.min("src"), F.min("dst"))).first()[0])
    return x.select("node", "hops", F.round(1 / (1 + F.col("hops")), 9).alias("proximity"))


@query(f"WITH q AS (SELECT quantile_cont(in_degree + out_degree, 0.95) q FROM {DEGREES}) SELECT node, in_degree + out_degree >= q hub FROM {DEGREES}, q")
def r087_hub_flags(spark, sf_dir):
    d = graphs.degrees(_edges(spark, sf_dir))
    q = d.agg(F.expr("percentile(total_degree, 0.95)").alias("q"))
    return d.join(F.broadcast(q)).select("node", (F.col("total_degree") >= F.col("q")).alias("hub"))


@query(f"SELECT src, dst FROM {EDGES} QUALIFY row_number() OVER (PARTITION BY dst ORDER BY md5('72|' || src || '|' || dst), src) <= 5")
def r155_fanout_sample(spark, sf_dir):
    return graphs.sampled_neighbours(_edges(spark, sf_dir), 5)


# vectors


@query(f"WITH d AS (SELECT a.vec_id q, b.vec_id anchor, list_distance(a.vec, b.vec) dist FROM {VEC} a, {VEC} b WHERE a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, anchor) rank FROM d) SELECT q, anchor, round(dist, 6) dist, rank::INTEGER rank FROM r WHERE rank <= 5")
def r041_nearest(spark, sf_dir):
    v = _vec(spark, sf_dir)
    x = vectors.nearest(v, "vec_id", "vec", v, "vec_id", "vec", 5, exclude_self=True)
    return x.select(F.col("l").alias("q"), F.col("r").alias("anchor"), F.round("dist", 6).alias("dist"), "rank")


_ERA = "CASE WHEN step <= 30 THEN 'train' WHEN step <= 40 THEN 'valid' ELSE 'test' END"


@query(f"WITH x AS (SELECT *, {_ERA} era FROM {VEC}), d AS (SELECT a.era, a.vec_id q, b.vec_id anchor, list_distance(a.vec, b.vec) dist FROM x a JOIN x b ON a.era = b.era WHERE b.label IN (0, 1)), r AS (SELECT *, row_number() OVER (PARTITION BY era, q ORDER BY dist, anchor) rank FROM d) SELECT era, q, anchor, round(dist, 6) dist FROM r WHERE rank <= 3")
def r107_nearest_by_era(spark, sf_dir):
    v = _vec(spark, sf_dir).withColumn("era", vectors.era_of(F.col("step"), 30))
    x = vectors.nearest(v, "vec_id", "vec", v.filter("label in (0, 1)"), "vec_id", "vec", 3, by=["era"])
    return x.select("era", F.col("l").alias("q"), F.col("r").alias("anchor"), F.round("dist", 6).alias("dist"))


#: Cells visited of the index, and codes compared again by their exact vectors for the 10 nearest.
PROBES, PQ_SHORTLIST = 32, 100


@query()
def r104_index_recall(spark, sf_dir):
    """Recall at 10 of the cell index, every row being a query."""
    v = _vec(spark, sf_dir)
    approx = vectors.CellIndex(v, "vec_id", "vec").nearest(v, "vec_id", "vec", 10, PROBES)
    return vectors.recall_at(approx, vectors.nearest(v, "vec_id", "vec", v, "vec_id", "vec", 10), 10)


@query()
def r111_pq_recall(spark, sf_dir):
    """Recall at 10 of codes looked up in the cell index, the shortlist ranked again by exact distance."""
    v = _vec(spark, sf_dir)
    books = vectors.pq_train(v, "vec", 64, 16, 256)
    short = vectors.CellIndex(v, "vec_id", "vec").coded_nearest(v, "vec_id", "vec", books, PQ_SHORTLIST, PROBES)
    return vectors.recall_at(vectors.rerank(short, v, "vec_id", "vec", v, "vec_id", "vec", 10), vectors.nearest(v, "vec_id", "vec", v, "vec_id", "vec", 10), 10)


@query(f"WITH x AS (SELECT vec_id, label, step, {_ERA} era FROM {VEC}) SELECT a.vec_id a, b.vec_id b FROM x a JOIN x b ON a.era = b.era AND a.vec_id < b.vec_id AND abs(a.step - b.step) <= 1 AND a.label <> b.label")
def r117_hard_negatives(spark, sf_dir):
    v = _vec(spark, sf_dir).withColumn("era", vectors.era_of(F.col("step"), 30))
    return vectors.hard_negatives(v, "vec_id", "label", "step", "era", 1)


@query(f"""WITH n AS (SELECT txId, min(time_step) t FROM elliptic_txs_features WHERE time_step IS NOT NULL GROUP BY txId), c AS (SELECT txId, min(trim(class)) c FROM elliptic_txs_classes WHERE class IS NOT NULL GROUP BY txId), x AS (SELECT n.txId k, t, c, CASE WHEN t <= 30 THEN 'train' WHEN t <= 40 THEN 'valid' ELSE 'test' END era FROM n JOIN c ON c.txId = n.txId)
SELECT src, dst FROM {EDGES} e JOIN x a ON a.k = e.src JOIN x b ON b.k = e.dst WHERE a.c = b.c AND a.era = b.era AND abs(a.t - b.t) <= 1""")
def r114_positive_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "elliptic_txs_features").filter("time_step is not null").groupBy("txId").agg(F.min("time_step").alias("t"))
    c = table(spark, sf_dir, "elliptic_txs_classes").filter("class is not null").groupBy("txId").agg(F.min(F.trim("class")).alias("c"))
    x = n.join(c, "txId").withColumn("era", vectors.era_of(F.col("t"), 30))
    return vectors.positive_pairs(_edges(spark, sf_dir), x, "txId", "c", "t", "era", 1)


@query(f"WITH d AS (SELECT node, pow(in_degree + out_degree, -0.75) w FROM {DEGREES}) SELECT node, round(w / (SELECT sum(w) FROM d) * (SELECT count(*) FROM d), 6) p FROM d")
def r115_sampling_probabilities(spark, sf_dir):
    d = graphs.degrees(_edges(spark, sf_dir))
    n = d.count()
    return vectors.sampling_probabilities(d, "total_degree", 0.75).select("node", F.round(F.col("p") * n, 6).alias("p"))


@query(f"WITH a AS (SELECT vec FROM {VEC} WHERE label = 0), d AS (SELECT v.step, list_distance(v.vec, a.vec) d FROM {VEC} v, a) SELECT step, round(median(d), 6) median_distance FROM d GROUP BY step")
def r069_median_distance(spark, sf_dir):
    v = _vec(spark, sf_dir)
    return density.median_distances(v, "vec_id", "vec", "step", v.filter("label = 0"), "vec_id", "vec").select("step", F.round("median", 6).alias("median_distance"))


# density and fusion


@query(f"WITH d AS (SELECT a.vec_id q, list_distance(a.vec, b.vec) dist FROM {VEC} a, {VEC} b), k AS (SELECT q, dist FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist) = 5) SELECT round(quantile_disc(dist, 0.9), 6) eps FROM k")
def r088_select_eps(spark, sf_dir):
    return density.select_eps(_vec(spark, sf_dir), "vec_id", "vec", 5, 0.9).select(F.round("eps", 6).alias("eps"))


EPS = 0.9


@query(f"""WITH RECURSIVE n AS MATERIALIZED (SELECT a.vec_id l, b.vec_id r FROM {VEC} a, {VEC} b WHERE list_distance(a.vec, b.vec) <= {EPS}), core AS MATERIALIZED (SELECT l FROM n GROUP BY l HAVING count(*) >= 3),
e AS MATERIALIZED (SELECT n.l a, n.r b FROM n JOIN core x ON x.l = n.l JOIN core y ON y.l = n.r), r(v, u) AS (SELECT l, l FROM core UNION SELECT e.b, r.u FROM r JOIN e ON e.a = r.v WHERE r.u < e.b), c AS (SELECT v, min(u) c FROM r GROUP BY v),
b AS (SELECT n.l, min(c.c) b FROM n JOIN c ON c.v = n.r GROUP BY n.l)
SELECT vec_id, coalesce(c.c, b.b, -1)::BIGINT AS cluster FROM embeddings LEFT JOIN c ON c.v = vec_id LEFT JOIN b ON b.l = vec_id""")
def r095_dbscan(spark, sf_dir):
    return density.dbscan(_vec(spark, sf_dir), "vec_id", "vec", EPS, 3)


@query("WITH c AS (SELECT l_linestatus t, l_returnflag f, count(*) n FROM lineitem GROUP BY 1, 2) SELECT (SELECT sum(n * (n - 1) // 2) FROM c)::BIGINT tp, ((SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) n FROM c GROUP BY f)) - (SELECT sum(n * (n - 1) // 2) FROM c))::BIGINT fp, ((SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) n FROM c GROUP BY t)) - (SELECT sum(n * (n - 1) // 2) FROM c))::BIGINT fn")
def r096_pair_counts(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.ascii("l_linestatus").alias("t"), F.ascii("l_returnflag").alias("f"))
    return fusion.pair_counts(x, "t", "f")


@query(f"WITH k AS ({_components_sql(EDGES, f'(SELECT src node FROM {EDGES} UNION SELECT dst FROM {EDGES})')}), c AS (SELECT txId, min(trim(class)) y FROM elliptic_txs_classes WHERE trim(class) IN ('1', '2') GROUP BY txId), g AS (SELECT component, count(*) n, min(y) = max(y) p FROM k JOIN c ON c.txId = k.node GROUP BY component HAVING count(*) >= 2) SELECT round(coalesce(avg(p::INTEGER), 1), 9) plain, round(coalesce(sum(CASE WHEN p THEN n ELSE 0 END) / sum(n), 1), 9) weighted, count(*) n_scored, coalesce(sum(p::INTEGER), 0)::BIGINT n_pure FROM g")
def r072_cluster_purity(spark, sf_dir):
    k = graphs.components(_edges(spark, sf_dir))
    c = table(spark, sf_dir, "elliptic_txs_classes").withColumn("y", F.trim("class")).filter("y in ('1', '2')").groupBy("txId").agg(F.min("y").alias("y"))
    x = fusion.cluster_purity(k.join(c, F.col("node") == F.col("txId")), "component", "y")
    return x.select(F.round("plain", 9).alias("plain"), F.round("weighted", 9).alias("weighted"), "n_scored", "n_pure")


@query(f"SELECT round(least(greatest(avg(y), 1e-6), 1 - 1e-6), 9) prior FROM {SCORED}")
def r073_prior(spark, sf_dir):
    return fusion.prior(scored(spark, sf_dir), "y").select(F.round("prior", 9).alias("prior"))


PSEUDO = f"(SELECT vec_id, label, row_number() OVER (ORDER BY vec[1], vec_id) / (count(*) OVER () + 1) u, row_number() OVER (ORDER BY vec[2], vec_id) / (count(*) OVER () + 1) v FROM {VEC})"


def _pseudo(spark, sf_dir):
    x = _vec(spark, sf_dir).select("vec_id", "label", F.get("vec", F.lit(0)).alias("a"), F.get("vec", F.lit(1)).alias("b"))
    return fusion.pseudo_observations(x, ["a", "b"], "vec_id").select("vec_id", "label", F.col("u_a").alias("u"), F.col("u_b").alias("v"))


@query(f"SELECT vec_id, round(u, 9) u, round(v, 9) v FROM {PSEUDO}")
def r086_pseudo_observations(spark, sf_dir):
    return _pseudo(spark, sf_dir).select("vec_id", F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))


@query(f"""WITH x AS (SELECT u, v, theta FROM {PSEUDO}, (SELECT unnest([0.2, 0.5, 1.0, 2.0, 5.0]::DOUBLE[]) theta)) SELECT 'clayton' family, theta, round(sum(ln((1 + theta) * pow(u * v, -1 - theta) * pow(pow(u, -theta) + pow(v, -theta) - 1, -2 - 1 / theta))), 4) loglik FROM x GROUP BY theta
UNION ALL SELECT 'gumbel', theta, round(sum(ln(exp(-pow(s, 1 / theta)) / (u * v) * pow(ln(u) * ln(v), theta - 1) * pow(s, 1 / theta - 2) * (pow(s, 1 / theta) + theta - 1))), 4) FROM (SELECT u, v, theta, pow(-ln(u), theta) + pow(-ln(v), theta) s FROM {PSEUDO}, (SELECT unnest([1.1, 1.5, 2.0, 3.0, 5.0]::DOUBLE[]) theta)) GROUP BY theta
UNION ALL SELECT 'frank', theta, round(sum(ln(theta * (1 - exp(-theta)) * exp(-theta * (u + v)) / pow(1 - exp(-theta) - (1 - exp(-theta * u)) * (1 - exp(-theta * v)), 2))), 4) FROM (SELECT u, v, theta FROM {PSEUDO}, (SELECT unnest([0.5, 1.0, 2.0, 5.0, 9.0]::DOUBLE[]) theta)) GROUP BY theta""")
def r123_copula_fit(spark, sf_dir):
    p = _pseudo(spark, sf_dir)
    out = None
    for family in ("clayton", "gumbel", "frank"):
        x = fusion.fit_copula(p, family, "u", "v").select(F.lit(family).alias("family"), "theta", F.round("loglik", 4).alias("loglik"))
        out = x if out is None else out.unionByName(x)
    return out


@query(f"""WITH x AS (SELECT 'grp' "column", grp AS value, y FROM {SCORED} UNION ALL SELECT 'step', step::VARCHAR, y FROM {SCORED}), c AS (SELECT "column", value, sum(y) p, sum(1 - y) n FROM x GROUP BY 1, 2), t AS (SELECT "column", sum(p) tp, sum(n) tn, count(*) k FROM c GROUP BY 1)
SELECT "column", value, round(ln(((p + 1) / (tp + k)) / ((n + 1) / (tn + k))), 6) log_ratio FROM c JOIN t USING ("column")""")
def r124_binned_bayes(spark, sf_dir):
    return fusion.binned_bayes(scored(spark, sf_dir), ["grp", "step"], "y").select("column", "value", F.round("log_ratio", 6).alias("log_ratio"))


# evidence


@query("SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"user\":' || user_id || ',\"value\":' || printf('%.2f', value) || '}') h FROM events")
def r141_evidence_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    return e.select("event_id", evidence.digest(evidence.canonical({"event_type": q("event_type"), "user": F.col("user_id").cast("string"), "value": F.format_string("%.2f", "value")})).alias("h"))


def _merkle_sql() -> str:
    leaf = "l0 AS (SELECT n_nationkey::BIGINT pos, sha256(n_name) h FROM nation)"
    parts = [leaf]
    for i in range(5):  # 25 nations
        parts.append(f"l{i + 1} AS (SELECT pos // 2 pos, sha256(unhex(arg_min(h, pos)) || unhex(arg_max(h, pos))) h FROM l{i} GROUP BY pos // 2)")
    return f"WITH {', '.join(parts)} SELECT h root, (SELECT count(*) FROM nation) n_leaves FROM l5"


@query(_merkle_sql())
def r142_merkle_root(spark, sf_dir):
    return evidence.merkle_root(table(spark, sf_dir, "nation"), "n_nationkey", "n_name")
