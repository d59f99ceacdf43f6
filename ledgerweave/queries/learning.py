"""Queries of the learning operators; where SQL can state the result, it is given."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerweave.ml import models
from ledgerweave.operators import curves, graphs, losses, vectors
from ledgerweave.plans.staging import Stage
from ledgerweave.queries.risk import EDGES, SCORED, VEC, _vec, scored
from ledgerweave.sources.elliptic import labelled, with_split
from ledgerweave.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
NAMES = [f"feat_{i}" for i in range(2, 167)]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def frame(spark, sf_dir):
    """Labelled transactions (newest row and label of each) with their features in one array."""
    f = table(spark, sf_dir, "elliptic_txs_features").filter("txId is not null and time_step is not null")
    cols = F.array(*[F.when(F.col(c).between(-50, 50), F.col(c)).otherwise(0.0) for c in NAMES])
    f = f.groupBy("txId").agg(F.max_by(F.struct(F.col("time_step"), cols.alias("features")), F.struct("load_id", "loaded_at")).alias("x")).select("txId", "x.*")
    c = labelled(table(spark, sf_dir, "elliptic_txs_classes")).groupBy("txId").agg(F.max_by("y", F.struct("load_id", "loaded_at", "y")).alias("y"))
    return with_split(Stage(spark).write(f.join(c, "txId")), "time_step")


def _split(df):
    return (df.filter(F.col("split") == s) for s in ("train", "valid", "test"))


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) for c in df.columns])


@query()
def r109_retrieval_frames(spark, sf_dir):
    v = _vec(spark, sf_dir)
    pca = models.fit_pca(v.filter("step <= 30"), 32)(v)
    bad = vectors.nearest(pca, "vec_id", "pca", pca.filter("label = 1 and step <= 30"), "vec_id", "pca", 10, exclude_self=True)
    good = vectors.nearest(pca, "vec_id", "pca", pca.filter("label != 1 and step <= 30"), "vec_id", "pca", 10, exclude_self=True)
    both = bad.withColumn("bad", F.lit(1)).unionByName(good.withColumn("bad", F.lit(0)))
    w = F.row_number().over(W.partitionBy("l").orderBy("dist", "r"))
    return both.withColumn("k", w).filter("k <= 10").groupBy(F.col("l").alias("vec_id")).agg(F.avg("bad").alias("frac_bad"), F.min("dist").alias("d_min"), F.avg("dist").alias("d_mean"))


@query()
def r110_pca(spark, sf_dir):
    v = _vec(spark, sf_dir)
    return models.fit_pca(v.filter("step <= 30"), 32)(v).select("vec_id", "pca")


@query(f"""WITH u AS (SELECT vec_id, vec, sqrt(list_dot_product(vec, vec)) n FROM {VEC}), s AS (SELECT a.vec_id l, b.vec_id r, list_dot_product(a.vec, b.vec) / (a.n * b.n) / 0.5 z FROM u a JOIN u b ON a.vec_id <> b.vec_id), e AS (SELECT l, ln(sum(exp(z))) lse, max(z) FILTER (WHERE r = l + CASE WHEN l % 2 = 0 THEN 1 ELSE -1 END) p FROM s GROUP BY l)
SELECT round(avg(lse - p), 6) loss FROM e WHERE p IS NOT NULL""")
def r119_nt_xent(spark, sf_dir):
    return losses.nt_xent(_vec(spark, sf_dir), "vec_id", "vec", 0.5).select(F.round("loss", 6).alias("loss"))


@query(f"""WITH d AS (SELECT a.label la, b.label lb, list_distance(a.vec, b.vec) d FROM {VEC} a JOIN {VEC} b ON a.step = b.step AND a.vec_id < b.vec_id) SELECT round((SELECT avg(greatest(0, d - 0.5)) FROM d WHERE la = lb) + (SELECT avg(greatest(0, 1.5 - d)) FROM d WHERE la <> lb), 6) loss""")
def r120_anchor_loss(spark, sf_dir):
    return losses.anchor_loss(_vec(spark, sf_dir), "vec_id", "vec", "label", "step", 0.5, 1.5).select(F.round("loss", 6).alias("loss"))


@query(f"""WITH u AS (SELECT vec_id, label, vec, sqrt(list_dot_product(vec, vec)) n FROM {VEC}), a AS (SELECT * FROM u WHERE vec_id % 2 = 0), b AS (SELECT * FROM u WHERE vec_id % 2 = 1),
s AS (SELECT a.vec_id l, b.vec_id r, list_dot_product(a.vec, b.vec) / (a.n * b.n) / 0.5 z FROM a, b), e AS (SELECT l, ln(sum(exp(z))) lse, max(z) FILTER (WHERE r = l + 1) p FROM s GROUP BY l) SELECT round(avg(lse - p), 6) loss FROM e WHERE p IS NOT NULL""")
def r121_cross_type_loss(spark, sf_dir):
    v = _vec(spark, sf_dir)
    a, b = v.filter("vec_id % 2 = 0"), v.filter("vec_id % 2 = 1").withColumnRenamed("vec_id", "oid")
    pairs = a.select("vec_id", (F.col("vec_id") + 1).alias("oid"))
    return losses.cross_type_loss(a, "vec_id", "vec", b, "oid", "vec", pairs, 0.5).select(F.round("loss", 6).alias("loss"))


@query()
def r122_logistic(spark, sf_dir):
    train, _, test = _split(frame(spark, sf_dir))
    return _rounded(models.metrics(models.score(models.fit_logistic(train), test)))


@query()
def r125_gbt(spark, sf_dir):
    train, valid, test = _split(frame(spark, sf_dir))
    depth, fitted = models.select_depth(train, valid, "txId")
    return _rounded(models.metrics(models.score(fitted[depth], test))).withColumn("depth", F.lit(depth))


@query()
def r126_focal_gbt(spark, sf_dir):
    train, _, test = _split(frame(spark, sf_dir))
    return _rounded(models.metrics(models.FocalBoost(10, 3).fit(train).score(test)))


def _calibration(spark, sf_dir, how):
    train, valid, test = _split(frame(spark, sf_dir))
    m = models.fit_gbt(train, 3, 10)
    return _rounded(models.metrics(how(models.score(m, valid)).transform(models.score(m, test)), "calibrated"))


@query()
def r127_isotonic(spark, sf_dir):
    return _calibration(spark, sf_dir, models.Isotonic)


@query()
def r139b_sigmoid(spark, sf_dir):
    return _calibration(spark, sf_dir, models.Sigmoid)


@query()
def r128_beta(spark, sf_dir):
    return _calibration(spark, sf_dir, models.Beta)


@query()
def r129_calibrate(spark, sf_dir):
    return _calibration(spark, sf_dir, lambda df: models.calibrate(df, "txId"))


@query()
def r130_shapley(spark, sf_dir):
    train, _, test = _split(frame(spark, sf_dir))
    return models.contributions(models.fit_gbt(train, 3, 10), test, "txId")


@query()
def r131_pipeline(spark, sf_dir):
    train, valid, test = _split(frame(spark, sf_dir))
    return models.RiskPipeline(NAMES, "txId").fit(train, valid).predict(test).select("txId", "time_step", "y", "calibrated", "alert", "contributions")


@query(f"SELECT id, l_partkey, round(0.25 * score + 0.75 * (qty / 50), 9) blended FROM {SCORED}")
def r132_blend(spark, sf_dir):
    x = scored(spark, sf_dir).withColumn("other", F.col("qty") / 50)
    return x.select("id", "l_partkey", F.round(models.blend([(0.25, "score"), (0.75, "other")]), 9).alias("blended"))


@query(f"""WITH t AS (SELECT txId, min(time_step) t, count(*) n FROM elliptic_txs_features WHERE txId IS NOT NULL GROUP BY txId HAVING min(time_step) IS NOT NULL) SELECT e.dst txId, round(avg(t), 6) step_mean, round(avg(n), 6) rows_mean FROM {EDGES} e JOIN t ON t.txId = e.src GROUP BY e.dst""")
def r133_neighbour_mean(spark, sf_dir):
    e = graphs.clean_edges(table(spark, sf_dir, "elliptic_txs_edgelist"), "txId1", "txId2")
    n = table(spark, sf_dir, "elliptic_txs_features").filter("txId is not null").groupBy("txId").agg(F.min("time_step").alias("t"), F.count(F.lit(1)).alias("n")).filter("t is not null")
    x = losses.neighbour_mean(e, n.withColumn("v", F.array(F.col("t").cast("double"), F.col("n").cast("double"))), "txId", "v")
    return x.select("txId", F.round(F.get("agg", F.lit(0)), 6).alias("step_mean"), F.round(F.get("agg", F.lit(1)), 6).alias("rows_mean"))


@query()
def r138_decay_grid(spark, sf_dir):
    """Eighteen settings of depth, step and decay of the weight of older rows; the best average precision on the valid era is chosen."""
    train, valid, _ = _split(frame(spark, sf_dir))
    settings = [(i, *s) for i, s in enumerate(product((3, 5, 7), (0.05, 0.1, 0.2), (0.0, 0.05)))]
    scored_ = None
    for i, depth, step, rate in settings:
        m = models.fit_gbt(train.withColumn("w", models.decay_weight(F.col("time_step"), 30, rate)), depth, 5, step, weight="w")
        x = models.score(m, valid).select(F.lit(i).alias("setting"), "score", "y")
        scored_ = x if scored_ is None else scored_.unionByName(x)
    scored_ = Stage(spark).write(scored_)
    steps = curves.score_steps(scored_, "score", "y", ["setting"])
    brier = scored_.groupBy("setting").agg(F.avg(F.pow(F.col("score") - F.col("y"), 2)).alias("brier"))
    x = spark.createDataFrame(settings, "setting int, depth int, step double, rate double").join(curves.average_precision(steps, ["setting"]), "setting").join(curves.roc_auc(steps, ["setting"]), "setting").join(brier, "setting")
    best = x.agg(F.min_by("setting", F.struct((-F.col("ap")).alias("a"), "setting")).alias("best"))
    x = x.join(F.broadcast(best)).withColumn("chosen", F.col("setting") == F.col("best")).drop("best")
    return x.select("setting", "depth", "step", "rate", *[F.round(c, 9).alias(c) for c in ("ap", "auc", "brier")], "chosen")


@query()
def r139_forest(spark, sf_dir):
    train, _, test = _split(frame(spark, sf_dir))
    return _rounded(models.metrics(models.score(models.fit_forest(train), test)))
