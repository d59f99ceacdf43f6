"""Classifiers, projections, calibration and Shapley explanations on Spark ML.

Training frames have ``features`` (array of doubles) and ``y`` (0 or 1).  Rows with a null feature get 0 there, NaN too.
Models are fitted distributed; only their parameters reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from ledgerweave.operators import curves, stats
from ledgerweave.plans.staging import Stage

SEED = 72
TINY = 1e-15


def as_vectors(df: DataFrame, features: str = "features", out: str = "__v") -> DataFrame:
    """Adds a vector column; nulls and NaN become 0."""
    return df.withColumn(out, array_to_vector(F.transform(F.col(features).cast("array<double>"), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))))


def positive(df: DataFrame, out: str = "score") -> DataFrame:
    return df.withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).drop("probability", "rawPrediction", "prediction")


def fit_logistic(df: DataFrame, c: float = 1.0):
    """L2 logistic regression whose penalty is that of C = ``c`` over all rows."""
    n = max(1, df.count())
    return LogisticRegression(featuresCol="__v", labelCol="y", standardization=False, regParam=1.0 / (c * n), maxIter=100).fit(as_vectors(df))


def fit_gbt(df: DataFrame, depth: int = 5, rounds: int = 20, step: float = 0.1, weight: str | None = None, seed: int = SEED):
    """Gradient-boosted trees grown by depth; positives weigh as much as negatives unless a weight column is given."""
    if weight is None:
        pos, n = df.agg(F.sum("y"), F.count(F.lit(1))).first()
        df = df.withColumn("__w", F.when(F.col("y") == 1, F.lit(min(50.0, (n - (pos or 0)) / max(1, pos or 0)))).otherwise(1.0))
    g = GBTClassifier(featuresCol="__v", labelCol="y", weightCol=weight or "__w", maxDepth=depth, maxIter=rounds, stepSize=step, minInstancesPerNode=10, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    return g.fit(as_vectors(df))


def fit_forest(df: DataFrame, trees: int = 50, depth: int = 8, seed: int = SEED):
    return RandomForestClassifier(featuresCol="__v", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed).fit(as_vectors(df))


def score(model, df: DataFrame, out: str = "score") -> DataFrame:
    return positive(model.transform(as_vectors(df)), out).drop("__v")


def select_depth(train: DataFrame, valid: DataFrame, key: str, depths: tuple[int, ...] = (3, 5, 7), rounds: int = 10, replicates: int = 50):
    """(depth, models): from the deepest down, the shallower model wins unless the deeper one's gain in Brier score has a bootstrap interval above 0."""
    models = {d: fit_gbt(train, d, rounds) for d in depths}
    best = max(depths)
    for d in sorted(depths, reverse=True)[1:]:
        a = score(models[best], valid, "a").select(key, "y", "a").join(score(models[d], valid, "b").select(key, "b"), key)
        gain = F.pow(F.col("b") - F.col("y"), 2) - F.pow(F.col("a") - F.col("y"), 2)
        lo = stats.percentile_interval(stats.bootstrap_means(a.withColumn("gain", gain), key, "gain", replicates)).first()["lo"]
        if lo is None or lo <= 0:
            best = d
    return best, models


def fit_pca(df: DataFrame, k: int, vec: str = "vec"):
    """Function that adds ``pca``: components of the centred vectors, fitted on ``df`` only."""
    v = as_vectors(df, vec)
    center = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(v)
    model = PCA(k=k, inputCol="__c", outputCol="__p").fit(center.transform(v))

    def transform(x: DataFrame) -> DataFrame:
        return model.transform(center.transform(as_vectors(x, vec))).withColumn("pca", vector_to_array("__p")).drop("__v", "__c", "__p")

    return transform


def clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(TINY)), F.lit(1 - TINY))


class Isotonic:
    """Monotone step-linear calibration, clamped beyond the seen scores."""

    def __init__(self, df: DataFrame, p: str = "score", y: str = "y"):
        self.model = IsotonicRegression(featuresCol="__p", labelCol="__y").fit(df.select(F.col(p).alias("__p"), F.col(y).cast("double").alias("__y")))

    def transform(self, df: DataFrame, p: str = "score", out: str = "calibrated") -> DataFrame:
        return self.model.transform(df.withColumn("__p", F.col(p))).withColumn(out, clip(F.col("prediction"))).drop("__p", "prediction")


class Beta:
    """Beta calibration: logistic regression on ln p and -ln (1 - p)."""

    def __init__(self, df: DataFrame, p: str = "score", y: str = "y"):
        x = df.select(self._features(F.col(p)).alias("__v"), F.col(y).cast("double").alias("y"))
        self.model = LogisticRegression(featuresCol="__v", labelCol="y", regParam=0.0, standardization=False, maxIter=200).fit(x)

    @staticmethod
    def _features(p: Column) -> Column:
        c = clip(p)
        return array_to_vector(F.array(F.log(c), -F.log(1 - c)))

    def transform(self, df: DataFrame, p: str = "score", out: str = "calibrated") -> DataFrame:
        w, b = self.model.coefficients.toArray(), float(self.model.intercept)
        c = clip(F.col(p))
        return df.withColumn(out, clip(1 / (1 + F.exp(-(float(w[0]) * F.log(c) - float(w[1]) * F.log(1 - c) + b)))))


class Sigmoid:
    """Sigmoid calibration: logistic regression on the score."""

    def __init__(self, df: DataFrame, p: str = "score", y: str = "y"):
        x = df.select(array_to_vector(F.array(F.col(p).cast("double"))).alias("__v"), F.col(y).cast("double").alias("y"))
        self.model = LogisticRegression(featuresCol="__v", labelCol="y", regParam=0.0, standardization=False, maxIter=200).fit(x)

    def transform(self, df: DataFrame, p: str = "score", out: str = "calibrated") -> DataFrame:
        w, b = float(self.model.coefficients[0]), float(self.model.intercept)
        return df.withColumn(out, clip(1 / (1 + F.exp(-(w * F.col(p) + b)))))


def calibrate(df: DataFrame, key: str, p: str = "score", y: str = "y", replicates: int = 50):
    """Isotonic if its squared error is below beta's with a bootstrap interval beyond 0, else beta."""
    iso, beta = Isotonic(df, p, y), Beta(df, p, y)
    both = beta.transform(iso.transform(df, p, "__i"), p, "__b")
    gap = both.withColumn("__g", F.pow(F.col("__i") - F.col(y), 2) - F.pow(F.col("__b") - F.col(y), 2))
    hi = stats.percentile_interval(stats.bootstrap_means(gap, key, "__g", replicates)).first()["hi"]
    return iso if hi is not None and hi < 0 else beta


def tree_nodes(model) -> list[tuple[float, list]]:
    """(weight, nodes) of each tree, nodes as (feature, threshold, left, right, value, rows) in preorder; rows were seen in training."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        nodes: list = []

        def walk(n) -> int:
            at = len(nodes)
            nodes.append(None)
            value, rows = float(n.prediction()), float(n.impurityStats().count())
            if n.subtreeDepth() > 0:
                split = n.split()
                left, right = walk(n.leftChild()), walk(n.rightChild())
                nodes[at] = (int(split.featureIndex()), float(split.threshold()), left, right, value, rows)
            else:
                nodes[at] = (-1, 0.0, -1, -1, value, rows)
            return at

        walk(tree._call_java("rootNode"))
        out.append((float(weight), nodes))
    return out


def leaf_games(trees: list[tuple[float, list]]) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """(value, players) of every leaf: a player is a feature of its path, with the interval the path asks of it and the share of
    the training rows that go the leaf's way where the feature is not known."""
    out = []
    for weight, nodes in trees:
        def walk(at: int, players: dict[int, tuple[float, float, float]]) -> None:
            f, t, left, right, value, rows = nodes[at]
            if f < 0:
                out.append((weight * value, [(j, *p) for j, p in players.items()]))
                return
            lo, hi, share = players.get(f, (-np.inf, np.inf, 1.0))
            for child, a, b in ((left, lo, min(hi, t)), (right, max(lo, t), hi)):
                walk(child, players | {f: (a, b, share * nodes[child][5] / rows)})

        walk(0, {})
    return out


def shapley_values(games: list, x: np.ndarray) -> np.ndarray:
    """Shapley values of each row and feature: exact, leaf by leaf.

    In a leaf's game a coalition earns the leaf's value times, for each player, whether the row goes the leaf's way (a member)
    or the share of training rows that do (no member).  The sums over coalitions of one size are coefficients of a product of
    linear terms, so a leaf costs the square of its depth.
    """
    out = np.zeros_like(x)
    for value, players in games:
        d = len(players)
        if not d:
            continue
        goes = [((x[:, j] > lo) & (x[:, j] <= hi)).astype(float) for j, lo, hi, _ in players]
        share = [p[3] for p in players]
        size = [1.0 / (d * math.comb(d - 1, k)) for k in range(d)]
        for i, (j, *_) in enumerate(players):
            terms = np.zeros((d, len(x)))  # coalitions of the others, by size
            terms[0] = 1.0
            for o in range(d):
                if o != i:
                    terms[1:] = terms[1:] * share[o] + terms[:-1] * goes[o]
                    terms[0] *= share[o]
            out[:, j] += value * (goes[i] - share[i]) * sum(s * t for s, t in zip(size, terms))
    return out


def contributions(model, df: DataFrame, key: str, features: str = "features") -> DataFrame:
    """(key, contributions): Shapley values of the trees' sum for each row, by feature.

    The leaves, of a number fixed in training, go with the function; rows are explained batch by batch.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    games = leaf_games(tree_nodes(model))
    kind = df.schema[key]

    def run(batches):
        for b in batches:
            n = b.num_rows
            if n:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(shapley_values(games, x)), type=pa.list_(pa.float64()))], [kind.name, "contributions"])

    clean = F.transform(F.col(features).cast("array<double>"), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    return df.select(key, clean.alias("f")).mapInArrow(run, T.StructType([kind, T.StructField("contributions", T.ArrayType(T.DoubleType()))]))


def metrics(df: DataFrame, p: str = "score", y: str = "y", bins: int = 10) -> DataFrame:
    """(ap, auc, brier, ece) as one row."""
    s = curves.score_steps(df, p, y)
    d = F.col(p) - F.col(y)
    one = curves.average_precision(s).join(F.broadcast(curves.roc_auc(s))).join(F.broadcast(df.agg(F.avg(d * d).alias("brier")))).join(F.broadcast(curves.ece(curves.reliability(df, p, y, bins))))
    return one.select("ap", "auc", "brier", "ece")


class RiskPipeline:
    """Features in, calibrated scores, thresholds and explanations out."""

    def __init__(self, names: list[str], key: str, c_fp: float = 1.0, c_fn: float = 20.0, budget: float | None = None, rounds: int = 10):
        self.names, self.key, self.c_fp, self.c_fn, self.budget, self.rounds = names, key, c_fp, c_fn, budget, rounds

    def fit(self, train: DataFrame, valid: DataFrame) -> "RiskPipeline":
        self.depth, models = select_depth(train, valid, self.key, rounds=self.rounds)
        self.model = models[self.depth]
        raw = score(self.model, valid)
        half = F.pmod(F.xxhash64(self.key), F.lit(2))
        self.calibrator = calibrate(raw.filter(half == 0), self.key)
        rest = self.calibrator.transform(raw.filter(half == 1))
        steps = curves.score_steps(rest, "calibrated", "y")
        limit = None if self.budget is None else int(self.budget * rest.count())
        best = curves.best_threshold(curves.cost_curve(steps, self.c_fp, self.c_fn), limit).first()
        self.tau = float(best["tau"]) if best else 1.0
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.calibrator.transform(score(self.model, df))

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``calibrated``, ``alert`` and ``contributions`` (the ten largest, by name)."""
        from ledgerweave.operators.evidence import top_contributions

        why = contributions(self.model, df, self.key).withColumn("contributions", top_contributions(F.col("contributions"), self.names))
        return self.predict_proba(df).withColumn("alert", F.col("calibrated") >= self.tau).join(why, self.key)

    def evaluate(self, df: DataFrame) -> DataFrame:
        return metrics(self.predict_proba(df), "calibrated")


def decay_weight(step: Column, last: int, rate: float) -> Column:
    return F.exp(-rate * (F.lit(last) - step))


def focal_gradient(z: Column, y: Column, alpha: float, gamma: float) -> Column:
    """Derivative by the margin ``z`` of the focal loss -a (1 - q)^gamma log q, q the probability given to the true class."""
    q = clip(1 / (1 + F.exp(-F.when(y == 1, z).otherwise(-z))))
    g = F.pow(1 - q, F.lit(gamma)) * (gamma * q * F.log(q) - (1 - q))
    return F.when(y == 1, alpha * g).otherwise(-(1 - alpha) * g)


class FocalBoost:
    """Trees boosted on the focal loss: each fits the Newton step of the loss at the margins so far.

    Margins are staged after every round, so a plan holds one tree at a time while fitting.
    """

    def __init__(self, rounds: int = 20, depth: int = 5, step: float = 0.1, alpha: float = 0.25, gamma: float = 2.0, seed: int = SEED):
        self.rounds, self.depth, self.step, self.alpha, self.gamma, self.seed = rounds, depth, step, alpha, gamma, seed
        self.start, self.trees = 0.0, []

    def _newton(self, df: DataFrame) -> DataFrame:
        """Adds the Newton step and its weight; the second derivative, by central difference, is kept above 0."""
        g = lambda z: focal_gradient(z, F.col("y"), self.alpha, self.gamma)
        z, e = F.col("__z"), 1e-3
        h = F.greatest((g(z + e) - g(z - e)) / (2 * e), F.lit(1e-4))
        return df.withColumn("__h", h).withColumn("__t", F.greatest(F.least(-g(z) / F.col("__h"), F.lit(8.0)), F.lit(-8.0)))

    def fit(self, df: DataFrame) -> FocalBoost:
        stage = Stage(df.sparkSession)
        rate = df.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.5
        self.start = math.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
        now = stage.write(as_vectors(df).select("__v", F.col("y").cast("double").alias("y"), F.lit(self.start).alias("__z")))
        for i in range(self.rounds):
            tree = DecisionTreeRegressor(featuresCol="__v", labelCol="__t", weightCol="__h", maxDepth=self.depth, minInstancesPerNode=10, predictionCol="__p", seed=self.seed + i).fit(self._newton(now))
            self.trees.append(tree)
            new = stage.write(tree.transform(now).select("__v", "y", (F.col("__z") + self.step * F.col("__p")).alias("__z")))
            stage.drop(now)
            now = new
        stage.drop(now)
        return self

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        x = as_vectors(df).withColumn("__z", F.lit(self.start))
        for tree in self.trees:
            x = tree.transform(x).withColumn("__z", F.col("__z") + self.step * F.col("__p")).drop("__p")
        return x.withColumn(out, 1 / (1 + F.exp(-F.col("__z")))).drop("__v", "__z")


def blend(parts: list[tuple[float, str]]) -> Column:
    out = F.lit(0.0)
    for w, c in parts:
        out = out + w * F.col(c)
    return out
