"""The labelled transaction graph as delivered in three CSV files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

FEATURES = T.StructType([T.StructField("txId", T.LongType()), T.StructField("time_step", T.DoubleType()), *[T.StructField(f"feat_{i}", T.DoubleType()) for i in range(2, 167)]])
CLASSES = T.StructType([T.StructField("txId", T.LongType()), T.StructField("class", T.StringType())])
EDGES = T.StructType([T.StructField("txId1", T.LongType()), T.StructField("txId2", T.LongType())])


def load_elliptic(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(transactions with class, edges); features have no header, the others do."""
    if "://" not in root and not Path(root).is_dir():
        raise FileNotFoundError(root)
    f = spark.read.schema(FEATURES).csv(f"{root}/elliptic_txs_features.csv").withColumn("time_step", F.col("time_step").cast("int"))
    c = spark.read.schema(CLASSES).option("header", True).csv(f"{root}/elliptic_txs_classes.csv")
    e = spark.read.schema(EDGES).option("header", True).csv(f"{root}/elliptic_txs_edgelist.csv")
    return f.join(c, "txId"), e


def with_split(df: DataFrame, step: str, train_end: int = 30, valid_end: int = 40) -> DataFrame:
    """Adds ``split``; a null step is in none."""
    return df.withColumn("split", F.when(F.col(step) <= train_end, "train").when(F.col(step) <= valid_end, "valid").when(F.col(step) > valid_end, "test"))


def labelled(df: DataFrame, label: str = "class") -> DataFrame:
    """Rows of class 1 or 2 with ``y``."""
    return df.filter(F.trim(label).isin("1", "2")).withColumn("y", (F.trim(label) == "1").cast("int"))
