"""Where results go: Parquet, JSON, CSV and catalog tables."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def write_clusters(clusters: DataFrame, path: str) -> None:
    """Members by cluster, range-sorted, as Parquet."""
    clusters.repartitionByRange("cluster_id").sortWithinPartitions("cluster_id").write.mode("overwrite").parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metrics as JSON lines, in as many files as the table has partitions."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A catalog table bucketed by its join key: later joins on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def create_iceberg(spark: SparkSession, name: str, columns: str) -> bool:
    """Create an Iceberg table; false, and nothing else, where the session has no such format.  Any other fault is an error."""
    try:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING iceberg")
    except (PySparkException, Py4JJavaError) as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e):
            return False
        raise
    return True


def write_model(model, path: str) -> None:
    """A fitted model of the ml package, in its own format."""
    model.write().overwrite().save(path)
