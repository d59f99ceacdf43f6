"""What changed between full snapshots.

The last snapshot is kept as an index: keys and a hash of the attributes, in buckets by key.  A new snapshot is reduced to the
same form and buckets (one shuffle of its own rows), probes the index bucket by bucket without another shuffle, and takes its
place.  Old values are fetched, from rows kept in the same buckets, only for keys that changed or went.  A delivery costs as
much as the two snapshots it compares, however many came before.

A version is valid once its marker stands; the marker is made after all tables of the version are written, so an
interrupted delivery leaves the old version in force and is cleared away when the index is opened again.  The tables of the
version before go once the new one is valid; the changes of every version stay.

Defined results: records with a null key are no records; repeated records count once; a key that comes several times in a
snapshot with different attributes is compared by the set of them; null differs from any value.  Other columns of the rows
are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def attribute_hash(attributes: list[Column]) -> Column:
    """Hash of the attributes; null differs from any value."""
    return F.xxhash64(*[x for a in attributes for x in (a.isNull(), a)])


def key_index(rows: DataFrame, keys: list[str], hash_col: str = "h") -> DataFrame:
    """(keys, h): one row per key, h independent of order and repetition of its records."""
    once = rows.select(*keys, hash_col).distinct()
    return once.groupBy(*keys).agg(F.expr(f"bit_xor(xxhash64({hash_col}))").alias("h"), F.count(F.lit(1)).alias("n")).select(*keys, F.xxhash64("h", "n").alias("h"))


class SnapshotIndex:
    """Bucketed key-to-hash index of the last snapshot, kept in a folder all executors share.

    ``series`` names the key column, if any, whose values are delivered apart from each other (the source of a list).
    ``buckets`` holds for a new index; one that is there already keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], attributes: list[str], buckets: int = 64, series: str | None = None):
        self.spark, self.path, self.keys, self.attributes, self.series = spark, path.rstrip("/"), keys, attributes, series
        self.name = f"lw_{uuid.uuid4().hex}"
        root = self._at("")
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(root)
        names = [s.getPath().getName() for s in self.fs.listStatus(root)]
        known = [int(n[8:]) for n in names if n.startswith("buckets=")]
        self.buckets = known[0] if known else buckets
        if not known:
            self.fs.mkdirs(self._at(f"buckets={buckets}"))
        started = [int(n[1:]) for n in names if n.startswith("v")]
        self.version = max((v for v in started if self.fs.exists(self._at(f"v{v}/_VALID"))), default=0)
        for v in started:
            if v > self.version:
                self.fs.delete(self._at(f"v{v}"), True)
        if self.version:
            for kind in ("index", "rows"):
                self._open(self.version, kind)

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _name(self, version: int, kind: str) -> str:
        return f"{self.name}_{kind}_{version}"

    def _open(self, version: int, kind: str) -> None:
        """Name the bucketed files of an earlier process in this session."""
        at = f"{self.path}/v{version}/{kind}"
        columns = self.spark.read.parquet(at)._jdf.schema().toDDL()
        by = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(f"CREATE TABLE {self._name(version, kind)} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{at}'")

    def _write(self, df: DataFrame, version: int, kind: str) -> DataFrame:
        df.write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.path}/v{version}/{kind}").saveAsTable(self._name(version, kind))
        return self.spark.table(self._name(version, kind))

    def _drop(self, version: int) -> None:
        for kind in ("index", "rows"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(version, kind)}")
            self.fs.delete(self._at(f"v{version}/{kind}"), True)

    def changes(self) -> DataFrame | None:
        """(version, keys, change, old) of all deliveries but the first; null before the second."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at(""))]
        paths = [f"{self.path}/{n}/changes" for n in names if n.startswith("v") and 1 < int(n[1:]) <= self.version]
        return self.spark.read.parquet(*paths) if paths else None

    def advance(self, rows: DataFrame, delivered: list | None = None) -> DataFrame | None:
        """Compare ``rows`` with the last snapshot, then make them the last; the first snapshot has no changes (null).

        Gives (version, keys, change, old), old being the array of the old attributes of changed and removed keys, as JSON.
        With ``series``, only the series in ``delivered`` (a few names) are compared and replaced, the others stay.
        """
        new, old = self.version + 1, self.version
        columns = [*self.keys, *self.attributes]
        part = None if self.series is None or delivered is None else F.col(self.series).isin(delivered)
        rows = rows.select(*columns).dropna(subset=self.keys)
        if part is not None:
            rows = rows.filter(part)
            if old:
                rows = rows.unionByName(self.spark.table(self._name(old, "rows")).filter(~part))
        # the hash of a bucket is that of the exchange: a task holds a bucket, so writing and grouping need no other shuffle
        kept = self._write(rows.distinct().repartition(self.buckets, *self.keys), new, "rows")
        index = self._write(key_index(kept.withColumn("h", attribute_hash([F.col(a) for a in self.attributes])), self.keys).repartition(self.buckets, *self.keys), new, "index")
        if old:
            before = self.spark.table(self._name(old, "index")).withColumnRenamed("h", "h0")
            if part is not None:
                index, before = index.filter(part), before.filter(part)
            probe = index.join(before, self.keys, "full_outer")
            change = F.when(F.col("h0").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("h") != F.col("h0"), "changed")
            probe = probe.select(*self.keys, change.alias("change")).filter("change is not null")
            values = F.to_json(F.struct(*self.attributes), {"ignoreNullFields": "false"})
            stale = self.spark.table(self._name(old, "rows")).join(probe.filter("change != 'added'").select(*self.keys), self.keys, "left_semi")
            stale = stale.groupBy(*self.keys).agg(F.array_sort(F.collect_set(values)).alias("old"))
            probe.join(stale, self.keys, "left").select(F.lit(new).alias("version"), *self.keys, "change", "old").write.parquet(f"{self.path}/v{new}/changes")
        self.fs.create(self._at(f"v{new}/_VALID"), True).close()
        self.version = new
        if old:
            self._drop(old)
            return self.spark.read.parquet(f"{self.path}/v{new}/changes")
        return None

    def close(self) -> None:
        """Forget the session's names of the tables; the files stay."""
        for kind in ("index", "rows"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(self.version, kind)}")
