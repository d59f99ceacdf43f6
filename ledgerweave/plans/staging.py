"""Tables written between jobs, in the folder all executors share.

A staged table cuts the lineage like ``checkpoint()`` does, is compressed and column-pruned when read again,
and survives the loss of any executor.  ``localCheckpoint`` is never used.

A lazy result reads staged tables until it has been written, so they live until the caller says it is: ``with
clearing(spark):`` around query and write removes all that was staged inside it, ``clear(spark)`` all that is left.  Tables
that no later plan reads are dropped by the operators themselves; what remains at the end of the process is removed then.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}  # temporary folder of a local application
_OPEN: dict[str, SparkSession] = {}  # roots with staged tables


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session that names none gets a temporary one, elsewhere that is an error."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"{KEY} names no folder that the executors of {master} share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="ledgerweave-")
            atexit.register(shutil.rmtree, _LOCAL[app], True)
        found = f"file://{_LOCAL[app]}"
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession, keep: set[str] | None = None) -> None:
    """Remove every staged table of this process, but those under the roots in ``keep``."""
    for root in [r for r in _OPEN if r not in (keep or ())]:
        del _OPEN[root]
        _delete(spark, root)


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what is staged inside; results must have been written by then."""
    before = set(_OPEN)
    try:
        yield
    finally:
        clear(spark, before)


@atexit.register
def _at_exit() -> None:
    for root, spark in list(_OPEN.items()):
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001 - the session has ended before; its folder is the cluster's to clear
            return


class Stage:
    """Names and removes the staged tables of one query run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lw-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Write ``df``, in folders by the column ``by`` if given, and return it as read back; its path is kept in ``df.staged_at``."""
        self.count += 1
        _OPEN[self.root] = self.spark
        path = f"{self.root}/{self.count}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.staged_at = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Remove staged tables that no later plan reads."""
        for df in tables:
            _delete(self.spark, df.staged_at)
