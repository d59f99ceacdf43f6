"""Step counts and last flagged times over a stream of events: an addition to the batch operators.

Late events are taken up to the watermark.  The stream's counts per step are those of the batch operator on the same events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def step_counts(events: DataFrame, ts: str, flag: str, step: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, n, flagged) per tumbling step."""
    t = F.col(ts).cast("timestamp")
    w = events.withColumn("__t", t).withWatermark("__t", late).groupBy(F.window("__t", step).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(flag), 1).otherwise(0)).alias("flagged")).select(F.col("w.start").alias("start"), "n", "flagged")


def last_flagged(events: DataFrame, key: str, ts: str, flag: str) -> DataFrame:
    """(key, n, last): per key the events so far and the time of the last flagged one, kept as state."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        for pdf in frames:
            n += len(pdf)
            hit = pdf.loc[pdf["f"], "t"]
            if len(hit):
                m = float(hit.max())
                last = m if last is None or m > last else last
        state.update((n, last))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "last": [last]})

    x = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").cast("double").alias("t"), F.coalesce(F.col(flag), F.lit(False)).alias("f"))
    return x.groupBy("key").applyInPandasWithState(update, "key long, n long, last double", "n long, last double", "update", GroupStateTimeout.NoTimeout)
