"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot from this share of all rows on; by the pigeonhole principle there are at most ``1 / HOT`` hot keys.
HOT = 0.002
#: Bits of a bitmap.
MAX_BITS = 1 << 24


def hot_keys(df: DataFrame, key: str, share: float = HOT) -> list:
    """Keys of ``df`` with at least ``share`` of its rows: at most ``1 / share`` of them, whatever the size of ``df``."""
    sizes = df.groupBy(key).count()
    total = df.count()
    return [r[0] for r in sizes.filter(F.col("count") >= max(2.0, share * total)).select(key).collect()]


def skew_join(rows: DataFrame, lookup: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """Inner (or left) join of ``rows`` with ``lookup`` (one row per key); keys in ``hot`` go by a broadcast of at most ``len(hot)`` rows."""
    if not hot:
        return rows.join(lookup, key, how)
    is_hot = F.col(key).isin(hot)
    cold = rows.filter(~is_hot).join(lookup.filter(~is_hot), key, how)
    return cold.unionByName(rows.filter(is_hot).join(F.broadcast(lookup.filter(is_hot)), key, how))


def maybe_among(df: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """Rows whose key may be one of ``keys`` (one column, ``n`` rows), and none that is left out is; by a broadcast bitmap of at most ``MAX_BITS`` bits."""
    bits = min(MAX_BITS, 1 << max(16, (16 * n).bit_length()))
    p, q = (F.pmod(F.xxhash64(F.col(c).cast(df.schema[key].dataType)), F.lit(bits)) for c in (keys.columns[0], key))
    # at most bits / 64 rows, 262,144 of them at the largest
    bitmap = keys.select((p / 64).cast("int").alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)).cast("int")).alias("bit")).groupBy("__word").agg(F.expr("bit_or(bit)").alias("__bits"))
    out = df.withColumn("__word", (q / 64).cast("int")).join(F.broadcast(bitmap), "__word")
    return out.filter(F.call_function("shiftrightunsigned", F.col("__bits"), F.pmod(q, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1).drop("__word", "__bits")
