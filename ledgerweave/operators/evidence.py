"""Evidence records, their hashes, Merkle trees and hash chains, in SQL expressions.

The canonical form of a record is written out field by field, so that a hash does not depend on a JSON writer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerweave.plans.staging import Stage


def top_contributions(values: Column, names: list[str], k: int = 10, digits: int = 5) -> Column:
    """Map of the k largest absolute contributions, rounded; ties by name."""
    pairs = F.transform(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("n"), values.alias("v")), lambda x: F.struct((-F.abs(x["v"])).alias("a"), x["n"].alias("n"), x["v"].alias("v")))
    return F.map_from_entries(F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: F.struct(x["n"], F.round(x["v"], digits))))


def canonical_map(m: Column, digits: int = 5) -> Column:
    """Entries of a map of numbers in the order of their keys."""
    entries = F.array_sort(F.map_entries(m))
    one = lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.format_string(f"%.{digits}f", e["value"]))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, one), ","), F.lit("}"))


def canonical(fields: dict[str, Column]) -> Column:
    """Fields (already text) by name; null fields are left out."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f'"{n}":'), c)) for n, c in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


#: Levels of a tree that one aggregation folds: a group has at most 2 ** FOLD nodes.
FOLD = 10


def _up(a: Column) -> Column:
    """The level above an array of hashes; an odd last node is paired with itself."""
    n = F.size(a)
    at = F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int"))
    return F.transform(at, lambda i: F.sha2(F.concat(F.unhex(F.get(a, 2 * i)), F.unhex(F.get(a, F.least(2 * i + 1, n - 1)))), 256))


def _folded(level: DataFrame, k: int) -> DataFrame:
    """(pos, h) of the nodes ``k`` levels above, with ``__a0`` .. ``__ak``: the hashes of each level below them, in order.

    Only the last group can be short, and it ends where the level ends, so that its odd nodes are the level's.
    """
    g = level.groupBy(F.floor(F.col("pos") / (1 << k)).alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]).alias("__a0"))
    for i in range(k):
        g = g.withColumn(f"__a{i + 1}", _up(F.col(f"__a{i}")))
    return g.withColumn("h", F.get(f"__a{k}", F.lit(0)))


def _leaves(leaves: DataFrame, pos: str, payload: str) -> tuple[DataFrame, int, int]:
    """Staged leaf hashes, their number and the number of levels above them."""
    level = Stage(leaves.sparkSession).write(leaves.select(F.col(pos).cast("long").alias("pos"), F.sha2(F.col(payload).cast("binary"), 256).alias("h")))
    n = level.count()
    return level, n, max(0, n - 1).bit_length()


def merkle_root(leaves: DataFrame, pos: str, payload: str, fold: int = FOLD) -> DataFrame:
    """(root, n_leaves) over leaves at positions 0, 1, ...; null root for no leaves.  A shuffle for every ``fold`` levels."""
    level, n, height = _leaves(leaves, pos, payload)
    while height > 0:
        k = min(fold, height)
        level = _folded(level, k).select("pos", "h")
        height -= k
    return level.agg(F.max("h").alias("root")).withColumn("n_leaves", F.lit(n).cast("long"))


def merkle_proof(leaves: DataFrame, pos: str, payload: str, at: int, fold: int = FOLD) -> DataFrame:
    """(level, sibling, left): hashes beside the path of one leaf; ``left`` if the sibling stands left."""
    level, _, height = _leaves(leaves, pos, payload)
    spark, done, out = leaves.sparkSession, 0, []
    while height > done:
        k = min(fold, height - done)
        group = Stage(spark).write(_folded(level, k))
        row = group.filter(F.col("pos") == (at >> (done + k))).first()  # one group of the path: at most 2 ** (fold + 1) hashes
        for i in range(k):
            a, me = row[f"__a{i}"], (at >> (done + i)) - ((at >> (done + k)) << (k - i))
            other = me - 1 if me % 2 else min(me + 1, len(a) - 1)
            out.append((done + i, a[other], bool(me % 2)))
        level, done = group.select("pos", "h"), done + k
    return spark.createDataFrame(out, "level int, sibling string, left boolean")


def verify_proof(leaf: bytes, proof: list[tuple[str, bool]], root: str) -> bool:
    h = hashlib.sha256(leaf).digest()
    for sibling, left in proof:
        s = bytes.fromhex(sibling)
        h = hashlib.sha256(s + h if left else h + s).digest()
    return h.hex() == root


def chained(df: DataFrame, series: str, order: str, payload: str) -> DataFrame:
    """Adds ``chain``: hash over the payload and the hash before it, per series.

    The rows of a series are sorted in its task and streamed in batches; a task keeps the last hash and nothing else, so that a
    series may be as long as it likes.  Rows of one series and order come in the order of their payload; a null payload is empty.
    """
    kind = T.StructType([*df.schema.fields, T.StructField("chain", T.StringType())])
    arrow = to_arrow_schema(kind)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, started = None, "genesis", False
        for b in batches:
            out = []
            for key, text in zip(b.column(names.index(series)).to_pylist(), b.column(names.index(payload)).to_pylist()):
                if not started or key != now:
                    now, last, started = key, "genesis", True
                last = hashlib.sha256(f"{last}|{'' if text is None else text}".encode()).hexdigest()
                out.append(last)
            yield from pa.Table.from_arrays([*b.columns, pa.array(out, pa.string())], names=kind.names).cast(arrow).to_batches()

    return df.repartition(F.col(series)).sortWithinPartitions(series, order, payload).mapInArrow(run, kind)


#: Fields of an evidence record that its hash covers.
HASHED = ("score", "tier", "shap_values", "e_value", "gamma", "causal_passed", "anchors")


def record(score: Column, tier: Column, shap_values: Column, e_value: Column, gamma: Column, causal_passed: Column, anchors: Column, digits: int = 6) -> Column:
    """Canonical text of an evidence record; ``shap_values`` a map of numbers, ``anchors`` an array of texts, null if there are none."""
    number = lambda c: F.format_string(f"%.{digits}f", c)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fields = (number(score), quoted(tier), canonical_map(shap_values), number(e_value), number(gamma), causal_passed.cast("string"), F.concat(F.lit("["), F.array_join(F.transform(anchors, quoted), ","), F.lit("]")))
    return canonical(dict(zip(HASHED, fields)))


def verified(record_text: Column, expected: Column) -> Column:
    """Whether a record has the digest it is said to have; a null digest verifies nothing."""
    return F.coalesce(digest(record_text) == F.lower(expected), F.lit(False))


def valid_record(score: Column, tier: Column, shap_values: Column, e_value: Column, gamma: Column, tiers: tuple[str, ...]) -> Column:
    """Whether the fields of a record are as its schema says: a score in 0..1, a known tier, 1..10 finite contributions, e_value and gamma of 1 at least."""
    finite = F.forall(F.map_values(shap_values), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(score.between(0, 1) & tier.isin(*tiers) & F.size(shap_values).between(1, 10) & finite & (e_value >= 1) & (gamma >= 1), F.lit(False))


#: What counts as a checkable statement in an explanation.
CLAIMS = (r"0x[0-9a-fA-F]{6,}", r"\b(?:bc1|[13])[a-zA-Z0-9]{20,}\b", r"\b\d[\d.,]*\s?(?:BTC|ETH|USD|USDT)\b", r"\b[0-9a-f]{64}\b")


def grounded(text: Column, context: Column) -> Column:
    """Whether every address, hash and amount of a text occurs in the context."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"({c})"), F.lit(1)) for c in CLAIMS]))
    return F.forall(found, lambda x: F.contains(context, x))


def alert_context(score: Column, anchors: Column, contributions: Column) -> Column:
    """Text of an alert: score, at most three anchors, the five largest contributions."""
    a = F.array_join(F.transform(F.slice(anchors, 1, 3), lambda x: F.format_string("%s (%s, %.4f)", x["wallet"], x["source"], x["distance"])), "; ")
    c = F.transform(F.slice(F.array_sort(F.transform(F.map_entries(contributions), lambda e: F.struct((-F.abs(e["value"])).alias("a"), e["key"].alias("k"), e["value"].alias("v")))), 1, 5), lambda e: F.format_string("%s=%.5f", e["k"], e["v"]))
    return F.concat_ws("\n", F.format_string("score: %.4f", score), F.concat(F.lit("anchors: "), a), F.concat(F.lit("features: "), F.array_join(c, ", ")))
