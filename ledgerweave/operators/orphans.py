"""References to records that do not exist, were withdrawn before, or come later.

Parent keys are range-partitioned by sampled quantiles; each range is a set of sorted arrays (key and facts about it).
Reference batches are sent to the range of their key and probe the arrays by vectorised binary search.  A range that many
references fall into is repeated over several slots, so that a hot key never fills one task.

Defined results: null keys refer to nothing; an empty parent table makes every key missing; repeated references give one
row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ledgerweave.plans.staging import Stage

#: Keys of one range and references of one slot, at most on the average of the sampled quantiles.
RANGE_KEYS, SLOT_ROWS, MAX_RANGES = 200_000, 400_000, 4096


def key_bounds(parents: DataFrame, key: str, n_keys: int, range_keys: int = RANGE_KEYS) -> list[int]:
    """Upper bounds of key ranges of about ``range_keys`` keys: mergeable quantile sketch, at most ``MAX_RANGES`` numbers."""
    n = min(MAX_RANGES, -(-n_keys // range_keys))
    if n <= 1:
        return []
    return sorted({int(x) for x in parents.approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n)})


def _range_of(df: DataFrame, key: str, bounds: list[int], once: bool = False) -> DataFrame:
    """Adds ``__rng``: the number of bounds below the key, by binary search over Arrow batches.

    With ``once``, repeats within a batch are left out before anything is shuffled: a reference repeated without end shrinks
    to one row a batch.
    """
    if not bounds and not once:
        return df.withColumn("__rng", F.lit(0))
    edges = np.array(bounds, dtype=np.int64)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            if once:
                t = t.group_by(names).aggregate([]).select(names)
            k = t.column(key).to_numpy().astype(np.int64)
            yield from t.append_column("__rng", pa.array(np.searchsorted(edges, k, side="left").astype(np.int32))).combine_chunks().to_batches()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("__rng", T.IntegerType())]))


def probe(refs: DataFrame, parents: DataFrame, key: str, facts: list[str], spread: str, range_keys: int = RANGE_KEYS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``refs`` with the facts (LONG, null where absent) of their key; ``parents`` has one row per key, key and facts LONG."""
    n_keys = parents.count()
    bounds = key_bounds(parents, key, n_keys, range_keys)
    # counted and probed: the references are cut into ranges once
    refs = Stage(refs.sparkSession).write(_range_of(refs, key, bounds, once=True))
    parents = _range_of(parents.select(key, *facts), key, bounds)
    sizes = {r[0]: r[1] for r in refs.groupBy("__rng").count().collect()}  # one number per range
    slots = [max(1, -(-sizes.get(r, 0) // slot_rows)) for r in range(len(bounds) + 1)]
    first = np.concatenate([[0], np.cumsum(slots)]).tolist()
    width, start = F.array(*[F.lit(s) for s in slots]), F.array(*[F.lit(int(s)) for s in first])
    # the number of a slot is the number of its partition: no two slots share a task
    slot = (F.get(start, F.col("__rng")) + F.pmod(F.xxhash64(spread), F.get(width, F.col("__rng")))).cast("int")
    columns = [c for c in refs.columns if c != "__rng"]
    left = refs.select(slot.alias("__slot"), F.lit(1).alias("__ref"), *columns, *[F.lit(None).cast("long").alias(f) for f in facts])
    every = F.explode(F.transform(F.sequence(F.lit(0), F.get(width, F.col("__rng")) - 1), lambda i: (F.get(start, F.col("__rng")) + i).cast("int")))
    right = parents.select(every.alias("__slot"), F.lit(0).alias("__ref"), *[F.col(c) if c == key else F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in columns], *facts)
    out = T.StructType([*[refs.schema[c] for c in columns], *[T.StructField(f, T.LongType()) for f in facts]])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parents come first and become sorted arrays; then each batch of references is probed by itself."""
        there: list[pa.Table] = []
        keys = None
        for b in batches:
            t = pa.Table.from_batches([b])
            is_ref = t.column("__ref").to_numpy() == 1
            if not is_ref.all():
                there.append(t.filter(pa.array(~is_ref)).select([key, *facts]))
            if not is_ref.any():
                continue
            if keys is None:
                table = pa.concat_tables(there) if there else None
                keys = table.column(key).to_numpy().astype(np.int64) if table is not None else np.zeros(0, np.int64)
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                columns_of = [table.column(f).combine_chunks().take(pa.array(order)) for f in facts] if len(keys) else []
            t = t.filter(pa.array(is_ref))
            k = t.column(key).to_numpy().astype(np.int64)
            at = np.searchsorted(keys, k)
            hit = np.zeros(len(k), bool) if not len(keys) else keys[np.minimum(at, len(keys) - 1)] == k
            index = pa.array(np.where(hit, np.minimum(at, max(0, len(keys) - 1)), 0), mask=~hit)
            found = [c.take(index) for c in columns_of] if len(keys) else [pa.nulls(len(k), pa.int64()) for _ in facts]
            yield from pa.table([*[t.column(c) for c in columns], *found], names=names).combine_chunks().to_batches()

    return left.unionByName(right).repartitionById(int(first[-1]), F.col("__slot")).sortWithinPartitions("__ref").mapInArrow(run, out)
