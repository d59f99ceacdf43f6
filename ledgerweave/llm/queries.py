"""Queries of this subpackage over the project's tables (problems 3, 4, 7, 8 and 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerweave.llm.groups import hash_to_min
from ledgerweave.llm.leaks import find_leaks
from ledgerweave.llm.neighbours import similar_pairs
from ledgerweave.llm.stuffed import find_stuffed
from ledgerweave.llm.tokens import TOKENIZER_DIR, encode_texts, read_ranks
from ledgerweave.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "elliptic_txs_edgelist")
    return hash_to_min(edges, "txId1", "txId2").select(F.col("v").alias("txid"), "group_id")


FEATURES = [f"feat_{i}" for i in range(2, 167)]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar_pairs(table(spark, sf_dir, "elliptic_txs_features"), "txId", FEATURES, "load_id", -50.0, 50.0)
    return pairs.select(F.col("a").alias("txid_a"), F.col("b").alias("txid_b"))


def p7_ids(spark: SparkSession, sf_dir: str, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", read_ranks(f"{tokenizer_dir}/byte_bpe_50k.tiktoken"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_stuffed(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found}

_WORDS = "regexp_extract_all(replace(lower(regexp_replace(text, '[\u200b\u200c\u200d\u2060\ufeff\u00ad]', '', 'g')), 'ё', 'е'), '[\\p{L}\\p{N}]+')"

_VECTOR = f"list_transform([{', '.join(FEATURES)}], lambda x: CASE WHEN x BETWEEN -50 AND 50 AND NOT isnan(x) THEN x ELSE 0 END)"

SQL = {
    "p4_found": f"""
WITH f AS (SELECT txId t, {_VECTOR}::DOUBLE[165] v FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM elliptic_txs_features WHERE txId IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY txId ORDER BY load_id DESC) = 1),
s AS (SELECT a.t x, b.t y, array_cosine_similarity(a.v, b.v) c FROM f a, f b WHERE a.t <> b.t),
r AS (SELECT x, y FROM (SELECT * FROM s WHERE c >= 0.95 AND NOT isnan(c)) QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 5)
SELECT DISTINCT least(x, y) txid_a, greatest(x, y) txid_b FROM r""",
    "p3_found": """
WITH RECURSIVE e AS (SELECT txId1 a, txId2 b FROM elliptic_txs_edgelist WHERE txId1 IS NOT NULL AND txId2 IS NOT NULL
  UNION SELECT txId2, txId1 FROM elliptic_txs_edgelist WHERE txId1 IS NOT NULL AND txId2 IS NOT NULL),
r(v, u) AS (SELECT a, a FROM e UNION SELECT e.b, r.u FROM r JOIN e ON e.a = r.v WHERE r.u < e.b)
SELECT v txid, min(u) group_id FROM r GROUP BY v""",
    "p8_found": f"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS} w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: list_aggregate(w[k:k + n - 1], 'string_agg', ' '))) s
  FROM d, (SELECT DISTINCT least(13, len(w)) n FROM i WHERE len(w) > 0)),
iw AS (SELECT item_id, least(13, len(w)) n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda k: list_aggregate(w[k:k + least(13, len(w)) - 1], 'string_agg', ' '))) s FROM i WHERE len(w) > 0)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (n, s)""",
}
