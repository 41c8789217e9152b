"""One thin query per operator over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, itq, kdshard, minhash, packing, pst, spm, tokenfile, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.suffix_tree_scores(_table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_itq_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def _byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return spm.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digests(_table(spark, sf_dir, "documents"), _byte_bpe())


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _byte_bpe())


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_low_quality", "p_toxic", F.col("rejected").alias("toxic"), (~F.col("rejected")).alias("kept"))


def op10_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshard.shard(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_round_trip,
        op2_suffix_tree_scores,
        op3_minhash_near_dedup,
        op4_itq_near_vectors,
        op5_exact_dedup,
        op6_sentencepiece,
        op7_token_files,
        op8_best_fit_packing,
        op9_toxicity_chain,
        op10_kd_tree_sharding,
    )
}

_COMPONENTS = """, side AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM side UNION SELECT reach.a, side.b FROM reach JOIN side ON reach.b = side.a)"""

ORACLE_SQL = {
    "op1_warc_round_trip": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, octet_length(b) AS payload_bytes, max(page_id) OVER (PARTITION BY b) AS response,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (1 + ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM d""",
    "op3_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
link AS (
  SELECT l.doc_id AS a, r.doc_id AS b FROM e l JOIN e r ON l.x = r.x AND l.doc_id < r.doc_id
  GROUP BY l.doc_id, r.doc_id, l.n, r.n HAVING 100 * count(*) >= 75 * (l.n + r.n - count(*)))"""
    + _COMPONENTS
    + """
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.b, s.doc_id)) AS component_id,
  s.doc_id <= coalesce(m.b, s.doc_id) AS kept
FROM s LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = s.doc_id""",
    "op4_itq_near_vectors": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT l.vec_id AS a, r.vec_id AS b FROM v l JOIN v r ON l.label = r.label AND l.vec_id < r.vec_id AND len(l.e) = len(r.e) AND list_cosine_similarity(l.e, r.e) >= 0.98)"""
    + _COMPONENTS
    + """
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id, e.vec_id <= coalesce(m.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM side GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = e.vec_id""",
    "op5_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)""",
}
