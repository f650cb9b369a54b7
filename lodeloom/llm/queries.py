"""The registered queries over the corpus tables, each a thin layer over its operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodeloom.llm.common import table
from lodeloom.llm.classifier import score_quality
from lodeloom.llm.divergence import source_divergence
from lodeloom.llm.flac import store_and_read
from lodeloom.llm.lines import line_classes
from lodeloom.llm.lm import score_texts
from lodeloom.llm.minhash import near_duplicates
from lodeloom.llm.negatives import hard_negatives
from lodeloom.llm.packing import pack
from lodeloom.llm.pii import find_pii
from lodeloom.llm.quality import judge
from lodeloom.llm.sharding import assign_shards
from lodeloom.llm.token_store import store_and_read_tokens
from lodeloom.llm.wfst import encode_and_decode


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=24)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_sharding, op2_line_dedup, op3_minhash, op4_pii, op5_quality_rules, op6_lm_scoring, op7_flac, op8_sentencepiece, op9_packing, op10_quality_classifier,
        op11_token_store, op12_hard_negatives, op13_source_divergence,
    )
    return {f.__name__: f for f in every}


#: Jump hash and CRC-32 in DuckDB's SQL; rows of a shard are numbered in the operator's order.
SHARDING_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), docs AS (
  SELECT row_number() OVER () AS row, doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST(concat('0x', x) AS BIGINT))), lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
  FROM documents, crc
), jump(row, shards, state, here, ahead) AS (
  SELECT row, n, (CAST(coalesce(doc_id, 0) AS HUGEINT) + 18446744073709551616) % 18446744073709551616, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM docs, (VALUES (24), (25)) s(n)
  UNION ALL
  SELECT row, shards, next, ahead, CAST(trunc((ahead + 1) * (CAST(2147483648 AS DOUBLE) / CAST(CAST(next // 8589934592 AS BIGINT) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT row, shards, ahead, ((state % 4294967296) * 2862933555777941757 + ((state // 4294967296) * 2862933555777941757 % 4294967296) * 4294967296 + 1) % 18446744073709551616 AS next FROM jump WHERE ahead < shards)
), placed AS (
  SELECT row, max(here) FILTER (shards = 24) AS shard, max(here) FILTER (shards = 25) AS grown FROM jump WHERE ahead >= shards GROUP BY row
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY xor(coalesce(doc_id, 0), text_crc32) & 1023, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM docs JOIN placed USING (row)
"""


#: Every anchor's scores with all rows, in DuckDB's SQL.
NEGATIVES_SQL = """
WITH taking AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS parts
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.row, b.vec_id, CAST(list_inner_product(a.parts, b.parts) AS BIGINT) AS score
  FROM taking a JOIN taking b ON a.row <> b.row WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.vec_id, s.row) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""

#: Shares of all terms in all groups, and all pairs of a language's sources, in DuckDB's SQL.
DIVERGENCE_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), cut AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS run FROM docs
), words AS (
  SELECT doc, lang, source, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM cut
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), langs AS (
  SELECT lang, count(term) AS terms, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM groups) LEFT JOIN kept USING (lang) GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source
), shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (t.total + 2 * l.terms) AS BIGINT) AS p,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (k.n + 2) // (l.total + 2 * l.terms) AS BIGINT) AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(CAST(sum((p.p - q.p) * (p.p - q.p) // (p.p + q.p)) AS BIGINT), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares p ON p.lang = a.lang AND p.source = a.source LEFT JOIN shares q ON q.lang = b.lang AND q.source = b.source AND q.term = p.term
  GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """Twins of what SQL can express; the other operators are tested against brute force, round trips and held-out labels."""
    return {"op1_sharding": SHARDING_SQL, "op12_hard_negatives": NEGATIVES_SQL, "op13_source_divergence": DIVERGENCE_SQL}
