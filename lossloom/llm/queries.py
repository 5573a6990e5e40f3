"""The operators applied to the whole driver tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lossloom.llm import bpe, exact_dedup, fingerprint, hard_negatives, jaccard_join, kneser_ney, license_scan, nn_descent, prefix_trie, quality_cnn, secret_scan, source_mix, warc
from lossloom.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.sample(table(spark, sf_dir, "documents")).drop("times")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT + 1) / 4503599627370496e0)
         / greatest(0.1e0, 1e0 - 2e0 * (length(t) - length(regexp_replace(t, '[!-/:-@\[-`{-~]', '', 'g'))) / greatest(length(t), 1)) AS k
  FROM d
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5e0, 2e0, 1e0])[(row_number() OVER (ORDER BY source IS NULL, source::BLOB) - 1) % 3 + 1] AS w
  FROM s GROUP BY source
), l AS (
  SELECT *, sum(source_size) OVER () AS total,
         (1.5e0 * sum(source_size) OVER () - coalesce(sum(2e0 * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lv,
         row_number() OVER (ORDER BY 2e0 * source_size / w, source IS NULL, source::BLOB) AS rk
  FROM p WINDOW o AS (ORDER BY 2e0 * source_size / w, source IS NULL, source::BLOB ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0e0 ELSE
    least(2e0 * source_size, (SELECT arg_min(lv, rk) FROM l WHERE lv <= 2e0 * source_size / w) * w) END AS target
  FROM l
), r AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 1 END AS e,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (e + CASE WHEN target - e * source_size > 0 AND run + size / 2e0 <= target - e * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = kneser_ney.train(docs.where(~kneser_ney.held_out()))
    return kneser_ney.score(docs, folder).withColumn("held_out", kneser_ney.held_out())


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.ratio_table(secret_scan.labelled_samples(docs)))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH c AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM c a JOIN c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER w::INT AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 5
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc AS (
  SELECT conv_id, s, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 9 AS h
  FROM t
), r AS (
  SELECT a.conv_id, CASE WHEN b.s IS NULL THEN a.s[a.h + 1:] ELSE list_concat(b.s[:a.h], a.s[a.h + 1:]) END AS p
  FROM crc a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 5
), e AS (
  SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS depth FROM r
), n AS (
  SELECT p[:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CASE WHEN len(p) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
  FROM e GROUP BY p[:depth], depth
), c AS (
  SELECT k[:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY k[:depth - 1]
), f AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(n.k[depth].x)) END AS own
  FROM n LEFT JOIN c ON n.k = c.k
), u AS (
  SELECT k[:up] AS k, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM f) GROUP BY k[:up]
)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, u.saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u ON f.k = u.k LEFT JOIN f q ON f.depth > 0 AND q.k = f.k[:f.depth - 1]
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_exact_dedup, op3_bpe, op4_fingerprint, op5_quality_cnn, op6_source_mix, op7_warc, op8_kneser_ney, op9_secret_scan, op10_jaccard_join,
    op11_nn_descent, op12_hard_negatives, op13_prefix_trie)}
ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op6_source_mix": OP6_SQL, "op12_hard_negatives": OP12_SQL, "op13_prefix_trie": OP13_SQL}
