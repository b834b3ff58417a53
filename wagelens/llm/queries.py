"""The registered queries opN_<name>: thin digests of the operators' results, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bitslice, bpe, fim, langid, mixing, neardup, ngramjoin, pii, quality, rpforest, secrets, spelling, toxicity
from .common import fold, table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return bitslice.top_k(rows, F.col("vec_id") % 20 == 0, 20)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.counted(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 1.5::DOUBLE * sum(words) OVER () - coalesce(sum(2 * words) OVER before, 0) AS rest_words,
         sum(w) OVER after AS rest_w
  FROM s
  WINDOW before AS (ORDER BY words::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY words::DOUBLE / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (
  SELECT *, rest_words::DOUBLE * w / rest_w > 2 * words AS capped FROM o),
t AS (
  SELECT source, words,
         CASE WHEN capped THEN (2 * words)::DOUBLE
              ELSE (1.5::DOUBLE * sum(words) OVER () - coalesce(sum(2 * words) FILTER (capped) OVER (), 0))::DOUBLE * w
                   / sum(w) FILTER (NOT capped) OVER () END AS target
  FROM c),
r AS (
  SELECT *, CASE WHEN words > 0 THEN least(floor(target / words), 2) ELSE 0 END AS rounds FROM t),
p AS (
  SELECT d.doc_id, d.size, r.words, r.target, r.rounds, r.target - r.rounds * r.words AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY place, size) AS upto,
         sum(size) OVER (PARTITION BY d.source, place, size) AS own
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, words AS source_size, target,
       CAST(size * (rounds + CASE WHEN 2 * upto - own <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.scan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base_text", 256).alias("base_sha256"),
                      F.col("all_text").alias("spans"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), fold(F.col("id"), 5) != 0)
    held = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return quality.score(docs, model).select("doc_id", held, "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold(F.col("id"), 4) != 2)
    held = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", "predicted",
                                              F.size("offending").alias("n_offending"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, fold(F.col("doc_id"), 4) != 2)
    got = langid.classify(docs, model)
    return got.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score",
                      "margin", "rejected")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", *(f"n_{k}" for k in secrets.BASE), F.sha2("base_text", 256).alias("base_sha256"),
                      F.col("all_text").alias("spans"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
c AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1,
         CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, n, form, t, array_to_string(list_slice(u, 1, least(c1, c2)), '') AS prefix,
         array_to_string(list_slice(u, least(c1, c2) + 1, greatest(c1, c2)), '') AS middle,
         array_to_string(list_slice(u, greatest(c1, c2) + 1, n), '') AS suffix
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""


def op13_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.joined(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_topk, op2_mix, op3_pii, op4_neardup, op5_quality, op6_toxicity, op7_bpe, op8_langid, op9_secrets, op10_ann,
        op11_spelling, op12_fim, op13_ngramjoin)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op2_mix": OP2_SQL, "op12_fim": OP12_SQL}
