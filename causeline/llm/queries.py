"""Registered queries of the corpus operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brown_lm, decontam, embed_dup, lang_id, line_dedup, near_dup, packing, secrets, token_count, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_read(spark, sf_dir, "documents"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return decontam.verdicts(found).drop("spans")


def op6_embed_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dup.link(_read(spark, sf_dir, "embeddings"))


def op7_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.report(_read(spark, sf_dir, "documents"))


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.report(_read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_near_dup": op2_near_dup,
        "op3_packing": op3_packing,
        "op4_token_count": op4_token_count,
        "op5_decontam": op5_decontam,
        "op6_embed_dup": op6_embed_dup,
        "op7_lang_id": op7_lang_id,
        "op8_brown_lm": op8_brown_lm,
        "op9_secrets": op9_secrets,
        "op10_toxicity": op10_toxicity,
    }


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

OP1 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, {_BLANKS}), {_UPPER}, {_LOWER}) AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < c.keeper, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

OP5 = f"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS key
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS key
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, pos.n, i, item FROM pos JOIN win USING (n, key)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op9() -> str:
    parts = []
    for k, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {k} AS rank, '{r.kind}' AS kind,
         CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
         length(hits[i]) AS n, vals[i] AS val
  FROM (SELECT doc_id, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', 1) AS vals FROM t))
  WHERE length(vals[i]) >= {r.least}""")
    union = " UNION ALL ".join(parts)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({union}),
g AS (SELECT doc_id, rank, kind, s, kind || ':' || s || ':' || (s + n) AS span FROM f),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY s, rank) AS spans,
             string_agg(span, ',' ORDER BY s, rank) FILTER (WHERE kind IN ('assign', 'access', 'hex')) AS base
      FROM g GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (doc_id)
"""


OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, list_contains(embedding, NULL) OR len(embedding) = 0 AS bad FROM embeddings),
ok AS (
  SELECT DISTINCT vec_id, label, e FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT DISTINCT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON r.id = l.a),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.root, v.vec_id) AS component_id, coalesce(c.root, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN c ON v.vec_id = c.id LEFT JOIN n ON v.vec_id = n.id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op5_decontam": OP5, "op6_embed_dup": OP6, "op9_secrets": _op9()}
