"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import (
    html_text,
    line_dedup,
    lm_scores,
    ngram_join,
    packing,
    pieces,
    quality_rules,
    secrets,
    substring_dedup,
    topk,
)
from siftline.llm.common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality_rules.judged(docs).select(
        "doc_id",
        *[
            F.col(f"quality.{c}").alias(c)
            for c in (
                "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            )
        ],
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduped(documents(spark, sf_dir), with_text=False)
    return out.withColumnRenamed("kept", "kept_sha256")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.nearest(vectors, F.col("vec_id") % 50 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    cleaned = line_dedup.without_boilerplate(docs)
    return cleaned.select(
        "doc_id",
        F.length("text").cast("long").alias("n_kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(documents(spark, sf_dir), keep=["doc_id"])
    s = F.col("secrets")
    base = F.filter(s, lambda x: x["k"] < 3)
    number = lambda k: F.size(F.filter(s, lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(s).alias("spans"),
        F.size(F.filter(s, lambda x: x["live"])).cast("long").alias("n_live"),
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores.scored(documents(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.grouped(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")).drop("differing")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_topk": op3_topk,
    "op4_line_dedup": op4_line_dedup,
    "op5_secrets": op5_secrets,
    "op6_html_text": op6_html_text,
    "op7_packing": op7_packing,
    "op8_lm_scores": op8_lm_scores,
    "op9_ngram_join": op9_ngram_join,
    "op10_sentencepiece": op10_sentencepiece,
}


def _secrets_sql() -> str:
    """Hits of each kind with the texts between them, which tell where they begin; then owners by value."""
    parts = []
    for n, kind in enumerate(secrets.KINDS):
        pattern = kind.pattern.replace("(?<![0-9a-f])[0-9a-f]{16,}", "[0-9a-f]+").replace("'", "''")
        parts.append(
            f"SELECT r, doc_id, source, {n} AS k, '{kind.name}' AS kind, regexp_extract_all(x, '{pattern}') AS hits, "
            f"regexp_split_to_array(x, '{pattern}') AS gaps, "
            f"list_transform(regexp_extract_all(x, '{pattern}'), lambda h: regexp_extract(h, '{pattern}', {kind.group})) AS vals, {kind.least} AS least FROM t"
        )
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS x FROM documents),
a AS ({" UNION ALL ".join(parts)}),
u AS (SELECT r, doc_id, source, k, kind, least, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM a WHERE len(hits) > 0),
p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, k ORDER BY i) AS stop FROM u),
s AS (SELECT *, stop - length(hit) AS start FROM p WHERE length(val) >= least),
o AS (SELECT val, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repos FROM s GROUP BY val),
g AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3) AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans, count(*) FILTER (owners < 3 AND repos < 20) AS n_live
      FROM s JOIN o USING (val) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM t LEFT JOIN g USING (r)"""


ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
s AS (SELECT r, doc_id, x, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
p AS (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM s),
w AS (SELECT r, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM w WHERE c IS NOT NULL) WHERE n > 1),
k AS (SELECT r, count(DISTINCT i + j) AS n FROM d, (VALUES (0), (1), (2)) v(j) GROUP BY r),
m AS (SELECT s.*, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(k.n, 0)::BIGINT AS n_repeat_words
      FROM s LEFT JOIN k ON s.r = k.r),
f AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
  OR NOT word_chars / greatest(n_words, 1) BETWEEN 2.5 AND 12
  OR n_symbols * 10 > n_words
  OR n_dup_lines * 10 > len(ls) * 4
  OR len(list_filter(ws, lambda w: regexp_matches(w, '\p{L}'))) / greatest(n_words, 1) < 0.7
  OR length(regexp_replace(x, '[^\p{Lu}]+', '', 'g')) * 10 > length(x) * 4
  OR len(list_distinct(ws)) * 50 < n_words
  OR len(list_filter(ls, lambda l: regexp_matches(l, '^\s*[-*•●]'))) / greatest(len(ls), 1) > 0.9
  OR len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)\s*$'))) / greatest(len(ls), 1) > 0.5) AS kept
FROM f""",
    "op5_secrets": _secrets_sql(),
    "op3_topk": r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5""",
    "op8_lm_scores": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
o AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
p AS (SELECT r, i, w, lag(w, 1) OVER (PARTITION BY r ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS u FROM o),
g1 AS (SELECT r, w, count(*) AS n FROM p GROUP BY ALL),
g2 AS (SELECT r, v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY ALL),
g3 AS (SELECT r, u, v, w, count(*) AS n FROM p WHERE u IS NOT NULL GROUP BY ALL),
l1 AS (SELECT r, w, sum(n) OVER (PARTITION BY w) - n AS c FROM g1),
l2 AS (SELECT r, v, w, sum(n) OVER (PARTITION BY v, w) - n AS c FROM g2),
l3 AS (SELECT r, u, v, w, sum(n) OVER (PARTITION BY u, v, w) - n AS c FROM g3),
own AS (SELECT r, greatest((SELECT count(*) FROM p) - count(*), 1) AS others FROM p GROUP BY r),
j AS (SELECT p.r, least(p.i, 3) AS most, others, a.c AS c1, coalesce(b.c, 0) AS c2, coalesce(d.c, 0) AS c3, h.c AS h1, k.c AS h2
      FROM p JOIN own ON p.r = own.r JOIN l1 a ON p.r = a.r AND p.w = a.w
      LEFT JOIN l2 b ON p.r = b.r AND p.v = b.v AND p.w = b.w
      LEFT JOIN l3 d ON p.r = d.r AND p.u = d.u AND p.v = d.v AND p.w = d.w
      LEFT JOIN l1 h ON p.r = h.r AND p.v = h.w
      LEFT JOIN l2 k ON p.r = k.r AND p.u = k.v AND p.v = k.w),
s AS (SELECT r, most - CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 ELSE 1 END AS off,
             CASE WHEN c3 > 0 THEN ln(c3::DOUBLE / h2) WHEN c2 > 0 THEN ln(c2::DOUBLE / h1) ELSE ln(greatest(c1, 0.5)::DOUBLE / others) END AS x FROM j),
a AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (off > 0) AS n_backed_off, sum(x + off * ln(0.4::DOUBLE)) AS log_score FROM s GROUP BY r)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_backed_off, 0) AS n_backed_off,
       round(coalesce(log_score, 0), 6) AS log_score, round(log_score / n_tokens, 6) AS mean_log_score
FROM t LEFT JOIN a ON t.r = a.r""",
    "op4_line_dedup": r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT DISTINCT doc_id, source, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
      FROM (SELECT doc_id, source, unnest(ls) AS x FROM d)),
t AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 20),
b AS (SELECT l.source, line FROM l JOIN t USING (source) WHERE line <> ''
      GROUP BY l.source, line, pages HAVING count(*) >= 5 AND count(*) > pages * 0.05),
p AS (SELECT doc_id, source, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS kept FROM p LEFT JOIN b
      ON p.source = b.source AND b.line = trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
      WHERE b.line IS NULL GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL ELSE length(coalesce(kept, ''))::BIGINT END AS n_kept_chars,
       CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
}
