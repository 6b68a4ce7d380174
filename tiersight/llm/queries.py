"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tiersight.llm import alignment, genetic, html_text, lattice, mixing, packing, passages, private, quality, simhash, topk, turns, urls

RULES = [
    urls.rule_of("block", "com/en/"),
    urls.rule_of("allow", "example.com/en/7"),
    urls.rule_of("allow", "net/de/"),
    urls.rule_of("block", "example.net/de/8"),
    urls.rule_of("block", "org/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_matrices(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genetic.genetic_packing(table(spark, sf_dir, "documents"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.url_verdicts(table(spark, sf_dir, "pages"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents")).documents


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    return turns.repair_digest(original, turns.damage(original))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.span_digests(table(spark, sf_dir, "documents"))


URL_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, url LIKE '%://%' AS full_url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*[^?#]*(\??[^#]*)', 1, 's'), '') AS query
  FROM pages
), tags AS (
  SELECT *, unnest(list_filter(regexp_extract_all(html, '<link\b[^>]*>', 0, 'is'), lambda x: regexp_matches(x, '\brel\s*=\s*["'']?[^"''>]*\bcanonical\b', 'is'))) AS tag,
    '\bhref\s*=\s*["'']?([^"''\s>]+)' AS value
  FROM parts WHERE full_url
  UNION ALL
  SELECT *, unnest(list_filter(regexp_extract_all(html, '<meta\b[^>]*>', 0, 'is'), lambda x: regexp_matches(x, '\bhttp-equiv\s*=\s*["'']?refresh\b', 'is'))) AS tag,
    '\burl\s*=\s*["'']?([^"''>]+)' AS value
  FROM parts WHERE full_url
), targets AS (
  SELECT *, CASE WHEN value LIKE '%href%' THEN trim(regexp_extract(tag, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is'))
    ELSE trim(regexp_extract(tag, '\burl\s*=\s*["'']?([^"''>]+)', 1, 'is')) END AS target
  FROM tags
), resolved AS (
  SELECT host || path || query AS a,
    CASE WHEN target LIKE '%://%' THEN target WHEN target LIKE '//%' THEN 'x:' || target
      WHEN target LIKE '/%' THEN 'x://' || host || target
      ELSE 'x://' || host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || target END AS target
  FROM targets WHERE target <> ''
), edges AS (
  SELECT a, translate(regexp_extract(target, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(target, '^.*?://[^/?#]*([^#]*)', 1, 's') AS b
  FROM resolved
), sym AS (
  SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b
), reach AS (
  SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a
), rules(v, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), names AS (
  SELECT DISTINCT name, regexp_extract(name, '^[^/?#]*') AS host, regexp_extract(name, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT host || path || query AS name FROM parts WHERE full_url UNION SELECT b FROM edges)
), fits AS (
  SELECT n.name, r.v, r.h || r.p AS rule, row_number() OVER (PARTITION BY n.name ORDER BY length(r.h || r.p) DESC) AS k
  FROM names n JOIN rules r ON (n.host = r.h OR n.host LIKE '%.' || r.h) AND starts_with(n.path, r.p)
), own AS (
  SELECT name, v, rule FROM fits WHERE k = 1
), alias AS (
  SELECT r.a AS name, CASE WHEN bool_or(o.v = 'allow') THEN 'allow' WHEN bool_or(o.v = 'block') THEN 'block' END AS v
  FROM reach r JOIN own o ON o.name = r.b GROUP BY r.a
)
SELECT p.page_id, p.host, p.path, o.rule, coalesce(o.v, l.v, 'allow') AS verdict
FROM parts p LEFT JOIN own o ON p.full_url AND o.name = p.host || p.path || p.query
LEFT JOIN alias l ON p.full_url AND l.name = p.host || p.path || p.query
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_token_matrices, op2_substring_dedup, op3_source_mixing, op4_simhash_near_dedup, op5_best_fit_packing, op6_html_main_text, op7_embedding_near_dedup, op8_url_filter, op9_quality_classifier, op10_exact_top_k, op11_tokenizer_alignment, op12_conversation_repair, op13_personal_data,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": mixing.MIX_SQL, "op7_embedding_near_dedup": lattice.NEAR_VECTORS_SQL, "op8_url_filter": URL_SQL, "op10_exact_top_k": topk.TOP_K_SQL, "op12_conversation_repair": turns.REPAIR_SQL}
