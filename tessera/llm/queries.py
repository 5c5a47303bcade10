"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, language_id, minhash, mixing, perplexity, quality, substring_dedup, toxicity, url_filter
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), form=bpe.DIGESTS)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.perplexity_rules(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("component")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_perplexity": op6_perplexity,
    "op7_quality": op7_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_minhash": op10_minhash,
    "pipeline": pipeline,
}

WS = r"[\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op2_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op9_url_filter": r"""
        WITH RECURSIVE rules(v, h, p) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
        u AS (
            SELECT page_id, url, html,
                   CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest
            FROM pages),
        s AS (
            SELECT page_id, url, html,
                   coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
                   coalesce(regexp_extract(rest, '^[^?#]*([?][^#]*)', 1), '') AS query
            FROM u),
        n AS (SELECT *, CASE WHEN host <> '' THEN host || path || query END AS node FROM s),
        tags AS (SELECT page_id, node, host, unnest(regexp_extract_all(html, '(?i)<link\s[^>]*rel=["'']?canonical[^>]*>')) AS tag FROM n),
        links AS (SELECT node, regexp_extract(tag, '(?i)href=["'']?([^"''\s>]+)', 1) AS link FROM tags),
        e AS (SELECT DISTINCT node AS a, regexp_extract(link, '://([^#]*)', 1) AS b FROM links WHERE node IS NOT NULL AND link LIKE '%://%'),
        both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
        fit AS (
            SELECT DISTINCT node, host, path,
                   (SELECT max_by(struct_pack(v := v, r := h || p), length(h) + length(p)) FROM rules
                    WHERE (n.host = h OR n.host LIKE '%.' || h) AND starts_with(n.path, p)) AS best
            FROM n),
        bad AS (SELECT DISTINCT r.a AS node FROM reach r JOIN fit f ON f.node = r.b WHERE f.best.v = 'block')
        SELECT n.page_id, n.host, n.path, f.best.r AS rule,
               coalesce(f.best.v, CASE WHEN bad.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
        FROM n JOIN fit f ON f.host = n.host AND f.path = n.path AND f.node IS NOT DISTINCT FROM n.node
        LEFT JOIN bad ON bad.node = n.node
    """,
}
