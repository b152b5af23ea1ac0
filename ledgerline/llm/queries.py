"""The queries of this package over the standard tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm.exact_dedup import exact_dedup
from ledgerline.llm.jaccard import similarity_classes
from ledgerline.llm.language_id import detect_languages
from ledgerline.llm.lm_scoring import Vocabulary, score_texts
from ledgerline.llm.mixing import mix
from ledgerline.llm.nn_descent import embedding_links
from ledgerline.llm.packing import PRODUCTION, pack
from ledgerline.llm.quality import score_quality
from ledgerline.llm.token_store import token_store
from ledgerline.llm.warc import captures, resolve_revisits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs.select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is; executors have it in the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"), vocabulary())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_languages(table(spark, sf_dir, "documents"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    return records.select(
        "record_id",
        "canonical_url",
        "kind",
        "refers_to",
        "resolution",
        "status",
        F.col("headers")["date"].alias("date_header"),
        F.col("headers")["content-type"].alias("type_header"),
        F.sha2(F.col("payload"), 256).alias("payload_sha256"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = Vocabulary(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return score_texts(table(spark, sf_dir, "documents"), ranks)


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary(), PRODUCTION)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_token_store": op3_token_store,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_language_id": op5_language_id,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_quality": op7_quality,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_nn_descent": op9_nn_descent,
    "op10_packing": op10_packing,
}

_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": f"""
WITH d AS (SELECT doc_id, source, {_WORDS} AS size, md5('20-' || doc_id) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w FROM d GROUP BY source),
p AS (SELECT *, sum(words) OVER () AS total, sum(w) OVER () AS wall,
             coalesce(sum(words) OVER before, 0) AS b, coalesce(sum(w) OVER before, 0) AS wb FROM s
      WINDOW before AS (ORDER BY words / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 3 * total - 4 * b AS l, wall - wb AS wl FROM p),
a AS (SELECT *, min(CASE WHEN w * l <= words * wl * 4 THEN {{'b': b, 'l': l, 'wl': wl}} END) OVER () AS cut FROM f),
t AS (SELECT source, words, CASE WHEN words = 0 THEN 0.0 WHEN cut IS NULL OR b < cut.b THEN words * 2
             ELSE (w * cut.l)::DOUBLE / (cut.wl * 2)::DOUBLE END::DOUBLE AS target FROM a),
r AS (SELECT *, CASE WHEN words > 0 THEN floor(target / words)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT d.doc_id, d.size, r.words AS source_size, target, whole, target - whole * r.words AS part,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * least(2, whole + CASE WHEN part > 0 AND before + size / 2 <= part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q
""",
    "op6_warc_revisits": r"""
WITH p AS (
  SELECT *, CASE WHEN page_id % 5 <> 0 THEN '"' || md5(html) || '"' END AS tag,
         CASE WHEN page_id % 7 <> 0 THEN 'day ' || (page_id % 1000) END AS modified,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))), '&') AS params FROM p),
c AS (
  SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN params = '' THEN '' ELSE '?' || params END AS u FROM q),
f AS (
  SELECT r.page_id, r.u, r.tag, r.modified, r.html, max(a.page_id) AS found
  FROM c r LEFT JOIN c a ON a.u = r.u AND a.page_id * 1 < r.page_id + 1000 GROUP BY ALL),
g AS (
  SELECT f.*, a.tag AS atag, a.modified AS amodified, a.html AS body,
         CASE WHEN f.tag IS NOT NULL AND a.tag IS NOT NULL THEN f.tag = a.tag
              WHEN f.modified IS NOT NULL AND a.modified IS NOT NULL THEN f.modified = a.modified END AS same
  FROM f LEFT JOIN c a ON a.page_id = f.found),
h AS (
  SELECT *, CASE WHEN found IS NULL THEN 'no response' WHEN same IS NULL THEN 'unverified' WHEN same THEN 'resolved' ELSE 'mismatch' END AS resolution, found IS NOT NULL AND coalesce(same, true) AS done FROM g)
SELECT page_id * 2 AS record_id, u AS canonical_url, 'response' AS kind, NULL::BIGINT AS refers_to, 'full' AS resolution,
       200 AS status, page_id::VARCHAR AS date_header, 'text/html' AS type_header, sha256(html) AS payload_sha256 FROM c
UNION ALL
SELECT page_id * 2 + 1, u, 'revisit', CASE WHEN done THEN found * 2 END, resolution,
       CASE WHEN done THEN 200 ELSE 304 END, (page_id + 1000)::VARCHAR,
       CASE WHEN done THEN 'text/html' ELSE 'text/plain' END,
       CASE WHEN done THEN sha256(body) END FROM h
""",
    "op4_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_NORMAL} AS body FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
""",
}
