"""The registered queries over the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import encoded
from .common import read
from .decontaminate import contamination
from .licences import scan_documents
from .lines import deduplicated
from .minhash import near_duplicates
from .passages import document_repeats
from .quality import scored
from .tokencount import token_counts
from .topk import nearest
from .warc import round_trip


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents"), min_tokens=1)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_repeats(read(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash, op2_quality, op3_lines, op4_licences, op5_token_counts, op6_topk, op7_passages, op8_bpe, op9_decontaminate, op10_warc)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op6_topk": """
WITH v AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "op9_decontaminate": f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, list_slice(w, i, i + least(len(w), 8) - 1) AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
spots AS (
  SELECT doc_id, text, n, i, list_slice(w, i, i + n - 1) AS gram
  FROM (SELECT doc_id, text, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
found AS (SELECT doc_id, text, i, s.n, item_id FROM spots s JOIN grams g ON s.n = g.n AND s.gram = g.gram),
hit AS (SELECT doc_id, text, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, text, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY ALL),
its AS (SELECT doc_id, text, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, text, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY ALL)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs d LEFT JOIN hit ON d.doc_id IS NOT DISTINCT FROM hit.doc_id AND d.text IS NOT DISTINCT FROM hit.text
LEFT JOIN its ON d.doc_id IS NOT DISTINCT FROM its.doc_id AND d.text IS NOT DISTINCT FROM its.text""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
held AS (SELECT html, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN held ON p.html = held.html AND p.n >= 1000""",
}
