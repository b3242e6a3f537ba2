"""The registered queries of the operators, one each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm.centroids import cluster_vectors, clustering_sql
from lumenspan.llm.decontamination import leaks
from lumenspan.llm.html_text import extract_text
from lumenspan.llm.jaccard_join import similar_documents
from lumenspan.llm.lexical_search import SEARCH_SQL, search
from lumenspan.llm.license_scan import scan_licenses
from lumenspan.llm.minhash_dedup import near_duplicates
from lumenspan.llm.packing import pack
from lumenspan.llm.quality_classifier import classify
from lumenspan.llm.quality_rules import quality_rules
from lumenspan.llm.sharding import bounded_ring
from lumenspan.llm.token_counts import count_tokens
from lumenspan.llm.warc import archived_pages

#: Tokenizer files, by the name under which the installed package of public tokenizers gives their place.
BPE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_FILE))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archived_pages(spark, table(spark, sf_dir, "pages"), least_bytes=0)
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file(BPE_FILE), capacity=1024, end_id=2)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


OP5_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(*OP5_COLUMNS)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = bounded_ring(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_warc,
        op3_packing,
        op4_html_text,
        op5_quality_rules,
        op6_decontamination,
        op7_sharding,
        op8_license_scan,
        op9_jaccard_join,
        op10_quality_classifier,
        op11_lexical_search,
        op12_centroid_clusters,
        op13_minhash_dedup,
    )
}

_SPACE = r"[\x20\x09-\x0D]+"

def _similar_sql(percent: int, more: str = "") -> str:
    """Components of documents by the Jaccard similarity of their three-word shingles."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda a: a <> '') AS ws
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS p FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {percent}
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))
),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id{more}
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)"""


ORACLE_SQL = {
    "op11_lexical_search": SEARCH_SQL,
    "op12_centroid_clusters": clustering_sql(),
    "op2_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY h) AS keeper,
    array_to_string(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '')
      AS payload_digest
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d""",
    "op5_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, list_filter(regexp_split_to_array(x, '{_SPACE}'), lambda a: a <> '') AS ws FROM t),
l AS (
  SELECT doc_id, list_filter(list_transform(string_split(x, chr(10)), lambda a:
    {{'l': a, 'n': len(list_filter(regexp_split_to_array(a, '{_SPACE}'), lambda b: b <> ''))}}), lambda a: a.n > 0) AS ls
  FROM t
),
k AS (
  SELECT doc_id, len(ls) - len(list_distinct(list_transform(ls, lambda a: a.l))) AS dup,
    coalesce(list_sum(list_transform(list_filter(ls, lambda a: NOT (
      len(regexp_extract_all(a.l, '[#*$%&|<>]')) * 100 > a.n * 30
      OR len(regexp_extract_all(a.l || ' ', '[!?.,]{{2,}}[\x20\x09-\x0D]')) * 100 > a.n * 30
      OR len(regexp_extract_all(a.l, '[|»•·›→]')) * 100 > a.n * 20
      OR (a.n <= 3 AND NOT regexp_matches(a.l, '[.!?:;…。！？]["''”’»)\]]*[\x20\x09-\x0D]*$'))
      OR (a.n <= 20 AND regexp_matches(lower(a.l), 'all rights reserved|terms of (use|service)|privacy policy|cookie|javascript|lorem ipsum|click here|read more|sign (in|up)|log ?in|subscribe|share this|powered by|skip to (main )?content'))
    )), lambda a: a.n)), 0) AS kept_words
  FROM l
),
g AS (
  SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)
),
r AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
b AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(x, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, kept_words
  FROM w JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ((n_words - kept_words) * 100 > n_words * 30) AS kept
FROM b""",
    "op9_jaccard_join": _similar_sql(90),
    "op13_minhash_dedup": _similar_sql(85, ", d.doc_id = r.component_id AS kept"),
}
