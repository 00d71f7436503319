"""The dealt operators as registered queries, next to their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedfold.llm.bpe import decode, encode
from feedfold.llm.common import table
from feedfold.llm.divergence import source_divergence
from feedfold.llm.exact_dedup import exact_groups
from feedfold.llm.hard_negatives import hard_negatives
from feedfold.llm.line_dedup import drop_repeated_lines
from feedfold.llm.ngram_join import near_duplicates
from feedfold.llm.packing import pack, tokenize
from feedfold.llm.pii import replace_pii
from feedfold.llm.quality import importance_sample
from feedfold.llm.substring_dedup import remove_repeated_windows
from feedfold.llm.url_filter import judge_urls
from feedfold.llm.vector_dedup import near_vectors
from feedfold.llm.warc import read_archives, resolved, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("row_key")


QUERIES["op9_exact_dedup"] = op9_exact_dedup
ORACLE["op9_exact_dedup"] = """
WITH folded AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM folded WINDOW same AS (PARTITION BY t)"""


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


QUERIES["op3_url_filter"] = op3_url_filter
ORACLE["op3_url_filter"] = f"""
WITH parts AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END AS raw_host,
           CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM pages),
places AS (
    SELECT page_id, path,
           translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
best AS (
    SELECT host, path, max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path,
                                       verdict := rule_verdict)) AS b
    FROM (SELECT DISTINCT host, path FROM places)
    JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY host, path)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM places LEFT JOIN best USING (host, path)"""


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = decode(encode(table(spark, sf_dir, "documents"), vocab, public_tokenizers.PATTERN), vocab)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES["op10_byte_bpe"] = op10_byte_bpe


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("removed").alias("n_intervals"))


QUERIES["op4_substring_dedup"] = op4_substring_dedup


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids."""
    tokens = tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pack(tokens).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                               "offset", "source")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES["op7_packing"] = op7_packing


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(table(spark, sf_dir, "pages"))
    return resolved(read_archives(spark, path)).drop("intact")


QUERIES["op2_warc"] = op2_warc
ORACLE["op2_warc"] = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
grouped AS (SELECT *, strlen(t) AS n, max(page_id) OVER (PARTITION BY t) AS largest FROM payloads)
SELECT page_id, n AS payload_bytes, sha1(t) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM grouped"""


def op6_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay."""
    sample = importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return sample.select("doc_id", "log_weight", "sampling_key")


QUERIES["op6_importance_sample"] = op6_importance_sample


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


QUERIES["op5_ngram_join"] = op5_ngram_join


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES["op8_vector_dedup"] = op8_vector_dedup


PII_KEY = "surrogates-2026"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, PII_KEY, count_col="n_replaced")


QUERIES["op1_pii_surrogates"] = op1_pii_surrogates


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


QUERIES["op11_hard_negatives"] = op11_hard_negatives
ORACLE["op11_hard_negatives"] = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE) for x in embedding] AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
     AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES["op12_source_divergence"] = op12_source_divergence
ORACLE["op12_source_divergence"] = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
    SELECT doc_id, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS total FROM kept GROUP BY ALL),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN kept k USING (lang, term) GROUP BY ALL),
groups AS (
    SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(c.n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN langs USING (lang) LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
chances AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM chances a JOIN chances b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
priced AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q
    FROM (SELECT c.*, 1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + l.v) AS q
          FROM chances c JOIN kept k USING (lang, term) JOIN langs l USING (lang)) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM priced QUALIFY part = 'pair' OR rank <= 200"""


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES["op13_line_dedup"] = op13_line_dedup
ORACLE["op13_line_dedup"] = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
    SELECT doc_id, line, place, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS place FROM split)),
common AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id <> keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (key) GROUP BY doc_id"""

# Brute force: fine on the tables that twins are compared on, far too slow for large ones.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE["op4_substring_dedup"] = f"""
WITH split AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (
    SELECT doc_id, unnest([array_to_string(ws[i:i + 19], ' ') for i in range(1, len(ws) - 18)]) AS w,
           unnest(range(1, len(ws) - 18)) AS start FROM split WHERE len(ws) >= 20),
later AS (SELECT doc_id, start FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, start) > 1),
gone AS (SELECT DISTINCT doc_id, start + j AS place FROM later, (SELECT unnest(range(20)) AS j)),
edges AS (
    SELECT doc_id, count(*) FILTER (before IS NULL OR start - before > 20) AS spans
    FROM (SELECT *, lag(start) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM later) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM split),
kept AS (
    SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.place) AS text, count(*) AS n
    FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.place = w.place WHERE g.place IS NULL GROUP BY w.doc_id)
SELECT s.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256,
       coalesce(spans, 0)::INTEGER AS n_intervals
FROM split s LEFT JOIN kept k USING (doc_id) LEFT JOIN edges USING (doc_id)"""

_REACH = """reach AS (SELECT id AS x, id AS y FROM ids UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)"""
ORACLE["op5_ngram_join"] = f"""
WITH RECURSIVE split AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
ids AS (SELECT doc_id AS id FROM documents),
grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END) AS g FROM split),
sizes AS (SELECT doc_id, count(*) AS c FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM shared JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE k >= 0.8 * (a.c + b.c - k) - 1e-9),
{_REACH}
SELECT r.x AS doc_id, min(r.y) AS class_id, coalesce(any_value(n), 0) AS n_links, min(r.y) = r.x AS kept
FROM reach r LEFT JOIN degree d ON d.x = r.x GROUP BY r.x"""

ORACLE["op8_vector_dedup"] = f"""
WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
usable AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([e for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0
          AND len([e for e in embedding if e <> 0]) > 0),
unit AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS size FROM usable),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.95),
{_REACH}
SELECT r.x AS vec_id, coalesce(any_value(n), 0) AS n_links, min(r.y) AS component_id, min(r.y) = r.x AS kept
FROM reach r LEFT JOIN degree d ON d.x = r.x GROUP BY r.x"""
