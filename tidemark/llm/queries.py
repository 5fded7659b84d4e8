"""The queries ``opN_<name>`` over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, lines, packing, quality, rules, secrets, simhash, substr, urls
from .common import table

#: The URL rules as (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: A document is predicted to be of good quality from this score on.
QUALITY_THRESHOLD = 0.3


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every document that contains a benchmark item."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    out = htmltext.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, distance=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts of the base rule, base_failed, kept, and the posterior probability of every document."""
    out = rules.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return substr.remove_repeats(table(spark, sf_dir, "documents"), length=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays of every document."""
    out = lines.line_report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=1024)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and the counts of live and example spans of every document."""
    out = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE_KINDS))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id",
        *[count(k) for k in secrets.BASE_KINDS],
        F.sha2(secrets.digest_of(base), 256).alias("base_sha256"),
        secrets.digest_of(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    known = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), known).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_html_text, op3_quality, op4_simhash, op5_quality_rules, op6_substring_dedup, op7_line_dedup, op8_packing, op9_secrets, op10_url_filter)
}

#: Words of a text in DuckDB.
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(_LOWER)} AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[j : j + least(5, len(w)) - 1], ' ') AS s FROM i, LATERAL (SELECT unnest(range(1, len(w) - least(5, len(w)) + 2)) AS j) WHERE len(w) > 0),
ds AS (SELECT DISTINCT r, doc_id, k, array_to_string(w[j : j + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM x), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS j)),
n AS (SELECT item_id, count(*) AS n_item FROM x GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, CAST(count(*) AS DOUBLE) / n_item AS containment
FROM ds JOIN x USING (k, s) JOIN n USING (item_id) GROUP BY r, doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item
""",
    "op6_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS t FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS s)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p FROM late, LATERAL (SELECT unnest(range(s, s + 20)) AS p)),
word AS (SELECT doc_id, p, w[p] AS x FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS k FROM (SELECT word.* FROM word ANTI JOIN gone USING (doc_id, p)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
    "op10_url_filter": """
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '(?s)^([^?#]*)', 1) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, regexp_extract(rest, '(?s)^([^/]*)', 1) AS raw, rest FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(raw) + 1) AS path FROM h),
k(r_host, r_path, r_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT host, path, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(r_host) + length(r_path) DESC, length(r_host) DESC) AS n
  FROM (SELECT DISTINCT host, path FROM p) d JOIN k ON (d.host = r_host OR ends_with(d.host, '.' || r_host)) AND starts_with(d.path, r_path))
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.r_verdict, 'allow') AS verdict
FROM p LEFT JOIN best b ON b.host = p.host AND b.path = p.path AND b.n = 1
""",
}
