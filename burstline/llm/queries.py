"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.llm import decontaminate, fingerprint, packing, quality, records, simhash, substring, tokens, toxicity, urlfilter, warc

WINDOW = 13
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokens.default_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(_table(spark, sf_dir, "documents"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), WINDOW)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers come as text, in order of their names."""
    found = warc.resolve(warc.captures(_table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select(F.floor(F.col("record_id") / 2).alias("page_id"), "url", "time", F.floor(F.col("source_id") / 2).alias("source_page_id"), "outcome", F.array_join(lines, "\n").alias("headers"))


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.round_trip(_table(spark, sf_dir, "documents"), tokens.default_path())
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS r(host, path, verdict)")
    return urlfilter.judge(_table(spark, sf_dir, "pages"), rules)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_fingerprint": op5_fingerprint,
    "op6_substring": op6_substring,
    "op7_warc": op7_warc,
    "op8_records": op8_records,
    "op9_quality": op9_quality,
    "op10_urlfilter": op10_urlfilter,
}

_HOST = "CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = "CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"

_SHINGLES = r"""(SELECT DISTINCT {id}, s FROM (SELECT {id}, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
        FROM (SELECT {id}, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM {table}) WHERE len(w) >= 5))"""

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": f"""
        WITH q AS {_SHINGLES.format(id="item_id", table="benchmark")}, d AS {_SHINGLES.format(id="doc_id", table="documents")},
        n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id)
        SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
        FROM d JOIN q USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item""",
    "op6_substring": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
        least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
        hit AS (SELECT doc_id, i FROM win JOIN least USING (s) WHERE doc_id > m),
        gone_words AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM hit)),
        every AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
                 FROM every ANTI JOIN gone_words USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op7_warc": r"""
        WITH a AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS r, md5(coalesce(html, '')) AS d,
                   length(coalesce(html, '')) AS size, 2 * page_id AS t, 2 * page_id + 1 + 2 * strpos('0123456789abcdef', md5(coalesce(url, ''))[1]) AS again FROM pages),
        b AS (SELECT *, regexp_extract(r, '^[^/?]*') AS h FROM a),
        c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(h), '^.*@', ''), ':(80|443)?$', ''), '^www\d*\.', '') AS host, substr(r, length(h) + 1) AS tail FROM b),
        e AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(tail, '\?(.*)$', 1), '&'), lambda p: p <> ''
                   AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|gclid|fbclid|sid|sessionid|jsessionid|phpsessid)(=|$)'))) AS q FROM c),
        f AS (SELECT page_id, d, size, t, again, host || regexp_replace(regexp_extract(tail, '^[^?]*'), '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM e),
        g AS (SELECT x.page_id, x.url, x.again, x.d, y.page_id AS source, y.d AS d2, y.size FROM f x ASOF LEFT JOIN f y ON x.url = y.url AND x.again > y.t)
        SELECT page_id, url, CAST(again AS BIGINT) AS time, source AS source_page_id, CASE WHEN source IS NULL THEN 'missing' WHEN d = d2 THEN 'resolved' ELSE 'changed' END AS outcome,
               CASE WHEN d = d2 THEN concat('cache-control: max-age=60', chr(10), 'content-length: ', size, chr(10), 'content-type: text/html', chr(10), 'date: ', again, chr(10), 'etag: ', d2) END AS headers FROM g""",
    "op10_urlfilter": f"""
        WITH r(host, path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
        u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        f AS (SELECT page_id, max_by({{'rule': r.host || r.path, 'verdict': verdict}}, length(r.host || r.path)) AS best
              FROM u JOIN r ON (u.host = r.host OR suffix(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY page_id)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)""",
}
