"""Not-modified revisit resolution for web-archive records: an as-of join by canonical URL.

A revisit record says that the server answered "not modified". It is resolved to the latest earlier full response of the same canonical
URL; if the validators agree, the response's headers are brought up to date by those headers that such an answer may change.

Time is cut into ranges. Within (URL, range) a window carries the last response forward; a response
of an earlier range comes from a table of one row a (URL, range). So a URL of any number of records is many groups, and
only validators and headers are dealt out, never payloads.

Records: record_id long, url string, time long, kind string ("response" or "revisit"), etag string, last_modified string, digest string,
headers map<string,string>. Defined cases: a response at the same time is not earlier; of responses of one time the largest record_id counts;
a null time is before all others; a null URL resolves to nothing; records of other kinds are left out; header names are compared and returned in
lower case (of names equal but for case, the first in order stays); repeated revisits each get a row; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstline.llm.common import partitions, range_bucket

#: Headers that a not-modified answer may change (RFC 9110, 15.4.5, and Last-Modified).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that name a campaign or a session, not a page.
NO_PAGE = "utm_[a-z]+|gclid|fbclid|sid|sessionid|jsessionid|phpsessid"


def canonical_url(url):
    """host and path of a URL without scheme, user, default port, leading www., fragment, session parameters and last slash;
    host in lower case, parameters in order."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    tail = F.substr(rest, F.length(host) + 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(host), r"^.*@", ""), r":(80|443)?$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(tail, r"^[^?]*", 0), r"/+$", "")
    query = F.regexp_extract(tail, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(F.lower(p), F.lit(f"^({NO_PAGE})(=|$)"))))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _lowered(headers):
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    sorted_entries = F.array_sort(F.coalesce(entries, F.expr("array()").cast("array<struct<key:string,value:string>>")))
    first = F.filter(sorted_entries, lambda e, i: (i == 0) | (F.get(sorted_entries, i - 1)["key"] != e["key"]))
    return F.map_from_entries(first)


def _weak(tag):
    return F.regexp_replace(tag, r"^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """A row for each revisit: record_id, url (canonical), time, source_id (the response; null if there is none), outcome
    ("resolved"; "unverified" without a common validator; "changed" if one differs; "missing"), headers (merged; null unless resolved or unverified)."""
    spark = records.sparkSession
    rows = records.where("kind in ('response', 'revisit')").select("record_id", canonical_url(F.col("url")).alias("url"), F.coalesce(F.col("time"), F.lit(-(2**63))).alias("time"), F.col("time").alias("told"), (F.col("kind") == "response").alias("full"), "etag", "last_modified", "digest", "headers")
    n = 4 * partitions(spark)
    cuts = rows.agg(F.percentile_approx("time", [i / n for i in range(1, n)], F.lit(max(10_000, 4 * n)))).first()[0] or []
    own = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    dealt = rows.withColumns({"range": range_bucket(F.col("time"), sorted(set(cuts))), "response": F.when(F.col("full"), own)})
    # A null URL is nobody's: such rows are spread by their id.
    dealt = dealt.withColumn("key", F.coalesce("url", F.concat(F.lit("\u0000"), F.col("record_id").cast("string"))))
    here = Window.partitionBy("key", "range").orderBy("time", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    last = dealt.where("full").groupBy("key", "range").agg(F.max_by("response", F.struct("time", "record_id")).alias("last"))
    revisits = dealt.withColumn("near", F.last("response", ignorenulls=True).over(here)).where("not full")
    asked = revisits.where("near is null").select("key", "range").distinct()
    both = asked.select("key", "range", F.lit(None).cast(last.schema["last"].dataType).alias("last"), F.lit(0).alias("side")).unionByName(last.withColumn("side", F.lit(1)))
    back = Window.partitionBy("key").orderBy("range", "side").rowsBetween(Window.unboundedPreceding, -1)
    far = both.withColumn("far", F.last("last", ignorenulls=True).over(back)).where("side = 0 and far is not null").select("key", "range", "far")
    found = revisits.join(far, ["key", "range"], "left").withColumn("source", F.coalesce("near", "far"))
    return _outcome(found)


def _outcome(found: DataFrame) -> DataFrame:
    pairs = [(_weak(F.col("etag")), _weak(F.col("source.etag"))), (F.col("last_modified"), F.col("source.last_modified")), (F.col("digest"), F.col("source.digest"))]
    differs, agrees = F.lit(False), F.lit(False)
    for a, b in pairs:
        differs |= F.coalesce(a != b, F.lit(False))
        agrees |= F.coalesce(a == b, F.lit(False))
    outcome = F.when(F.col("source").isNull(), "missing").when(differs, "changed").when(agrees, "resolved").otherwise("unverified")
    stored = _lowered(F.col("source.headers"))
    new = F.map_filter(_lowered(F.col("headers")), lambda k, v: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(new, k)), new)
    out = found.withColumn("outcome", outcome)
    return out.select("record_id", "url", F.col("told").alias("time"), F.col("source.record_id").alias("source_id"), "outcome", F.when(F.col("outcome").isin("resolved", "unverified"), merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Records of two crawls over pages (page_id, url, html): each page answered in full at twice its id, and asked again
    some odd time later with the validators of its own text, when it was answered as not modified."""
    digest = F.md5(F.coalesce(F.col("html").cast("string"), F.lit("")))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    later = 1 + 2 * F.position(F.substr(F.md5(url), F.lit(1), F.lit(1)), F.lit("0123456789abcdef"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), digest.alias("digest"), F.length(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("size"), later.alias("later"))
    full = base.select(
        (2 * F.col("page_id")).alias("record_id"), "url", (2 * F.col("page_id")).alias("time"), F.lit("response").alias("kind"), "digest",
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size").cast("string"), F.lit("ETag"), F.col("digest"), F.lit("Date"), (2 * F.col("page_id")).cast("string")).alias("headers"),
    )
    again = base.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url", (2 * F.col("page_id") + F.col("later")).alias("time"), F.lit("revisit").alias("kind"), "digest",
        F.create_map(F.lit("date"), (2 * F.col("page_id") + F.col("later")).cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    both = full.unionByName(again)
    return both.select("record_id", "url", "time", "kind", F.concat(F.lit("W/"), "digest").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"), "headers")
