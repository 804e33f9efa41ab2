from helpers import rng
from pyspark.sql import functions as F

from burstline.llm import warc

SCHEMA = "record_id long, url string, time long, kind string, etag string, last_modified string, digest string, headers map<string,string>, range string, key string"


def canonical(spark, *urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    return [r.c for r in df.select("i", warc.canonical_url(F.col("u")).alias("c")).orderBy("i").collect()]


def test_canonical_urls(spark):
    got = canonical(spark, "HTTP://www.Example.com:80/a/b/?b=2&a=1&utm_source=x#f", "https://example.com/a/b?a=1&b=2", "http://u:p@EXAMPLE.com/A/", "example.com", "", None)
    assert got == ["example.com/a/b?a=1&b=2", "example.com/a/b?a=1&b=2", "example.com/A", "example.com", "", None]


def slow(records):
    out = []
    for r in records:
        if r[3] != "revisit":
            continue
        before = [x for x in records if x[3] == "response" and r[1] is not None and x[1] == r[1] and (x[2] if x[2] is not None else -(2**63)) < (r[2] if r[2] is not None else -(2**63))]
        if not before:
            out.append((r[0], None, "missing", None))
            continue
        s = max(before, key=lambda x: (x[2] if x[2] is not None else -(2**63), x[0]))
        tags = [(a, b) for a, b in ((r[4] and r[4].removeprefix("W/"), s[4] and s[4].removeprefix("W/")), (r[5], s[5]), (r[6], s[6])) if a is not None and b is not None]
        outcome = "changed" if any(a != b for a, b in tags) else "resolved" if tags else "unverified"
        low = lambda h: {k: v for k, v in reversed(sorted((k.lower(), v) for k, v in (h or {}).items()))}
        merged = low(s[7]) | {k: v for k, v in low(r[7]).items() if k in warc.PERMITTED}
        out.append((r[0], s[0], outcome, None if outcome == "changed" else merged))
    return out


def test_against_a_loop(spark):
    draw = rng(8)
    records = []
    for i in range(400):
        a, b, c, d, e = draw.integers(0, [3, 60, 2, 3, 3]).tolist()
        url = None if i % 50 == 0 else "hot.com/x" if a == 0 else f"site{a}.com/{b % 5}"
        headers = None if i % 31 == 0 else {"ETag": f"{d}", "Content-Length": str(i), "DATE": str(b), "X-Own": "1"}
        records.append((i, url, None if i % 90 == 1 else b, "response" if c else "revisit", [None, "W/x", "x", "y"][d + (i % 2)], [None, "m", "n"][e], None, headers, "clash", "clash"))
    records += [records[3]] * 2 + [(900, "a.com", 5, "request", None, None, None, None, "", "")]
    got = [(r.record_id, r.source_id, r.outcome, r.headers) for r in warc.resolve(spark.createDataFrame(records, SCHEMA)).collect()]
    assert sorted(got, key=repr) != [] and sorted(map(_stable, got), key=repr) == sorted(map(_stable, slow(records)), key=repr)


def _stable(x):
    return (*x[:3], None if x[3] is None else sorted(x[3].items()))


def test_empty(spark):
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
