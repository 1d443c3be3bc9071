"""Resolution of not-modified revisits in web archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 86_400

#: Header fields of a 304 that never replace stored ones (RFC 9110 and 9111: framing, hop-by-hop and representation fields).
NOT_MERGED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]


#: Default ports by scheme.
PORTS = {"http": "80", "https": "443"}
FULL = (200, 203)  # statuses of full responses that a 304 may repeat


def _escapes(part: Column) -> Column:
    """Percent escapes in upper case; those of letters, digits and -._~ decoded; a stray % stays."""

    def one(p, i):
        code = F.upper(F.substring(p, 1, 2))
        char = F.decode(F.unhex(code), "UTF-8")
        plain = F.when(code.rlike("^[2-7][0-9A-F]$") & char.rlike("^[A-Za-z0-9._~-]$"), char).otherwise(F.concat(F.lit("%"), code))
        return F.when(i == 0, p).when(code.rlike("^[0-9A-F]{2}$"), F.concat(plain, F.substring(p, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), p))

    return F.array_join(F.transform(F.split(part, "%"), one), "")


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved."""
    segments = F.split(path, "/")
    walked = F.aggregate(
        segments,
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(s == ".", acc).when((s == "..") & (F.size(acc) > 1), F.slice(acc, 1, F.size(acc) - 1)).when(s == "..", acc).otherwise(F.array_append(acc, s)),
    )
    out = F.concat(F.array_join(walked, "/"), F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), out).otherwise(path)


def canonical_url(url: Column) -> Column:
    """Scheme-less key of a URL.

    Host in lower case without user, the default port of its scheme and a trailing
    dot; path with dot segments resolved; query parameters sorted, without
    tracking (utm_*) ones and empty ones; escapes normalised; no fragment. Other
    ports stay, so that http://h:443/ and https://h/ differ.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^.*@", "")
    for name, port in PORTS.items():
        host = F.when((scheme == name) | ((scheme == "") & (port == F.lit("80"))), F.regexp_replace(host, f":{port}$", "")).otherwise(host)
    host = F.regexp_replace(host, r":$|\.(?=:|$)", "")
    path = _without_dots(_escapes(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1)))
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^utm_[a-z]+=")))
    query = F.array_join(F.transform(kept, _escapes), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Joins every 304 to the latest earlier full response of its canonical URL.

    records: record_id bigint, url string, captured_at bigint (seconds), status
    int, headers map<string,string> (names in any case). Full responses are those
    of a status in FULL. Returns one row for each record of status 304:
    record_id, canonical_url, captured_at, source_id (the record_id of the
    response, null if none), outcome and headers, the merged map with lower-case
    names (null unless merged).

    outcome: ``resolved`` if the 304 repeats the response's ETag (weak comparison)
    or, without an ETag on either side, its Last-Modified; ``unverified`` if they
    share no validator; ``mismatch`` if the validator differs; ``orphan`` without an
    earlier response. Headers are merged for the first two: fields of the 304
    replace the stored ones, save framing and representation fields.

    Bodies never move, and no key is unbounded: responses are first reduced to
    the last of each (URL, second), revisits to their different (URL, second)s.
    The as-of join then has two levels: within each (URL, time bucket) of at most
    ``bucket_seconds`` such seconds, and over the buckets of a URL, of which each
    hands on its last response. Revisits join the (URL, second) they share.

    Null url or time: an orphan, outside the join. Equal times: a response at the
    revisit's own second isn't earlier; among responses of one second the larger
    record_id is later. Repeated rows each count. Null headers: none. Names that
    differ in case only: the first counts. Very long URLs and values pass through
    whole. Empty table: no rows. Extra columns, whatever their names, are ignored.
    """
    names = F.array_distinct(F.transform(F.map_keys("headers"), F.lower))
    low = F.map_from_arrays(names, F.transform(names, lambda k: F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == k)[0]["value"]))
    low = F.map_filter(low, lambda _, v: v.isNotNull())
    r = records.select(
        F.col("record_id").cast("bigint").alias("record_id"),
        canonical_url(F.col("url").cast("string")).alias("canonical_url"),
        F.col("captured_at").cast("bigint").alias("at"),
        F.col("status").cast("int").alias("status"),
        F.coalesce("headers", F.expr("cast(map() as map<string,string>)")).alias("headers"),
    ).where(F.col("status").isin(304, *FULL))
    r = r.withColumn("headers", low)
    known = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    revisits = r.where("status = 304")
    last = F.max_by(F.struct(F.col("record_id").alias("source_id"), F.col("headers").alias("stored")), F.coalesce("record_id", F.lit(-(2**63))))
    responses = r.where(F.col("status").isin(*FULL) & known).groupBy("canonical_url", "at").agg(last.alias("full"))
    asked = revisits.where(known).select("canonical_url", "at").distinct()
    points = responses.select("canonical_url", "at", "full").unionByName(asked.withColumn("full", F.lit(None).cast(responses.schema["full"].dataType)))
    points = points.withColumn("bucket", F.floor(F.col("at") / bucket_seconds).cast("bigint"))
    # at one second, the revisit comes first: it doesn't see that second's response
    order = Window.partitionBy("canonical_url", "bucket").orderBy("at", F.col("full").isNotNull())
    points = points.withColumn("near", F.last("full", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    ends = responses.groupBy("canonical_url", F.floor(F.col("at") / bucket_seconds).cast("bigint").alias("bucket")).agg(F.max_by("full", "at").alias("end"))
    ends = ends.unionByName(asked.select("canonical_url", F.floor(F.col("at") / bucket_seconds).cast("bigint").alias("bucket")).distinct().withColumn("end", F.lit(None).cast(responses.schema["full"].dataType)))
    before = Window.partitionBy("canonical_url").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("far", F.last("end", ignorenulls=True).over(before)).groupBy("canonical_url", "bucket").agg(F.first("far").alias("far"))
    found = points.where("full is null").join(carried, ["canonical_url", "bucket"], "left").select(F.col("canonical_url").alias("u"), F.col("at").alias("t"), F.coalesce("near", "far").alias("src"))
    both = revisits.join(found, (F.col("canonical_url") == F.col("u")) & (F.col("at") == F.col("t")), "left")
    weak = lambda m: F.regexp_replace(m["etag"], "^W/", "")
    mine, stored = F.col("headers"), F.col("src.stored")
    outcome = (
        F.when(F.col("src").isNull(), "orphan")
        .when(mine["etag"].isNotNull() & stored["etag"].isNotNull(), F.when(weak(mine) == weak(stored), "resolved").otherwise("mismatch"))
        .when(mine["last-modified"].isNotNull() & stored["last-modified"].isNotNull(), F.when(mine["last-modified"] == stored["last-modified"], "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    allowed = F.map_filter(mine, lambda k, _: ~k.isin(NOT_MERGED))
    merged = F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    return both.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", F.col("at").alias("captured_at"), F.col("src.source_id").alias("source_id"), "outcome", F.when(F.col("outcome").isin("resolved", "unverified"), merged).alias("headers")
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records made of crawled pages, ten record numbers a page; a page is captured at hour page_id.

    Of the page itself: a full response with an ETag (page_id mod 8 = 0, 1, 3, 5),
    with Last-Modified only (4, 6) or without validators (7), or none (2); mod 8
    = 1 and 5: another one of other content, 5 within the same second; then a 304
    of the page's address with tracking and a fragment in it, two days later, that
    repeats the first response's ETag or, where mod 8 = 4 and 6, a Last-Modified
    (6: another one); mod 8 = 3: in the second of the response. Of its host's
    /robots.txt: a 304, or a full response where page_id mod 5 = 0, with an ETag
    that changes every 40 pages.
    """
    kind = F.col("page_id") % 8
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    at = F.col("page_id") * 3600
    ident = F.col("page_id") * 10
    text = lambda x: x if isinstance(x, Column) else F.lit(x)

    def record(k, url, seconds, status, **headers):
        fields = F.map_filter(F.create_map(*[text(x) for n, v in headers.items() for x in (n.replace("_", "-"), v)]), lambda _, v: v.isNotNull())
        return F.struct((ident + k).alias("record_id"), url.alias("url"), seconds.alias("captured_at"), F.lit(status).alias("status"), fields.alias("headers"))

    etag = lambda v: F.when(kind.isin(0, 1, 2, 3, 5), v)
    changed = F.when(kind.isin(4, 6), F.concat(F.lit("day "), (F.col("page_id") % 30).cast("string")))
    first = record(0, F.col("url"), at, 200, **{"Content-Type": "text/html", "Content-Length": F.length("html").cast("string"), "ETag": etag(tag), "Last-Modified": changed, "Date": at.cast("string"), "Cache-Control": "max-age=60"})
    second = record(1, F.col("url"), F.when(kind == 5, at).otherwise(at + 86_400), 200, **{"Content-Type": "text/html", "ETag": F.concat(F.lit('"x'), F.md5("html"), F.lit('"')), "Date": at.cast("string")})
    later = F.when(kind == 3, at).otherwise(at + 172_800)
    tracked = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), F.lit("&")).otherwise("?"), F.lit("utm_source=feed#again"))
    again = record(2, tracked, later, 304, **{"Content-Length": "0", "ETag": F.when(kind != 4, F.concat(F.lit("W/"), tag)), "Last-Modified": F.when(kind == 6, "never").otherwise(changed), "Date": later.cast("string"), "Expires": (later + 3600).cast("string")})
    host = F.regexp_extract("url", "^([^/]*//[^/?#]*)", 1)
    robots = F.concat(host, F.lit("/robots.txt"))
    version = F.concat(F.lit('"v'), F.floor(F.col("page_id") / 40).cast("string"), F.lit('"'))
    own = record(3, robots, at, 200, **{"Content-Type": "text/plain", "ETag": version, "Date": at.cast("string")})
    polled = record(3, robots, at, 304, **{"ETag": version, "Date": at.cast("string")})
    shown = F.array(F.when(kind != 2, first), F.when(kind.isin(1, 5), second), again, F.when(F.col("page_id") % 5 == 0, own).otherwise(polled))
    return pages.select(F.explode(F.filter(shown, lambda x: x.isNotNull())).alias("r")).select("r.*")


def op2_query(spark, sf_dir: str) -> DataFrame:
    out = resolve_revisits(records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.withColumn("headers", F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n"))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, page_id % 8 AS kind, url, '"' || md5(html) || '"' AS tag, length(html) AS n, page_id * 3600 AS secs,
    'day ' || (page_id % 30) AS day, '"v' || (page_id // 40) || '"' AS version FROM pages),
records AS (
  SELECT page_id * 10 AS record_id, url, secs AS captured_at, 200 AS status, CASE WHEN kind IN (0, 1, 3, 5) THEN tag END AS etag, CASE WHEN kind IN (4, 6) THEN day END AS modified,
    'text/html' AS type, CAST(n AS VARCHAR) AS size, 'max-age=60' AS cache, NULL AS expires FROM p WHERE kind <> 2
  UNION ALL SELECT page_id * 10 + 1, url, CASE WHEN kind = 5 THEN secs ELSE secs + 86400 END, 200, '"x' || substr(tag, 2), NULL, 'text/html', NULL, NULL, NULL FROM p WHERE kind IN (1, 5)
  UNION ALL SELECT page_id * 10 + 2, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=feed#again', CASE WHEN kind = 3 THEN secs ELSE secs + 172800 END, 304,
    CASE WHEN kind <> 4 THEN 'W/' || tag END, CASE WHEN kind = 6 THEN 'never' WHEN kind = 4 THEN day END, NULL, NULL, NULL, CAST(CASE WHEN kind = 3 THEN secs ELSE secs + 172800 END + 3600 AS VARCHAR) FROM p
  UNION ALL SELECT page_id * 10 + 3, regexp_extract(url, '^([^/]*//[^/?#]*)', 1) || '/robots.txt', secs, CASE WHEN page_id % 5 = 0 THEN 200 ELSE 304 END, version, NULL, CASE WHEN page_id % 5 = 0 THEN 'text/plain' END, NULL, NULL, NULL FROM p),
u AS (
  SELECT *, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM records),
q AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), CASE scheme WHEN 'https' THEN ':443$' ELSE ':80$' END, '') AS host, regexp_extract(bare, '^[^/?]*([^?]*)', 1) AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^utm_[a-z]+='))), '&') AS query FROM u),
c AS (
  SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical_url, CASE WHEN status = 200 THEN captured_at ELSE NULL END AS dated FROM q),
full_ AS (SELECT canonical_url, captured_at, max_by(c, record_id) AS s FROM c WHERE status = 200 GROUP BY ALL),
j AS (
  SELECT r.*, f.s FROM (SELECT *, captured_at - 1 AS till FROM c WHERE status = 304) r ASOF LEFT JOIN full_ f ON r.canonical_url = f.canonical_url AND r.till >= f.captured_at),
o AS (
  SELECT *, CASE WHEN s IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL AND s.etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = s.etag THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NOT NULL AND s.modified IS NOT NULL THEN CASE WHEN modified = s.modified THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unverified' END AS outcome FROM j)
SELECT record_id, canonical_url, captured_at, s.record_id AS source_id, outcome,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN concat_ws(chr(10), 'cache-control: ' || s.cache, 'content-length: ' || s.size, 'content-type: ' || s.type, 'date: ' || captured_at,
    'etag: ' || coalesce(etag, s.etag), 'expires: ' || expires, 'last-modified: ' || coalesce(modified, s.modified)) END AS headers
FROM o
"""
