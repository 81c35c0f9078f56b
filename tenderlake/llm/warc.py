"""WARC revisit records of the server-not-modified profile, resolved by an as-of join.

A revisit takes the latest full response of the same canonical URL that was captured
strictly earlier.  Both are put in time buckets: a window within (URL, bucket) finds the
latest response of the bucket, and a window over one row per (URL, bucket) carries the last
one of the buckets before, so the captures of a very common URL spread over tasks.  Only
validators, permitted headers and record ids move; bodies are joined by record id on demand.
Records are read from and written to their text form by string functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, table

#: Headers of a 304 answer that replace those of the stored response (fixed by HTTP semantics).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
BUCKET = 1 << 14


def canonical_url(url: Column) -> Column:
    """Without scheme, user, ``www.``, default port, fragment, ``utm_`` parameters and last slash;
    the host in lower case and parameters in order.  Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.element_at(headers, F.lit("etag")), "^W/", "")


_END = "\r\n"


def _iso(ts: Column) -> Column:
    """Seconds as an ISO instant, whatever the session's time zone."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    left = F.pmod(ts, F.lit(86400))
    clock = F.concat_ws(":", two(F.floor(left / 3600)), two(F.floor(left % 3600 / 60)), two(left % 60))
    return F.concat(F.date_from_unix_date(F.floor(ts / 86400).cast("int")).cast("string"), F.lit("T"), clock, F.lit("Z"))


def _seconds(iso: Column) -> Column:
    part = lambda at: F.try_to_number(F.substring(iso, at, 2), F.lit("99")).cast("long")
    day = F.unix_date(F.substring(iso, 1, 10).try_cast("date")).cast("long")
    return day * 86400 + part(12) * 3600 + part(15) * 60 + part(18)


def to_text(records: DataFrame) -> DataFrame:
    """(record): each of (record_id, kind, url, ts, headers, digest, body) as the text of a WARC
    record with an HTTP message.  Lines of null fields are left out."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    warc = F.concat_ws(
        _END, F.lit("WARC/1.1"), line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:record:"), F.col("record_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.col("url")), line("WARC-Date", _iso(F.col("ts"))), line("WARC-Payload-Digest", F.col("digest")),
        F.when(F.col("kind") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified")),
        F.lit("Content-Type: application/http; msgtype=response"),
    )
    status = F.when(F.col("kind") == "revisit", "HTTP/1.1 304 Not Modified").otherwise("HTTP/1.1 200 OK")
    http = F.concat_ws(_END, F.array(status), F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return records.select(F.concat(warc, F.lit(2 * _END), http, F.lit(2 * _END), F.coalesce("body", F.lit(""))).alias("record"))


def _field(head: Column, name: str) -> Column:
    """The value of a header line, null where there is none; names match in any case."""
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _headers(block: Column) -> Column:
    """Header lines after the first as a map with names in lower case; of a repeated name the last counts."""
    name = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    value = lambda x: F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x)))
    lines = F.filter(F.slice(F.split(block, _END), 2, 1 << 20), lambda x: F.contains(x, F.lit(":")))
    return F.aggregate(
        lines, F.create_map().cast("map<string,string>"),
        lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != name(x)), F.create_map(name(x), value(x))),
    )


def read_text(records: DataFrame) -> DataFrame:
    """(record_id, kind, url, ts, headers, digest, body) of text records (record).  Fields that a
    record lacks are null; what is no WARC record, or null, is left out."""
    text = F.col("record")
    head = F.substring_index(text, 2 * _END, 1)
    parts = records.where(text.startswith("WARC/1.")).select(head.alias("head"), F.substring(text, F.length(head) + 5, F.length(text)).alias("rest"))
    http = F.substring_index("rest", 2 * _END, 1)
    field = lambda name: _field(F.col("head"), name)
    return parts.select(
        F.regexp_extract(field("WARC-Record-ID"), "([0-9]+)>", 1).try_cast("long").alias("record_id"), field("WARC-Type").alias("kind"),
        field("WARC-Target-URI").alias("url"), _seconds(field("WARC-Date")).alias("ts"), _headers(http).alias("headers"),
        field("WARC-Payload-Digest").alias("digest"), F.substring(F.col("rest"), F.length(http) + 5, F.length("rest")).alias("body"),
    )


def resolve(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row for each revisit of ``records`` (record_id, kind, url, ts, headers, digest).

    ``kind`` is response or revisit, ``ts`` a long, ``headers`` a map with lower-case names.
    Returns record_id, url_key, ts, response_id, status, headers, digest: ``status`` is
    resolved, mismatch (a validator of both differs, or they share none) or no_response;
    only resolved rows have the merged headers and the digest of the response.  Null URLs or
    times resolve to nothing; of responses at one time the larger record id counts; repeated
    revisits stay; other columns are not read.
    """
    known = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "headers", "digest")
    # Rows without URL or time meet nothing; they stay out of the windows, where they would be one key.
    whole = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    lone = known.where(~whole & (F.col("kind") == "revisit"))
    keyed = known.where(whole).withColumn("_bucket", F.floor(F.col("ts") / F.lit(bucket)))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", F.col("digest").alias("digest"), F.map_entries("headers").alias("entries")))
    inside = Window.partitionBy("url_key", "_bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    latest = keyed.withColumn("_in", F.max(full).over(inside)).where("kind = 'revisit'")
    ends = keyed.where("kind = 'response'").groupBy("url_key", "_bucket").agg(F.max(full).alias("_end"))
    heads = keyed.where("kind = 'revisit'").select("url_key", "_bucket").distinct()
    steps = ends.join(heads, ["url_key", "_bucket"], "full")
    before = Window.partitionBy("url_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).select("url_key", "_bucket", "_before")
    found = latest.join(carried, ["url_key", "_bucket"], "left").withColumn("_r", F.coalesce("_in", "_before"))
    found = found.unionByName(lone, allowMissingColumns=True)
    old = F.map_from_entries("_r.entries")
    tag, old_tag = _tag(F.col("headers")), _tag(old)
    date, old_date = F.element_at("headers", F.lit("last-modified")), F.element_at(old, F.lit("last-modified"))
    same = F.when(tag.isNotNull() & old_tag.isNotNull(), tag == old_tag).otherwise(F.coalesce(date == old_date, F.lit(False)))
    status = F.when(F.col("_r").isNull(), "no_response").when(same, "resolved").otherwise("mismatch")
    new = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    good = F.col("status") == "resolved"
    return found.withColumn("status", status).select(
        "record_id", "url_key", "ts", F.col("_r.record_id").alias("response_id"), "status",
        F.when(good, merged).alias("headers"), F.when(good, F.col("_r.digest")).alias("digest"),
    )


def with_bodies(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """The resolved revisits with the body of their response."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("response_id"), "body")
    return resolved.where("status = 'resolved'").join(bodies, "response_id", "left")


#: Seconds after its first capture at which a page is fetched again, each time with other content.
AGAIN = (0, 1000, 5000)


def page_records(pages: DataFrame) -> DataFrame:
    """Captures of ``pages``: three full responses of each, and a not-modified revisit after each.
    The first response holds the page, the others a line.

    Every seventh page's revisits name an entity tag that no response has, every eleventh's have
    only a date, and every thirteenth's come before their response.
    """
    page, n, revisit = F.col("page_id"), F.col("n"), F.col("k") == 1
    base = pages.select("page_id", "url", "html", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("base"))
    rows = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * len(AGAIN) - 1))).alias("i")).select(
        "*", F.floor(F.col("i") / 2).alias("n"), (F.col("i") % 2).alias("k"))
    after = F.element_at(F.array(*map(F.lit, AGAIN)), (n + 1).cast("int"))
    seen = page * 2 + after
    rows = rows.select(
        "page_id", "url", "html", "n", "k", F.md5(F.concat("base", n.cast("string")).cast("binary")).alias("tag"),
        F.concat(F.lit("day "), ((page + n) % 28).cast("string")).alias("day"),
        F.when(~revisit, seen).when(page % 13 == 0, seen - 1).otherwise(seen + 101).alias("ts"),
    )
    sent = F.when(revisit, F.concat(F.lit("W/"), F.when(page % 7 == 0, F.lit("none")).otherwise(F.col("tag")))).otherwise(F.col("tag"))
    dated = ~revisit | (page % 11 == 0)
    entries = F.filter(F.array(
        F.struct(F.lit("etag").alias("key"), F.when(~revisit | (page % 11 != 0), sent).alias("value")),
        F.struct(F.lit("last-modified").alias("key"), F.when(dated, F.col("day")).alias("value")),
        F.struct(F.lit("content-type").alias("key"), F.when(revisit, "text/plain").otherwise("text/html").alias("value")),
        F.struct(F.lit("date").alias("key"), F.col("ts").cast("string").alias("value")),
    ), lambda e: e["value"].isNotNull())
    return rows.select(
        (page * 6 + n * 2 + F.col("k")).cast("long").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("kind"), "url", F.col("ts").cast("long").alias("ts"),
        F.map_from_entries(entries).alias("headers"), F.when(~revisit, F.col("tag")).alias("digest"),
        F.when(~revisit, F.when(n == 0, F.col("html")).otherwise(F.concat(F.lit("page "), "tag"))).alias("body"),
    )


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit among the captures of ``pages``, written and read as WARC records."""
    records = materialize(to_text(page_records(table(spark, sf_dir, "pages"))), "warc")
    found = resolve(materialize(read_text(records).drop("body"), "records"))
    head = lambda k: F.element_at("headers", F.lit(k))
    return found.select(
        "record_id", "url_key", "ts", "response_id", "status", "digest", head("etag").alias("etag"),
        head("last-modified").alias("last_modified"), head("content-type").alias("content_type"), head("date").alias("date_sent"),
    )


OP3_SQL = r"""
WITH cap AS (
  SELECT page_id, n, page_id * 2 + CASE n WHEN 0 THEN 0 WHEN 1 THEN 1000 ELSE 5000 END AS seen,
         md5(md5(coalesce(html, '')) || CAST(n AS VARCHAR)) AS tag, 'day ' || CAST((page_id + n) % 28 AS VARCHAR) AS day,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS bare
  FROM pages, range(3) r(n)),
keyed AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
         list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS params
  FROM cap),
urls AS (SELECT *, base || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key FROM keyed),
resp AS (SELECT page_id * 6 + 2 * n AS rid, url_key, seen AS ts, tag, day FROM urls),
rev AS (SELECT page_id * 6 + 2 * n + 1 AS record_id, url_key, CASE WHEN page_id % 13 = 0 THEN seen - 1 ELSE seen + 101 END AS ts,
               CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'none' ELSE tag END AS sent,
               CASE WHEN page_id % 11 = 0 THEN day END AS sent_day FROM urls),
met AS (SELECT rev.*, resp.rid, resp.tag, resp.day FROM rev ASOF LEFT JOIN resp ON rev.url_key = resp.url_key AND rev.ts > resp.ts),
said AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_response'
                        WHEN coalesce(CASE WHEN sent IS NOT NULL THEN sent = tag ELSE sent_day = day END, false) THEN 'resolved'
                        ELSE 'mismatch' END AS status FROM met)
SELECT record_id, url_key, ts, rid AS response_id, status,
       CASE WHEN status = 'resolved' THEN tag END AS digest,
       CASE WHEN status = 'resolved' THEN coalesce('W/' || sent, tag) END AS etag,
       CASE WHEN status = 'resolved' THEN coalesce(sent_day, day) END AS last_modified,
       CASE WHEN status = 'resolved' THEN 'text/html' END AS content_type,
       CASE WHEN status = 'resolved' THEN CAST(ts AS VARCHAR) END AS date_sent
FROM said
"""
