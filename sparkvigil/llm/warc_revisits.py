"""Not-modified revisit resolution of WARC records, as an as-of join.

A `revisit` record (a 304 answer) stands for the latest earlier full response to
the same canonical URL. Records are dealt by canonical URL and time slot: inside
a slot a running window finds the latest response so far, and the last response
of each slot is carried to the later slots, so a URL with any share of the
records is spread over its slots and no window holds more than one slot of it.
Slots divide the time of all but the first and last thousandth of the records,
which fall into the first and the last slot, so odd times do not widen them;
records without time are dealt out.
Then the validators are checked: the entity tags by weak comparison if both
sides have one, else the modification dates; if they agree, the 304's headers
that HTTP caching permits (RFC 9111, 3.2) replace those of the stored response.

Verdicts: `resolved`; `mismatch` (the validators differ); `unverified` (nothing
to compare: the revisit has no validator that the response has too); `orphan`
(no earlier response). Headers are merged for resolved and unverified revisits.

Defined results: equal times are ordered by record_id, so of a response and a
revisit at the same time the smaller record_id is earlier; null url or time
gives an orphan, and such a response is no target; null headers are none; header
names are compared in lower case, the first of a repeated name counting; records
of other types are ignored; repeated records stay rows of their own; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Query parameters without influence on the answer. Fixed values.
IGNORED_PARAMETERS = ("fbclid", "gclid", "phpsessid", "ref", "sessionid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
#: Headers of a 304 that must not replace stored ones. Fixed values.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Without scheme, credentials, www., default port, fragment, trailing slash and ignored parameters; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    split = F.regexp_extract(bare, r"^([^/?]*)([^?]*)\??(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(split), r"^[^@]*@", ""), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)([^?]*)\??(.*)$", 2), "/+$", "")
    ignored = r"^(" + "|".join(IGNORED_PARAMETERS) + r")(=.*)?$"
    params = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"^([^/?]*)([^?]*)\??(.*)$", 3), "&"), lambda p: (p != "") & ~F.lower(p).rlike(ignored)))
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def lowered(headers: Column) -> Column:
    """The headers with names in lower case, the first of each name."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1)
    return F.coalesce(F.map_from_entries(first), F.create_map().cast("map<string,string>"))


def resolve_revisits(records: DataFrame, slots: int = 4096) -> DataFrame:
    """For each revisit: record_id, canonical_url, ts, target_id, target_ts, verdict and merged headers.

    records: record_id long, url string, ts long, type string, headers map<string,string>.
    """
    r = records.where("type in ('response', 'revisit')").select("record_id", "ts", "type", canonical_url(F.col("url")).alias("canonical_url"), lowered(F.col("headers")).alias("headers"))
    lo, hi = r.agg(F.percentile_approx("ts", [0.001, 0.999])).first()[0] or (0, 0)
    width = max(1, -(-(hi - lo + 1) // slots))
    timed = F.greatest(F.lit(0), F.least(F.lit(slots - 1), F.floor((F.col("ts") - F.lit(lo)) / width)))
    r = r.withColumn("slot", F.coalesce(timed, -1 - F.pmod(F.xxhash64("record_id"), F.lit(slots))))  # no target is without time
    answer = F.when((F.col("type") == "response") & F.col("canonical_url").isNotNull() & F.col("ts").isNotNull(), F.struct("ts", "record_id", "headers"))
    here = Window.partitionBy("canonical_url", "slot").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = r.withColumn("target", F.last(answer, ignorenulls=True).over(here)).where("type = 'revisit'")
    latest = r.where((F.col("type") == "response") & F.col("canonical_url").isNotNull() & F.col("ts").isNotNull())
    per_slot = latest.groupBy("canonical_url", "slot").agg(F.max_by(F.struct("ts", "record_id", "headers"), F.struct("ts", "record_id")).alias("end"))
    open_slots = seen.where("target is null and ts is not null and canonical_url is not null").select("canonical_url", "slot").distinct()
    before = Window.partitionBy("canonical_url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most `slots` rows a URL
    carried = per_slot.join(open_slots, ["canonical_url", "slot"], "full").withColumn("carry", F.last("end", ignorenulls=True).over(before)).where("carry is not null").select("canonical_url", "slot", "carry")
    found = seen.join(carried, ["canonical_url", "slot"], "left").withColumn("target", F.when(F.col("ts").isNotNull() & F.col("canonical_url").isNotNull(), F.coalesce("target", "carry")))
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    mine, other = F.col("headers"), F.col("target.headers")
    agree = F.coalesce(tag(mine) == tag(other), mine["last-modified"] == other["last-modified"])
    verdict = F.when(F.col("target").isNull(), "orphan").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    news = F.map_filter(mine, lambda k, v: ~k.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter(other, lambda k, v: ~F.coalesce(F.map_contains_key(news, k), F.lit(False))), news)
    out = found.withColumn("verdict", verdict)
    return out.select("record_id", "canonical_url", "ts", F.col("target.record_id").alias("target_id"), F.col("target.ts").alias("target_ts"), "verdict", F.when(F.col("verdict").isin("resolved", "unverified"), merged).alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """Two records of each page: its full response at time page_id, and a later 304 that names the page's own entity tag.

    Whether the latest response by then is still that page is for the join to find.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    size = F.length(F.coalesce("html", F.lit(""))).cast("string")
    full = pages.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("type"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), size, F.lit("ETag"), tag, F.lit("Age"), F.lit("0")).alias("headers"))
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") + 1 + F.length(F.coalesce("url", F.lit(""))) * 37 % 500).alias("ts"), F.lit("revisit").alias("type"), F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Age"), F.lit("60"), F.lit("Set-Cookie"), F.lit("a=b")).alias("headers"))
    return full.unionByName(again)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    return out.select("record_id", "canonical_url", "ts", "target_id", "target_ts", "verdict", *[F.col("headers")[h].alias(c) for h, c in (("etag", "etag"), ("age", "age"), ("content-length", "content_length"), ("set-cookie", "set_cookie"))])


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS u, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
q AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)([^?]*)\??(.*)$', 1)), '^[^@]*@', ''), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(bare, '^([^/?]*)([^?]*)\??(.*)$', 2), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '^([^/?]*)([^?]*)\??(.*)$', 3), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(fbclid|gclid|phpsessid|ref|sessionid|utm_campaign|utm_content|utm_medium|utm_source|utm_term)(=.*)?$'))) AS ps
  FROM p),
c AS (
  SELECT page_id, html, length(u) AS lu, '"' || md5(html) || '"' AS tag, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS canonical_url FROM q),
v AS (SELECT page_id * 2 + 1 AS record_id, canonical_url, page_id + 1 + lu * 37 % 500 AS ts, tag FROM c),
j AS (
  SELECT v.*, c.page_id AS target_ts, c.tag AS target_tag, length(c.html) AS size,
    row_number() OVER (PARTITION BY v.record_id ORDER BY c.page_id DESC) AS rn
  FROM v JOIN c ON c.canonical_url = v.canonical_url AND (c.page_id < v.ts OR c.page_id = v.ts AND c.page_id * 2 < v.record_id))
SELECT v.record_id, v.canonical_url, v.ts, target_ts * 2 AS target_id, target_ts,
  CASE WHEN target_ts IS NULL THEN 'orphan' WHEN v.tag = target_tag THEN 'resolved' ELSE 'mismatch' END AS verdict,
  CASE WHEN v.tag = target_tag THEN 'W/' || v.tag END AS etag, CASE WHEN v.tag = target_tag THEN '60' END AS age,
  CASE WHEN v.tag = target_tag THEN CAST(size AS VARCHAR) END AS content_length, CAST(NULL AS VARCHAR) AS set_cookie
FROM v LEFT JOIN j ON j.record_id = v.record_id AND rn = 1
"""
