"""Resolving not-modified revisits of web archives.

A server that answers "not modified" sends no body; its record is completed
from the latest earlier full response of the same canonical URL.  The revisit
and that response must agree on a validator (the entity tag, compared weakly,
else the last-modified date); headers that a not-modified answer may update are
merged into the response's.

The as-of join is one range partitioning by (URL, time).  Inside a partition
the latest response is carried forward by a window; across partitions only the
last response of each (partition, URL) is carried, so one URL with any share of
the records is spread over many tasks.  Only narrow columns are shuffled:
bodies stay behind and are named by their record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

# Headers of the stored response that a not-modified answer does
# not replace, since they describe the body or the single connection.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-location", "content-range", "content-type",
                "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
# Query parameters that name a referrer, not a resource.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Scheme, a leading www., fragment, tracking parameters and a trailing
    slash dropped; host in lower case; parameters sorted.  Null for a url that
    is null or without ://."""
    rest = F.regexp_extract(url, r"://([^#]*)", 1)
    host = F.regexp_replace(ascii_lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    args = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(f"^{TRACKING}$")))
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(F.size(args) > 0, F.concat(F.lit("?"), F.concat_ws("&", args))).otherwise("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """Records (record_id, url, at, kind, headers) -> the revisits: record_id,
    canonical_url, status, refers_to, headers.

    ``kind`` is ``response`` or ``revisit`` (other kinds take no part), ``at``
    a time, ``headers`` a map with names in lower case.  ``status`` is
    ``resolved``; ``mismatch`` if the latest earlier response differs in a
    validator that both have; ``unverified`` if they share no validator;
    ``no_response`` if there is no earlier one, or the revisit has no canonical
    URL or no time.  Only a resolved revisit names the response and has merged
    headers, the others keep their own.  Earlier is before in time; responses
    of one URL and time count by the highest record_id.  Repeated records give
    repeated rows; null headers are empty; further columns are ignored; an
    empty table gives no rows.
    """
    empty = F.create_map().cast("map<string,string>")
    r = (records.where(F.col("kind").isin("response", "revisit"))
         .select("record_id", canonical_url(F.col("url")).alias("key"), "at", (F.col("kind") == "response").alias("full"),
                 F.coalesce(F.col("headers").cast("map<string,string>"), empty).alias("headers")))
    usable = F.col("key").isNotNull() & F.col("at").isNotNull()
    # a revisit stands before the responses of its own time
    order = ["key", "at", "full", "record_id"]
    response = F.when(F.col("full"), F.struct("record_id", "headers"))
    placed = cut(r.where(usable).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", "key").orderBy("at", "full", "record_id")
    carried = placed.withColumn("seen", F.last(response, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    # the last response of every earlier part that has the URL
    ends = (placed.where("full").groupBy("part", "key")
            .agg(F.max_by(F.struct("record_id", "headers"), F.struct("at", "record_id")).alias("end"))
            .union(placed.groupBy("part", "key").agg(F.lit(None).cast("struct<record_id:string,headers:map<string,string>>").alias("end"))))
    ends = ends.groupBy("part", "key").agg(F.first("end", ignorenulls=True).alias("end"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ends.withColumn("before", F.last("end", ignorenulls=True).over(before))
              .where(F.col("before").isNotNull()).select("part", "key", "before"))
    joined = (carried.where("NOT full").join(starts, ["part", "key"], "left")
              .select("record_id", "key", "headers", F.coalesce("seen", "before").alias("found")))
    lost = r.where(~usable & ~F.col("full")).select("record_id", "key", "headers", F.lit(None).cast("struct<record_id:string,headers:map<string,string>>").alias("found"))
    theirs = F.col("found.headers")
    mine = F.col("headers")
    tags = (_weak(F.element_at(mine, "etag")), _weak(F.element_at(theirs, "etag")))
    dates = (F.element_at(mine, "last-modified"), F.element_at(theirs, "last-modified"))
    same = F.when(tags[0].isNotNull() & tags[1].isNotNull(), tags[0] == tags[1]).when(
        dates[0].isNotNull() & dates[1].isNotNull(), dates[0] == dates[1])
    status = (F.when(F.col("found").isNull(), "no_response").when(same.isNull(), "unverified")
              .when(same, "resolved").otherwise("mismatch"))
    update = F.map_filter(mine, lambda k, v: ~k.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(update, k)), update)
    ok = F.col("status") == "resolved"
    return (joined.union(lost).withColumn("status", status)
            .select("record_id", F.col("key").alias("canonical_url"), "status",
                    F.when(ok, F.col("found.record_id")).alias("refers_to"), F.when(ok, merged).otherwise(mine).alias("headers")))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl of the pages, derived row by row: each page is a full response
    at minute 2 * page_id, tagged by its body, and is asked for again at a later
    time, with another scheme and fragment.  Pages whose number leaves 1 by 7
    had changed meanwhile, those that leave 2 are asked before, by 8 without
    validators."""
    n = F.col("page_id")
    tag = F.md5(F.coalesce("html", F.lit("")))
    day = F.concat(F.lit("day "), F.floor(n / 100).cast("string"))
    date = F.concat(F.lit("minute "), (n * 2).cast("string"))
    full = pages.select(
        F.concat(F.lit("r"), n.cast("string")).alias("record_id"), "url", (n * 2).alias("at"), F.lit("response").alias("kind"),
        F.create_map(F.lit("etag"), F.concat(F.lit('"'), tag, F.lit('"')), F.lit("last-modified"), day, F.lit("date"), date,
                     F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string")).alias("headers"))
    old = F.when(n % 7 == 1, F.lit('"changed"')).otherwise(F.concat(F.lit('W/"'), tag, F.lit('"')))
    later = F.when(n % 7 == 2, n * 2 - 1).otherwise(n * 2 + 1001)
    again = pages.select(
        F.concat(F.lit("v"), n.cast("string")).alias("record_id"),
        F.concat(F.regexp_replace(F.regexp_replace("url", "^https?:", "HTTP:"), "#.*$", ""), F.lit("#again")).alias("url"),
        later.alias("at"), F.lit("revisit").alias("kind"),
        F.when(n % 8 == 0, F.create_map(F.lit("date"), F.concat(F.lit("minute "), later.cast("string"))))
        .otherwise(F.create_map(F.lit("etag"), old, F.lit("date"), F.concat(F.lit("minute "), later.cast("string")),
                                F.lit("content-length"), F.lit("0"))).alias("headers"))
    return full.union(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(captures(table(spark, sf_dir, "pages")))
    listed = F.concat_ws("; ", F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return out.select(F.substring("record_id", 2, 30).cast("long").alias("page_id"), "canonical_url", "status", "refers_to", listed.alias("headers"))


_ARGS = r"""list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_full_match(x, '(?:utm_[a-z]+|gclid|fbclid|ref)=[^&]*')))"""
ORACLE = rf"""
WITH b AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_extract(url, '://([^#]*)', 1) AS rest FROM pages),
k AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(translate(regexp_extract(rest, '^([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', '')
   || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN len({_ARGS}) > 0 THEN '?' || array_to_string({_ARGS}, '&') ELSE '' END END AS key FROM b),
f AS (SELECT key, 2 * page_id AS ts, 'r' || page_id AS rid, '"' || md5(html) || '"' AS etag, 'day ' || floor(page_id / 100)::BIGINT AS lm, length(html)::VARCHAR AS n FROM k WHERE key IS NOT NULL AND page_id IS NOT NULL),
v AS (SELECT page_id, key, CASE WHEN page_id % 7 = 2 THEN 2 * page_id - 1 ELSE 2 * page_id + 1001 END AS ts, md5(html) AS tag FROM k),
j AS (SELECT v.*, f.rid, f.etag, f.lm, f.n, row_number() OVER (PARTITION BY v.page_id ORDER BY f.ts DESC, f.rid DESC) AS nth FROM v LEFT JOIN f ON f.key = v.key AND f.ts < v.ts),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_response' WHEN page_id % 8 = 0 THEN 'unverified'
  WHEN page_id % 7 <> 1 AND etag = '"' || tag || '"' THEN 'resolved' ELSE 'mismatch' END AS status FROM j WHERE nth = 1)
SELECT page_id, key AS canonical_url, status, CASE WHEN status = 'resolved' THEN rid END AS refers_to,
  CASE WHEN status = 'resolved' THEN 'content-length=' || n || '; date=minute ' || ts || '; etag=W/"' || tag || '"; last-modified=' || lm
    WHEN page_id % 8 = 0 THEN 'date=minute ' || ts
    ELSE 'content-length=0; date=minute ' || ts || '; etag=' || CASE WHEN page_id % 7 = 1 THEN '"changed"' ELSE 'W/"' || tag || '"' END END AS headers
FROM s
"""
