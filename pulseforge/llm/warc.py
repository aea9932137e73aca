"""Resolution of WARC not-modified revisits.

A revisit without a body is joined as of its time with the latest earlier full response of the same canonical URL. Its
validators (entity tag, last-modified time) are checked against that response, and the headers that a 304 answer may
renew are merged over the stored ones. The join is split by time: inside a (URL, time slice) a window finds the latest
response, and where the slice has none before the revisit, the last response of the slices before is carried over. So
no task gets more rows of one URL than a slice has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseforge.llm import common

#: Units of time of a slice; times are integers (such as seconds).
SLICE = 4096

# Query parameters that only track visits, and headers that a 304 answer may renew.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"
RENEWED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no www, port 80 or 443, fragment, tracking parameters, or slash at the end; http and https are one. Null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "(?i)^https?://(www\\.)?", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(host, ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^({TRACKING})(=|$)")))
    return F.concat(F.lit("http://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def resolve(records: DataFrame, slice_: int = SLICE) -> DataFrame:
    """Every revisit of records with its source.

    records: record_id, url, time (long), kind (`response` or `revisit`), headers (map of lower-case names), digest,
    length. Returns record_id, canonical_url, time, source_id, status, headers, digest, length. status is `resolved`;
    `mismatch` if a validator that both have differs (no body is taken then); `unverified` if no validator is in both
    (the body is taken); or `missing` if there is no earlier response, or the URL or time is null. A response at the
    revisit's own time isn't earlier. Of responses at one time the one of the largest record_id counts. Other columns are
    ignored; repeated rows stay.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("key"), F.col("time").cast("long").alias("time"), "kind", "headers", "digest", F.col("length").cast("long").alias("length"))
    rows = rows.withColumn("slice", F.floor(F.col("time") / slice_).cast("long"))
    source = F.when(F.col("kind") == "response", F.struct("time", "record_id", "headers", "digest", "length"))
    rows = rows.withColumn("own", source)
    lost = rows.where("kind = 'revisit' and (key is null or time is null)")
    rows = rows.where("key is not null and time is not null")
    in_slice = Window.partitionBy("key", "slice").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("near", F.max(F.struct(F.col("own.time").alias("t"), F.col("own.record_id").alias("r"))).over(in_slice))
    near = F.when(F.col("near.t").isNotNull(), F.col("near"))
    asked = here.where("kind = 'revisit'").withColumn("near", near)
    ends = rows.where("kind = 'response'").groupBy("key", "slice").agg(F.max(F.struct(F.col("time").alias("t"), F.col("record_id").alias("r"))).alias("last"))
    wanted = asked.where("near is null").select("key", "slice").distinct().withColumn("last", F.lit(None).cast(ends.schema["last"].dataType))
    before = Window.partitionBy("key").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.unionByName(wanted).withColumn("far", F.last("last", ignorenulls=True).over(before)).where("last is null").select("key", "slice", "far")
    asked = asked.join(carried, ["key", "slice"], "left").withColumn("src", F.coalesce("near", "far")).drop("near", "far")
    full = rows.where("kind = 'response'").select("key", F.col("time").alias("t"), F.col("record_id").alias("r"), F.col("own").alias("found")).dropDuplicates(["key", "t", "r"])
    asked = asked.withColumns({"t": F.col("src.t"), "r": F.col("src.r")})
    out = asked.join(full, ["key", "t", "r"], "left")
    out = out.unionByName(lost.withColumn("found", F.lit(None).cast(out.schema["found"].dataType)), allowMissingColumns=True)
    mine, theirs = F.coalesce("headers", F.create_map().cast("map<string,string>")), F.coalesce("found.headers", F.create_map().cast("map<string,string>"))
    weak = lambda m: F.regexp_replace(m["etag"], "^W/", "")
    tags = F.when(weak(mine).isNotNull() & weak(theirs).isNotNull(), weak(mine) == weak(theirs))
    dates = F.when(mine["last-modified"].isNotNull() & theirs["last-modified"].isNotNull(), mine["last-modified"] == theirs["last-modified"])
    same = F.coalesce(tags, dates)  # an entity tag outranks a date
    status = F.when(F.col("found").isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    fresh = F.map_filter(mine, lambda k, v: k.isin(RENEWED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    ok = F.col("status").isin("resolved", "unverified")
    return out.withColumn("status", status).select(
        "record_id",
        F.col("key").alias("canonical_url"),
        "time",
        F.col("found.record_id").alias("source_id"),
        "status",
        F.when(ok, merged).otherwise(mine).alias("headers"),
        F.when(ok, F.col("found.digest")).alias("digest"),
        F.when(ok, F.col("found.length")).alias("length"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """pages as a crawl: a full response at ten times page_id, and five later a revisit of another spelling of its URL.

    Every seventh page was not stored (its revisit finds nothing or an older capture), every fifth revisit has an
    outdated entity tag, and every eleventh has only a date.
    """
    digest, n = F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.col("page_id")
    date = F.concat(F.lit("day "), F.floor(n / 100).cast("string"))
    headers = F.create_map(F.lit("etag"), F.concat(F.lit('"'), digest, F.lit('"')), F.lit("last-modified"), date, F.lit("content-type"), F.lit("text/html"), F.lit("date"), (n * 10).cast("string"))
    tag = F.when(n % 5 == 0, F.lit('"old"')).otherwise(F.concat(F.lit('W/"'), digest, F.lit('"')))
    renewed = F.when(n % 11 == 0, F.create_map(F.lit("last-modified"), date, F.lit("date"), (n * 10 + 5).cast("string"))).otherwise(
        F.create_map(F.lit("etag"), tag, F.lit("date"), (n * 10 + 5).cast("string"), F.lit("content-type"), F.lit("none"))
    )
    spelled = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), F.lit("&utm_medium=again#x")).otherwise(F.lit("?utm_medium=again#x")))
    size = F.length(F.coalesce("html", F.lit(""))).cast("long")
    first = F.struct((n * 2).alias("record_id"), F.col("url").alias("url"), (n * 10).alias("time"), F.lit("response").alias("kind"), headers.alias("headers"), digest.alias("digest"), size.alias("length"))
    again = F.struct((n * 2 + 1).alias("record_id"), spelled.alias("url"), (n * 10 + 5).alias("time"), F.lit("revisit").alias("kind"), renewed.alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("length"))
    return pages.select(F.explode(F.when(n % 7 == 0, F.array(again)).otherwise(F.array(first, again))).alias("x")).select("x.*")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution of all revisits of the crawl that pages stands for."""
    out = resolve(captures(common.table(spark, sf_dir, "pages")))
    told = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return out.select("record_id", F.floor(F.col("record_id") / 2).cast("long").alias("page_id"), "canonical_url", F.floor(F.col("source_id") / 2).cast("long").alias("source_page_id"), "status", told.alias("headers"), "digest", "length")


OP10_SQL = """
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, CAST(length(coalesce(html, '')) AS BIGINT) AS length,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://(www\\.)?', '', 'i') AS bare
  FROM pages
), c AS (
  SELECT *, 'http://' || regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), ':(80|443)$', '')
         || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS head,
         list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)', 'i'))) AS kept
  FROM p
), k AS (
  SELECT page_id, digest, length, head || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url FROM c
), j AS (
  SELECT v.page_id, v.canonical_url, s.page_id AS source_page_id, s.digest AS sdigest, s.length AS slength, v.digest AS vdigest,
         row_number() OVER (PARTITION BY v.page_id ORDER BY s.page_id DESC NULLS LAST) AS n
  FROM k v LEFT JOIN k s ON s.canonical_url = v.canonical_url AND s.page_id * 10 < v.page_id * 10 + 5 AND s.page_id % 7 <> 0
), r AS (
  SELECT *, CASE WHEN source_page_id IS NULL THEN 'missing'
    WHEN page_id % 11 = 0 THEN CASE WHEN page_id // 100 = source_page_id // 100 THEN 'resolved' ELSE 'mismatch' END
    WHEN page_id % 5 <> 0 AND vdigest = sdigest THEN 'resolved' ELSE 'mismatch' END AS status
  FROM j WHERE n = 1
)
SELECT page_id * 2 + 1 AS record_id, page_id, canonical_url, source_page_id, status,
  CASE WHEN status = 'resolved' THEN 'content-type: text/html; date: ' || (page_id * 10 + 5)
      || CASE WHEN page_id % 11 = 0 THEN '; etag: "' || sdigest || '"' ELSE '; etag: W/"' || vdigest || '"' END
      || '; last-modified: day ' || (CASE WHEN page_id % 11 = 0 THEN page_id ELSE source_page_id END // 100)
    WHEN page_id % 11 = 0 THEN 'date: ' || (page_id * 10 + 5) || '; last-modified: day ' || (page_id // 100)
    ELSE 'content-type: none; date: ' || (page_id * 10 + 5) || '; etag: ' || CASE WHEN page_id % 5 = 0 THEN '"old"' ELSE 'W/"' || vdigest || '"' END END AS headers,
  CASE WHEN status = 'resolved' THEN sdigest END AS digest, CASE WHEN status = 'resolved' THEN slength END AS length
FROM r
"""
