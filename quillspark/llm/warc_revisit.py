"""Operator 5: resolution of not-modified revisits in web archives.

A revisit (a 304 answer stored without a body) takes its body from the latest earlier full response of the same
canonical url. Responses and times are first brought to one row for each (url, time); the as-of join runs over these inside (url,
time bucket): each bucket's last full response is carried forward over the buckets of its url, one narrow row each, and a frame
of the rows before finds the latest one inside the bucket. The revisits, however many share a url and a time, are then joined to
their time's answer in pieces. So no task holds all records of a url or time that holds a large part of the table, and bodies
don't move.

Validators: if both sides have an ETag, the revisit's must be the response's (weak comparison: a leading W/ is ignored);
else, if both have a Last-Modified, these must be equal; with neither there is nothing to hold against the response.
The merged headers are those of the response, overwritten by those of the revisit but for the ones a 304 may not change.

Header names are compared in lower case, as archives write them in any; of names that are then equal the last counts.

Defined results: one row for each revisit. status is `resolved`, `validator_mismatch` (refers_to is set, no body) or
`no_response`. A null url, time or record type: the record is neither a response nor resolved (`no_response`). Of
responses at one time the largest record id counts; a response at the time of the revisit is not earlier. Repeated rows
give repeated results. Null header maps count as empty. Headers of any length pass; bodies are not read. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import CELL_ROWS, checkpointed, dealt_join

#: Header fields that a not-modified answer may not change.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


#: Parameters that only track: these names, and all that start with TRACKS.
TRACKING, TRACKS = ("ref", "sessionid"), "utm_"


def canonical(url: Column) -> Column:
    """Without scheme, fragment, user part, default port, `www.`, tracking and empty parameters, and, where no parameter is left, slashes at the
    end; host in lower case. Parameters are whole parts between `&` behind the first `?`, compared by their exact name; the path is not searched."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, "^[^/?]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    host = F.regexp_replace(F.regexp_replace(F.lower(host), "^.*@|:(80|443)$", ""), r"^www\.", "")
    path, query = F.substring_index(tail, "?", 1), F.regexp_extract(tail, r"(?s)\?(.*)$", 1)
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).isin(*TRACKING) & ~name(p).startswith(TRACKS))
    return F.concat(host, F.when(F.size(kept) > 0, F.concat(path, F.lit("?"), F.array_join(kept, "&"))).otherwise(F.regexp_replace(path, "/+$", "")))


def lower_names(headers: Column) -> Column:
    """Header maps with names in lower case; the last of equal names counts."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == k), -1)["value"]))


def resolve(records: DataFrame, buckets: int | None = None) -> DataFrame:
    """records: record_id, url string, ts long, record_type string (`response` or `revisit`), headers map<string,string>,
    body_length long, body_digest string. buckets: of time; by default one for each 50,000 records, 64 at least."""
    typed = records.select("record_id", canonical(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), "record_type", lower_names(F.col("headers")).alias("headers"), "body_length", "body_digest")
    typed = typed.where("record_type = 'response' or record_type = 'revisit'")
    spread = records.agg(F.min(F.col("ts").cast("long")).alias("low"), F.max(F.col("ts").cast("long")).alias("high"), F.count("*").alias("n")).first()
    low, n = spread.low or 0, spread.n
    width = max(1, ((spread.high or 0) - low) // (buckets or max(64, n // CELL_ROWS)) + 1)
    full = F.when((F.col("record_type") == "response") & F.col("canonical_url").isNotNull() & F.col("ts").isNotNull(), F.struct("ts", "record_id", F.col("headers").getItem("etag").alias("etag"), F.col("headers").getItem("last-modified").alias("modified"), F.to_json("headers").alias("headers"), "body_length", "body_digest"))
    seen = F.count_if(F.col("record_type") == "revisit").alias("revisits")
    times = checkpointed(typed.where("canonical_url is not null and ts is not null").groupBy("canonical_url", "ts").agg(F.max(full).alias("full"), seen))
    times = times.withColumn("bucket", F.floor((F.col("ts") - F.lit(low)) / width))
    held = times.groupBy("canonical_url", "bucket").agg(F.max("full").alias("own"))
    earlier = F.max("own").over(W.partitionBy("canonical_url").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    held = held.select("canonical_url", "bucket", earlier.alias("carried"))
    inside = F.max("full").over(W.partitionBy("canonical_url", "bucket").orderBy("ts").rowsBetween(W.unboundedPreceding, -1))
    answers = times.withColumn("inside", inside).where("revisits > 0").join(held, ["canonical_url", "bucket"], "left")
    answers = checkpointed(answers.select("canonical_url", "ts", "revisits", F.coalesce("inside", "carried").alias("r")))
    revisits = typed.where("record_type = 'revisit'")
    found = dealt_join(revisits, answers, ["canonical_url", "ts"], "revisits", n)
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    etag, modified = F.col("headers").getItem("etag"), F.col("headers").getItem("last-modified")
    same = F.when(etag.isNotNull() & F.col("r.etag").isNotNull(), strong(etag) == strong(F.col("r.etag"))).when(modified.isNotNull() & F.col("r.modified").isNotNull(), modified == F.col("r.modified")).otherwise(F.lit(True))
    status = F.when(F.col("r").isNull(), "no_response").when(same, "resolved").otherwise("validator_mismatch")
    allowed = F.map_filter("headers", lambda k, v: ~k.isin(*NOT_MERGED))
    stored = F.from_json("r.headers", "map<string,string>")
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.coalesce(F.map_contains_key(allowed, k), F.lit(False))), allowed)
    ok = F.col("status") == "resolved"
    return found.withColumn("status", status).select("record_id", "canonical_url", "ts", "status", F.col("r.record_id").alias("refers_to"), F.when(ok, merged).alias("headers"), F.when(ok, F.col("r.body_length")).alias("body_length"), F.when(ok, F.col("r.body_digest")).alias("body_digest"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl of the pages table: each page is fetched in full at time 10 page_id, revisited with its ETag at 10 page_id + 13
    and with Last-Modified alone at 10 page_id + 27. Every fifth page has changed its ETag, every seventh its date."""
    page = F.col("page_id")
    digest, length = F.md5(F.coalesce("html", F.lit(""))), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    date = F.concat(F.lit("day "), (page % 28).cast("string"))
    text = lambda *x: F.create_map(*[F.lit(v) if isinstance(v, str) else v for v in x])
    no = F.lit(None)

    def one(k: int, after: int, kind: str, headers: Column, size: Column, sha: Column) -> Column:
        return F.struct((page * 3 + k).alias("record_id"), F.col("url").alias("url"), (page * 10 + after).alias("ts"), F.lit(kind).alias("record_type"), headers.alias("headers"), size.cast("long").alias("body_length"), sha.cast("string").alias("body_digest"))

    full = text("content-type", "text/html", "content-length", length.cast("string"), "etag", digest, "last-modified", date, "cache-control", "max-age=60")
    tagged = text("content-length", "0", "etag", F.when(page % 5 == 0, F.lit("changed")).otherwise(F.concat(F.lit("W/"), digest)), "cache-control", "max-age=600")
    dated = text("last-modified", F.when(page % 7 == 0, F.lit("later")).otherwise(date), "expires", "never")
    return pages.select(F.explode(F.array(one(0, 0, "response", full, length, digest), one(1, 13, "revisit", tagged, no, no), one(2, 27, "revisit", dated, no, no))).alias("r")).select("r.*")


def query(spark, sf_dir: str) -> DataFrame:
    out = resolve(records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    head = lambda k, name: F.col("headers").getItem(k).alias(name)
    return out.select("record_id", "canonical_url", "ts", "status", "refers_to", head("etag", "etag"), head("content-type", "content_type"), head("content-length", "content_length"), head("cache-control", "cache_control"), head("expires", "expires"), head("last-modified", "last_modified"), "body_length", "body_digest")


ORACLE_SQL = r"""
WITH c AS (
  SELECT page_id, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
u AS (
  SELECT page_id, html, regexp_extract(rest, '^[^/?]*') AS host, string_split(substr(rest, length(regexp_extract(rest, '^[^/?]*')) + 1), '?') AS parts FROM c),
q AS (
  SELECT page_id, html, regexp_replace(regexp_replace(lower(host), '^.*@|:(80|443)$', '', 'g'), '^www\.', '') AS host, parts[1] AS path,
         list_filter(string_split(array_to_string(parts[2:], '?'), '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN ('ref', 'sessionid') AND string_split(p, '=')[1][1:4] <> 'utm_') AS kept FROM u),
k AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest, coalesce(strlen(html), 0) AS len, 'day ' || (page_id % 28)::VARCHAR AS day,
         host || CASE WHEN len(kept) > 0 THEN path || '?' || array_to_string(kept, '&') ELSE rtrim(path, '/') END AS u
  FROM q),
f AS (SELECT u, page_id * 10 AS ts, page_id * 3 AS record_id, digest, day, len FROM k),
v AS (
  SELECT u, page_id * 10 + 13 AS ts, page_id * 3 + 1 AS record_id, CASE WHEN page_id % 5 = 0 THEN 'changed' ELSE 'W/' || digest END AS etag, NULL AS day FROM k
  UNION ALL SELECT u, page_id * 10 + 27, page_id * 3 + 2, NULL, CASE WHEN page_id % 7 = 0 THEN 'later' ELSE day END FROM k),
j AS (SELECT v.*, f.record_id AS refers_to, f.digest AS fdigest, f.day AS fday, f.len AS flen FROM v ASOF LEFT JOIN f ON v.u = f.u AND v.ts > f.ts),
s AS (SELECT *, CASE WHEN refers_to IS NULL THEN 'no_response'
                     WHEN CASE WHEN etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = fdigest ELSE day = fday END THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM j)
SELECT record_id, u AS canonical_url, ts, status, refers_to,
  CASE WHEN status = 'resolved' THEN coalesce(etag, fdigest) END AS etag, CASE WHEN status = 'resolved' THEN 'text/html' END AS content_type,
  CASE WHEN status = 'resolved' THEN flen::VARCHAR END AS content_length,
  CASE WHEN status = 'resolved' THEN CASE WHEN etag IS NOT NULL THEN 'max-age=600' ELSE 'max-age=60' END END AS cache_control,
  CASE WHEN status = 'resolved' AND etag IS NULL THEN 'never' END AS expires, CASE WHEN status = 'resolved' THEN fday END AS last_modified,
  CASE WHEN status = 'resolved' THEN flen END AS body_length, CASE WHEN status = 'resolved' THEN fdigest END AS body_digest
FROM s
"""
