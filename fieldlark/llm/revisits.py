"""Resolution of WARC revisit records that say "not modified".

A revisit has no payload.  It is joined as of its time with the latest earlier full
response of its canonical URL; when the validators agree (entity tags if both have
one, else the last-modified dates) it takes that response's payload, and the
response's headers updated by those the revisit may change.

The as-of join first reduces the records to one row for each URL and time, so that any number of
records at one time costs one row.  These rows are cut into time chunks at quantiles of the
records' times, so a chunk has its share of the records however odd the times are: within a chunk of a
URL a window finds the latest response, across chunks a window over one row for each chunk.  A URL
with a third of all records is thus spread over all chunks, and its summary is ``CHUNKS`` rows, or as many as
there are ``CHUNK_ROWS`` records, but ``MOST_CHUNKS`` at most.  Payloads are never moved, only their digests and lengths.

Defined cases: a revisit without an earlier response, with a null URL or time is an
orphan; a response at the same time is not earlier; of several latest responses the
largest id counts; records that repeat are resolved each; null validators on both
sides can't agree; an empty table gives no rows; URLs of any length are compared whole; extra columns of the records are
kept in ``stored``, but for one named ``stored``, which is replaced, and ``resolve`` does not look at them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .url_filter import host_and_path

CHUNKS = 64
CHUNK_ROWS = 100_000
MOST_CHUNKS = 10_000
#: Headers that a response with status 304 may carry to update a stored one (fixed values, RFC 9110).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
HEADERS = "array<struct<name:string,value:string>>"


def canonical(url: str | Column) -> Column:
    """Host in lower case without ``www.``, and path without a final slash."""
    host, path = host_and_path(url)
    whole = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/$", ""))
    return F.when(whole != "", whole)


def latest_earlier(records: DataFrame, chunks: int | None = None) -> DataFrame:
    """``records`` with ``stored``: the latest response with the same ``target`` and a smaller ``ts``, or null.

    Columns: id, target, ts (long), full (boolean), and any others; those of the
    response are in the struct ``stored``.
    """
    records = records.drop("stored")
    there = F.col("target").isNotNull() & F.col("ts").isNotNull()
    known = records.where(there)
    chunks = chunks or min(MOST_CHUNKS, max(CHUNKS, known.count() // CHUNK_ROWS))
    shares = [i / chunks for i in range(1, chunks)]
    points = sorted(set(known.agg(F.percentile_approx("ts", shares, 10 * MOST_CHUNKS)).first()[0] or [])) if shares else []
    fields = [c for c in records.columns if c not in ("target", "ts", "id", "full")]
    spots = known.groupBy("target", "ts").agg(F.max(F.when(F.col("full"), F.struct("ts", "id", *fields))).alias("__own"))
    spots = spots.withColumn("__chunk", _chunk(F.col("ts"), points))
    last = spots.groupBy("target", "__chunk").agg(F.max("__own").alias("__last"))
    before = Window.partitionBy("target").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("target", "__chunk", F.max("__last").over(before).alias("__carried"))
    inside = Window.partitionBy("target", "__chunk").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    found = spots.withColumn("__inside", F.max("__own").over(inside)).join(carried, ["target", "__chunk"])
    found = found.select(F.col("target").alias("__target"), F.col("ts").alias("__ts"), F.coalesce("__inside", "__carried").alias("stored"))
    joined = known.join(found, (F.col("target") == F.col("__target")) & (F.col("ts") == F.col("__ts"))).select(*records.columns, "stored")
    # null keys take no part in the join, where they would all meet in one task
    return joined.union(records.where(~there).select("*", F.lit(None).cast(joined.schema["stored"].dataType).alias("stored")))


def _chunk(ts: Column, points: list[int]) -> Column:
    """How many of the sorted ``points`` are less than ``ts``, found in two steps of a square root of their number."""
    if not points:
        return F.lit(0)
    width = max(1, int(len(points) ** 0.5))
    every = F.lit(points).cast("array<long>")
    coarse = F.lit(points[width - 1 :: width]).cast("array<long>")
    first = F.size(F.filter(coarse, lambda p: p < ts)) * width
    return first + F.size(F.filter(F.slice(every, first + 1, width), lambda p: p < ts))


def merged(stored: Column, sent: Column) -> Column:
    """Stored headers, each replaced by the revisit's where that is permitted, by name."""
    update = F.filter(sent, lambda h: h["name"].isin(*PERMITTED) & h["value"].isNotNull())
    names = F.transform(update, lambda h: h["name"])
    return F.array_sort(F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["name"]) & h["value"].isNotNull()), update))


def resolve(records: DataFrame, chunks: int | None = None) -> DataFrame:
    """id, target, ts, status, response_id, payload_digest, payload_length, headers for each record.

    ``records``: id, target, ts, full, etag, last_modified, headers, payload_digest, payload_length.
    status: response, resolved, mismatch (the validators differ) or orphan.
    """
    columns = ("id", "target", "ts", "full", "etag", "last_modified", "headers", "payload_digest", "payload_length")
    r = latest_earlier(records.select(*columns), chunks)
    tags = F.col("etag").isNotNull() & F.col("stored.etag").isNotNull()
    agree = F.when(tags, F.col("etag") == F.col("stored.etag")).otherwise(F.coalesce(F.col("last_modified") == F.col("stored.last_modified"), F.lit(False)))
    status = F.when(F.col("full"), "response").when(F.col("stored").isNull(), "orphan").when(agree, "resolved").otherwise("mismatch")
    r = r.withColumn("status", status)
    done, full = F.col("status") == "resolved", F.col("full")
    return r.select(
        "id", "target", "ts", "status",
        F.when(full, F.col("id")).when(F.col("status") != "orphan", F.col("stored.id")).alias("response_id"),
        F.when(full, F.col("payload_digest")).when(done, F.col("stored.payload_digest")).alias("payload_digest"),
        F.when(full, F.col("payload_length")).when(done, F.col("stored.payload_length")).alias("payload_length"),
        F.when(done, merged(F.col("stored.headers"), F.col("headers"))).otherwise(F.array_sort("headers")).alias("headers"),
    )


def header_lines(headers: Column) -> Column:
    return F.array_join(F.transform(headers, lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """A capture log made from raw pages, which have no headers of their own.

    Each page is a capture of its canonical URL at the time page_id.  By the MD5 of the URL and the
    time a quarter are full responses, the rest revisits, and a part carries no entity tag.  A page's content
    changes every 5,000 ticks, which its validators show.
    """
    mark = F.md5(F.concat_ws(" ", "url", F.col("page_id").cast("string")))
    epoch = F.floor(F.col("page_id") / 5000).cast("string")
    target = canonical("url")
    full = F.coalesce(F.substring(mark, 1, 1).isin("0", "1", "2", "3"), F.lit(False))
    etag = F.when(~F.substring(mark, 2, 1).isin("0", "1", "2"), F.concat(F.lit('"'), F.substring(F.md5(F.concat_ws(":", target, epoch)), 1, 12), F.lit('"')))
    header = [("etag", etag), ("last-modified", epoch), ("date", F.col("page_id").cast("string")), ("content-type", F.when(full, F.lit("text/html"))), ("set-cookie", F.when(~full, F.substring(mark, 1, 6)))]
    headers = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in header)), lambda h: h["value"].isNotNull())
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col("page_id").alias("id"), target.alias("target"), F.col("page_id").alias("ts"), full.alias("full"), etag.alias("etag"), epoch.alias("last_modified"),
        headers.alias("headers"), F.when(full, F.md5(html)).alias("payload_digest"), F.when(full, F.octet_length(html).cast("long")).alias("payload_length"),
    )
