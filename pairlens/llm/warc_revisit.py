"""Not-modified revisits of web captures resolved to the response they confirm.

A revisit record has no payload: the server said that the page is as it was.  It is joined as
of its time to the latest earlier full response of the same canonical URL.  The validators it
sent (entity tag, modification time) must agree with that response; then the response's
headers are merged with those that a not-modified answer may update.

The as-of join is a running "last response" in time order.  A URL may hold a large share of
all captures, so time is cut into slots: the last response of every (URL, slot) is a
map-side aggregate, its running value over the slots of a URL is the carry into each slot, and
the window over single captures runs within a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Header fields that a not-modified answer may replace, and the tracking parameters that are no part of a page's identity.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


def canonical(url: Column) -> Column:
    """Scheme and host in lower case without ``www.`` or ``m.`` and default port; path without trailing slash; query sorted, without tracking parameters; no fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r"^(?:www|m)\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(?:=|$)"))
    query = F.array_join(F.array_sort(pairs), "&")
    plain = F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host == "", F.lower(F.trim(url))).otherwise(plain)


def header_map(block: Column) -> Column:
    """Fields of a header block as a map with names in lower case; the last of equal names counts."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def merged_headers(base: Column, update: Column) -> Column:
    """The response's fields with the permitted ones of the revisit in place of its own, as ``name: value`` lines in order of names."""
    allowed = F.map_filter(update, lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(allowed, k))
    return F.array_join(F.array_sort(F.transform(F.map_entries(F.map_concat(kept, allowed)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def resolve(records: DataFrame, slot_seconds: int = 4096) -> DataFrame:
    """Revisits of ``records`` (``record_id``, ``kind`` 'response' or 'revisit', ``url``, ``ts`` seconds, ``headers`` block).

    Returns ``record_id``, ``url_key``, ``response_id``, ``status`` and ``headers`` (merged, null unless
    resolved).  ``status``: ``resolved``; ``stale`` (a validator differs); ``unverified`` (no validator in
    common); ``missing`` (no earlier response).  Defined cases: "earlier" is strictly before, of responses
    at one time the largest id counts; a null time or URL is missing; null headers are empty; repeated
    revisits each give a row; an empty table gives an empty result; other columns are ignored.
    """
    rows = records.select("record_id", "kind", canonical(F.col("url")).alias("url_key"), "ts", "headers").withColumn("slot", F.floor(F.col("ts") / slot_seconds))
    timed = rows.filter("ts IS NOT NULL AND url_key IS NOT NULL")
    answer = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "headers"))
    carried = timed.filter("kind = 'response'").groupBy("url_key", "slot").agg(F.max(F.struct("ts", "record_id", "headers")).alias("last"))
    asked = timed.filter("kind = 'revisit'").select("url_key", "slot").distinct()
    slots = asked.unionByName(carried.select("url_key", "slot")).distinct().join(carried, ["url_key", "slot"], "left")
    prior = W.partitionBy("url_key").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    carry = slots.withColumn("carry", F.max("last").over(prior)).select("url_key", "slot", "carry")
    within = W.partitionBy("url_key", "slot").orderBy("ts").rangeBetween(W.unboundedPreceding, -1)
    local = timed.withColumn("near", F.max(answer).over(within)).filter("kind = 'revisit'")
    matched = local.join(carry, ["url_key", "slot"]).withColumn("hit", F.coalesce("near", "carry"))
    lost = rows.filter("kind = 'revisit' AND (ts IS NULL OR url_key IS NULL)").withColumn("hit", F.lit(None).cast(matched.schema["hit"].dataType))
    columns = ["record_id", "url_key", "headers", "hit"]
    all_of = matched.select(*columns).unionByName(lost.select(*columns))
    theirs, ours = F.col("base"), F.col("own")
    same = lambda k: theirs[k] == ours[k]
    status = (
        F.when(F.col("hit").isNull(), "missing")
        .when(~F.coalesce(same("etag"), F.lit(True)) | ~F.coalesce(same("last-modified"), F.lit(True)), "stale")
        .when(F.coalesce(same("etag"), F.lit(False)) | F.coalesce(same("last-modified"), F.lit(False)), "resolved")
        .otherwise("unverified")
    )
    parsed = all_of.withColumns({"base": header_map(F.col("hit.headers")), "own": header_map(F.col("headers"))}).withColumn("status", status)
    return parsed.select(
        "record_id", "url_key", F.col("hit.record_id").alias("response_id"), "status",
        F.when(F.col("status") == "resolved", merged_headers(theirs, ours)).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records of a table of pages (``page_id``, ``url``, ``html``).

    Every page is a full response at second 10·page_id with the hash of its content as entity tag, and
    is revisited 7 seconds after a later capture's time: every page sends a revisit at second
    10·page_id + 10007.  Its entity tag is the page's own, so a page that changed in between comes out
    stale; ids divisible by 5 send no entity tag but the modification time, others divisible by 3 send both.
    """
    tag = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    page = F.col("page_id")
    base = pages.select("page_id", "url", tag.alias("tag"), F.coalesce(F.length("html"), F.lit(0)).alias("n"))
    response = base.select(
        (page * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (page * 10).alias("ts"),
        F.concat(F.lit("Content-Type: text/html\nContent-Length: "), F.col("n"), F.lit("\nETag: "), F.col("tag"), F.lit("\nLast-Modified: "), F.floor(page / 1000), F.lit("\nDate: "), page * 10).alias("headers"),
    )
    revisit = base.select(
        (page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", (page * 10 + 10007).alias("ts"),
        F.concat(
            F.lit("Content-Length: 0\nDate: "), page * 10 + 10007, F.lit("\nCache-Control: max-age="), page % 7,
            F.when((page % 5 == 0) | (page % 3 == 0), F.concat(F.lit("\nLast-Modified: "), F.floor(page / 1000))).otherwise(""),
            F.when(page % 5 != 0, F.concat(F.lit("\nETag: "), F.col("tag"))).otherwise(""),
        ).alias("headers"),
    )
    return response.unionByName(revisit)
