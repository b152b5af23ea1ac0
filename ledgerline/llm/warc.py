"""Not-modified revisit records resolved to the responses they stand for.

A revisit takes the latest earlier full response of its canonical URL, if their
validators agree: the body of that response, and its headers with those that a
304 may renew replaced by the revisit's.

The as-of join orders (URL, time, record) by range, so a URL with a third of all
captures spreads over many blocks.  Inside a block a window carries the last
response forward; between blocks, one row per (URL, block) does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.session import cut, task_count

#: Headers that a 304 response renews (RFC 9110, section 15.4.5),
#: and query parameters that do not name a resource.
RENEWED_HEADERS = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"
ROWS_PER_BLOCK = 1_000_000


def canonical_url(url: Column) -> Column:
    """Host, path and query that name a resource; null for null or blank.

    Scheme, user's ``www.``, default ports, fragment, tracking parameters and
    trailing slashes go; the host is lower case, parameters are sorted.
    """
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    given = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    whole = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.trim(url) != "", whole)


def _validator(tag: Column) -> Column:
    """Entity tags compare weakly: W/ does not count."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per record, with what each revisit stands for.

    ``records`` has record_id, url, captured_at (any ordered type), kind
    ("response" or "revisit"), status, etag, last_modified, headers (a map with
    lower-case names) and payload; other columns are ignored.  Returns record_id,
    canonical_url, kind, refers_to, resolution, status, headers and payload.

    ``resolution`` is "full" for a response of status 200, "other" for records
    that are neither that nor a revisit; for revisits "resolved", "unverified"
    (no validator that both sides have), "mismatch" (validators differ) or
    "no response" (none earlier, or no URL or time).  Entity tags decide if both
    sides have one, modification dates otherwise.  The first two take over the
    response's status, headers and payload.  Records captured at the same time
    are in order of their ids, nulls first; equal rows are resolved each.  A null
    url or time resolves nothing and answers nothing.  An empty table gives an
    empty result.
    """
    spark = records.sparkSession
    slim = records.select(
        "record_id", canonical_url(F.col("url")).alias("u"), F.col("captured_at").alias("at"), "kind", "status", "etag", "last_modified"
    )
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    answer = F.when(full, F.struct("record_id", F.col("etag").alias("tag"), F.col("last_modified").alias("modified")))
    placed = slim.filter(F.col("u").isNotNull() & F.col("at").isNotNull() & (full | (F.col("kind") == "revisit"))).withColumn("answer", answer)
    blocks = task_count(spark, placed.count(), ROWS_PER_BLOCK)
    dealt = placed.repartitionByRange(blocks, "u", "at", "record_id").withColumn("block", F.spark_partition_id())
    dealt = cut(dealt, "captures")
    inside = Window.partitionBy("u", "block").orderBy(F.col("at"), F.col("record_id").asc_nulls_first())
    dealt = dealt.withColumn("last", F.last("answer", True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    ends = dealt.groupBy("u", "block").agg(F.max_by("answer", F.when(full, F.struct("at", F.coalesce("record_id", F.lit(-(1 << 63)))))).alias("end"))
    before = Window.partitionBy("u").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("u").alias("_u"), F.col("block").alias("_b"), F.last("end", True).over(before).alias("earlier"))
    revisits = dealt.filter("kind = 'revisit'").join(ends, (F.col("u") == F.col("_u")) & (F.col("block") == F.col("_b")))
    found = F.coalesce("last", "earlier")
    revisits = revisits.withColumn("found", found)
    tags, dates = F.col("etag").isNotNull() & F.col("found.tag").isNotNull(), F.col("last_modified").isNotNull() & F.col("found.modified").isNotNull()
    same = F.when(tags, _validator(F.col("etag")) == _validator(F.col("found.tag"))).when(dates, F.col("last_modified") == F.col("found.modified"))
    resolution = (
        F.when(F.col("found").isNull(), "no response").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    )
    # Revisits that are equal in id, URL and time are equal in what they find,
    # but for their validators.
    facts = revisits.select(
        F.col("record_id").alias("_r"), F.col("u").alias("_u"), F.col("at").alias("_at"), F.col("etag").alias("_e"), F.col("last_modified").alias("_m"),
        F.col("found.record_id").alias("found_id"), resolution.alias("outcome"),
    ).dropDuplicates(["_r", "_u", "_at", "_e", "_m"])

    whole = records.select("record_id", "url", "captured_at", "kind", "status", "etag", "last_modified", "headers", "payload")
    whole = whole.withColumn("canonical_url", canonical_url(F.col("url")))
    is_revisit = F.col("kind") == "revisit"
    plain = whole.filter(~F.coalesce(is_revisit, F.lit(False))).select(
        "record_id", "canonical_url", "kind", F.lit(None).cast(records.schema["record_id"].dataType).alias("refers_to"),
        F.when(F.coalesce(full, F.lit(False)), "full").otherwise("other").alias("resolution"), "status", "headers", "payload",
    )
    pairs = [("record_id", "_r"), ("canonical_url", "_u"), ("captured_at", "_at"), ("etag", "_e"), ("last_modified", "_m")]
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & F.col(a).eqNullSafe(F.col(b))
    asked = whole.filter(is_revisit).join(facts, condition, "left").withColumn("resolution", F.coalesce("outcome", F.lit("no response")))
    asked = asked.withColumn("refers_to", F.when(F.col("resolution").isin("resolved", "unverified"), F.col("found_id")))
    # Only responses that a revisit refers to bring their payloads.
    referred = asked.filter(F.col("refers_to").isNotNull()).select(F.col("refers_to").alias("_ref")).distinct()
    answers = records.filter(full).join(referred, F.col("record_id") == F.col("_ref"), "left_semi").select(
        F.col("record_id").alias("_a"), F.col("status").alias("_status"), F.col("headers").alias("_headers"), F.col("payload").alias("_payload")
    ).dropDuplicates(["_a"])
    asked = asked.join(answers, F.col("refers_to") == F.col("_a"), "left")
    renewed = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(RENEWED_HEADERS))
    stored = F.coalesce("_headers", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(renewed), k)), renewed)
    done = F.col("refers_to").isNotNull()
    asked = asked.select(
        "record_id", "canonical_url", "kind", "refers_to", "resolution",
        F.when(done, F.col("_status")).otherwise(F.col("status")).alias("status"),
        F.when(done, merged).otherwise(F.col("headers")).alias("headers"),
        F.when(done, F.col("_payload")).otherwise(F.col("payload")).alias("payload"),
    )
    return plain.unionByName(asked)


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log of ``pages``: each is captured in full, and revisited later.

    Page p is fetched at second p (record 2p) and answered 304 a thousand seconds
    later under a variant of its URL (record 2p + 1).  Every fifth page has no
    entity tag, every seventh no modification date.
    """
    tag = F.when(F.col("page_id") % 5 != 0, F.concat(F.lit('"'), F.md5(F.col("html")), F.lit('"')))
    modified = F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("day "), (F.col("page_id") % 1000).cast("string")))
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("captured_at"), F.lit("response").alias("kind"),
        F.lit(200).alias("status"), tag.alias("etag"), modified.alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.col("page_id").cast("string")).alias("headers"), F.col("html").alias("payload"),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), (F.col("page_id") + 1000).alias("captured_at"),
        F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.concat(F.lit("W/"), tag).alias("etag"), modified.alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("date"), (F.col("page_id") + 1000).cast("string")).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return first.unionByName(again)
