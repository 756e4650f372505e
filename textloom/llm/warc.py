"""Revisit records of web archives that were "not modified", resolved to the response they stand for.

A revisit belongs to the latest earlier full response for its canonical URL: an
as-of join. It stands only if the validators agree; then the headers that a
304 response may update are merged into those of the response. All in
DataFrame operations; a URL's captures are dealt by time as well as by URL, so
that a URL with a third of all records is no one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import LOWER, UPPER, ascii_lower, staged

#: Header fields of the stored response that a 304 leaves alone: they describe the body that isn't sent again, or one hop.
KEPT_FIELDS = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Time slices over which the captures of all URLs are dealt.
SLICES = 64
_TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|sessionid|jsessionid|phpsessid)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Scheme, userinfo, ``www.``, default port, fragment, tracking parameters and a last slash go; the host is lower-cased.

    Null and what has no ``://`` become null.
    """
    whole = r"(?is)\A[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?"
    host = ascii_lower(F.regexp_extract(url, whole, 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)?\z", ""), r"\Awww\d?\.", "")
    path = F.regexp_replace(F.regexp_extract(url, whole, 2), r"/\z", "")
    query = F.substring(F.regexp_extract(url, whole, 3), 2, 1 << 30)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.translate(p, UPPER, LOWER).rlike(rf"\A{_TRACKING}\z")))
    tail = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(url.rlike(r"(?is)\A[a-z][a-z0-9+.-]*://"), F.concat(host, path, tail))


def header_map(block: Column) -> Column:
    """Field names (lower-case) and values of an HTTP header block; of repeated fields the last stays, other lines are skipped."""
    split = F.split(F.coalesce(block, F.lit("")), r"\r?\n")
    fields = F.filter(split, lambda x: x.rlike(r"\A[!#$%&'*+.^_`|~0-9A-Za-z-]+:"))
    pairs = F.transform(fields, lambda x: F.struct(F.translate(F.substring_index(x, ":", 1), UPPER, LOWER).alias("k"), F.trim(F.regexp_replace(x, r"\A[^:]*:", "")).alias("v")))
    # A field's last occurrence counts, whatever spark.sql.mapKeyDedupPolicy says.
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]).alias("again"))), lambda p: ~p["again"])
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def _weak(etag: Column) -> Column:
    """An entity tag as the weak comparison sees it."""
    return F.regexp_replace(etag, r"\AW/", "")


def _slices(dates: DataFrame) -> Column:
    """A column with the number of the time slice of ``date``; equal dates share one."""
    cuts = dates.select(F.percentile_approx("date", [i / SLICES for i in range(1, SLICES)], 10_000)).first()[0] or []
    return F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<long>"), lambda c: c <= F.col("date")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit record: record_id, canonical_url, date, status, original_id, original_date, headers.

    ``records`` has record_id, url, date (long, any unit), kind (``response``
    or ``revisit``), http_status (int) and headers (an HTTP header block). A
    full response is a ``response`` of status 200; its time must be strictly
    earlier, and of several at the latest time the largest record_id counts.
    status is ``resolved`` (ETags are weakly equal or, where one side has none,
    Last-Modified is equal), ``mismatch``, ``no_validator`` (nothing to
    compare) or ``no_original`` (also without a URL or date). headers, a sorted
    array of "name: value", are the response's with those of the revisit that
    may change them, if resolved, else the revisit's own. Null headers count as
    none; null kinds are ignored; rows that repeat give rows of their own;
    further columns are ignored; an empty table gives an empty result.
    """
    id_type = dict(records.dtypes)["record_id"]
    rows = records.filter("kind in ('response', 'revisit')").select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("date").cast("long").alias("date"),
        (F.col("kind") == "revisit").alias("revisit"), (F.coalesce(F.col("kind") == "response", F.lit(False)) & F.coalesce(F.col("http_status") == 200, F.lit(False))).alias("full"),
        header_map(F.col("headers")).alias("headers"),
    )
    rows = staged(rows.filter("revisit or full").withColumn("slice", _slices(rows.filter("date is not null"))), "captures")
    response = F.when(F.col("full"), F.struct("record_id", "date", "headers"))
    order = F.when(F.col("full"), F.struct("date", "record_id"))

    placed = rows.filter("canonical_url is not null and date is not null")
    before = Window.partitionBy("canonical_url", "slice").orderBy("date").rangeBetween(Window.unboundedPreceding, -1)
    found = placed.withColumn("original", F.max_by(response, order).over(before)).filter("revisit").drop("revisit", "full")

    # What earlier slices have left: one row per URL and slice.
    ends = placed.filter("full").groupBy("canonical_url", "slice").agg(F.max_by(response, order).alias("last"))
    starts = placed.filter("revisit").select("canonical_url", "slice").distinct().withColumn("last", F.lit(None).cast(ends.schema["last"].dataType))
    earlier = Window.partitionBy("canonical_url").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.unionByName(starts).groupBy("canonical_url", "slice").agg(F.first("last", ignorenulls=True).alias("last"))
    carried = staged(carried.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).filter("carried is not null").select("canonical_url", "slice", "carried"), "carried")
    inside, open_ = (staged(found, "found"),) * 2
    inside, open_ = inside.filter("original is not null"), open_.filter("original is null").drop("original")
    asof = inside.unionByName(open_.join(carried, ["canonical_url", "slice"], "left").withColumnRenamed("carried", "original"))
    lost = rows.filter("revisit and (canonical_url is null or date is null)").drop("revisit", "full").withColumn("original", F.lit(None).cast(asof.schema["original"].dataType))
    asof = asof.unionByName(lost)

    own, theirs = F.col("headers"), F.col("original.headers")
    etag = lambda h: F.element_at(h, "etag")
    since = lambda h: F.element_at(h, "last-modified")
    status = (
        F.when(F.col("original").isNull(), "no_original")
        .when(etag(own).isNotNull() & etag(theirs).isNotNull(), F.when(_weak(etag(own)) == _weak(etag(theirs)), "resolved").otherwise("mismatch"))
        .when(since(own).isNotNull() & since(theirs).isNotNull(), F.when(since(own) == since(theirs), "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    kept = F.array(*[F.lit(x) for x in KEPT_FIELDS])
    updates = F.map_filter(own, lambda k, _: ~F.array_contains(kept, k))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(updates, k)), updates)
    listed = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return asof.withColumn("status", status).select(
        "record_id", "canonical_url", "date", "status",
        F.col("original.record_id").cast(id_type).alias("original_id"), F.col("original.date").alias("original_date"),
        F.when(F.col("status") == "resolved", listed(merged)).otherwise(listed(own)).alias("headers"),
    )
