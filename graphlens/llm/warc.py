"""Operator 1: resolves not-modified revisits of web archives by an as-of join.

Captures are rows of (record_id, url, captured_at, kind, status, headers, payload): kind is
`response` or `revisit`, headers a map with lower-case names. A revisit with status 304 is matched,
by canonical URL, to the latest earlier full response (status 200). It is resolved when a validator
agrees: entity tags compared weakly, or else Last-Modified. Headers of the 304 that may update a
stored response replace or join its own; those that describe the sent body never do.

Only keys, times and ids pass through the as-of join. A URL is cut into spans of time: inside a
span the last full response so far comes from a window, and one row per URL and span carries the
last response of earlier spans forward, so a URL with a third of all captures is spread over its
spans. Headers and payloads join once at the end, by record id.

Defined results: rows with a null url, time or id are kept as they are and never matched; equal
times are ordered by record id; repeated rows come back once each; a revisit without an earlier
full response is `no_response`, one whose validators differ or are missing is `not_matching`; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a span in seconds.
SPAN_SECONDS = 3600
# Header fields of a 304 that describe its own message, not the stored response.
FORBIDDEN = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
# Query parameters that do not name a resource.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="


def canonical_url(url: Column) -> Column:
    """One form for URLs of one resource.

    Scheme, default port, a leading www., fragment, trailing slash and tracking parameters go; the
    host is lower-cased and the remaining parameters are sorted.
    """
    bare = F.regexp_replace(F.substring_index(F.trim(url), "#", 1), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    spot = F.substring_index(bare, "?", 1)
    host = F.regexp_replace(F.lower(F.substring_index(spot, "/", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(spot, r"^[^/]*(/.*)?$", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^[Ww]/", "")


def _agree(revisit: Column, response: Column) -> Column:
    """Whether a validator of the revisit's headers agrees with the response's."""
    both = revisit["etag"].isNotNull() & response["etag"].isNotNull()
    dates = F.trim(revisit["last-modified"]) == F.trim(response["last-modified"])
    return F.coalesce(F.when(both, _weak(revisit["etag"]) == _weak(response["etag"])).otherwise(dates), F.lit(False))


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, updated by those of the revisit that may update them."""
    fresh = F.map_filter(revisit, lambda k, v: ~k.isin(*FORBIDDEN) & v.isNotNull())
    old = F.map_filter(response, lambda k, v: ~F.map_contains_key(fresh, k))
    return F.map_concat(old, fresh)


def as_of_responses(captures: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """(record_id, response_id) of every revisit and its latest earlier full response, or null."""
    rows = captures.where("record_id is not null and url is not null and captured_at is not null").select(
        canonical_url(F.col("url")).alias("key"),
        F.floor(F.unix_micros(F.col("captured_at").cast("timestamp")) / F.lit(span_seconds * 1_000_000)).alias("span"),
        F.col("captured_at").cast("timestamp").alias("at"),
        "record_id",
        (F.col("kind") == "revisit").alias("again"),
        ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"),
    )
    rows = rows.where(F.col("again") | F.col("full"))
    spot = F.struct("at", "record_id")
    lasts = rows.where("full").groupBy("key", "span").agg(F.max(spot).alias("last"))
    spans = rows.select("key", "span").distinct().join(lasts, ["key", "span"], "left")
    earlier = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("key", "span", F.last("last", ignorenulls=True).over(earlier).alias("carry"))
    inside = Window.partitionBy("key", "span").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last(F.when(F.col("full"), spot), ignorenulls=True).over(inside)).where("again")
    return near.join(carried, ["key", "span"]).select(
        "record_id", F.coalesce("near", "carry")["record_id"].alias("response_id")
    )


def resolve_revisits(captures: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """Every capture as a full response where that is known.

    Returns record_id, url, captured_at, outcome (`response`, `resolved`, `not_matching`,
    `no_response`, `other`), response_id, headers (merged where resolved) and payload.
    """
    rows = captures.select("record_id", "url", "captured_at", "kind", "status", "headers", "payload")
    pairs = as_of_responses(rows, span_seconds).dropDuplicates(["record_id"])
    stored = rows.where((F.col("kind") == "response") & (F.col("status") == 200)).select(
        F.col("record_id").alias("response_id"), F.col("headers").alias("old"), F.col("payload").alias("body")
    ).dropDuplicates(["response_id"])
    paired = rows.where("kind = 'revisit'").join(pairs, "record_id", "left")
    # those without a response would all meet in one task of the join
    alone = paired.where("response_id is null").select("*", *(F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in ("old", "body")))
    met = paired.where("response_id is not null").join(stored, "response_id", "left").select(*alone.columns)
    revisits = met.unionByName(alone)
    found = F.col("response_id").isNotNull() & (F.col("status") == 304)
    fits = found & _agree(F.col("headers"), F.col("old"))
    resolved = revisits.select(
        "record_id",
        "url",
        "captured_at",
        F.when(fits, "resolved").when(found, "not_matching").otherwise("no_response").alias("outcome"),
        F.when(found, F.col("response_id")).alias("response_id"),
        F.when(fits, merged_headers(F.col("old"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(fits, F.col("body")).alias("payload"),
    )
    plain = rows.where("kind is null or kind <> 'revisit'").select(
        "record_id",
        "url",
        "captured_at",
        F.when(F.col("kind") == "response", "response").otherwise("other").alias("outcome"),
        F.lit(None).cast(rows.schema["record_id"].dataType).alias("response_id"),
        "headers",
        "payload",
    )
    return plain.unionByName(resolved)


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Captures made from the pages table: a full response and a later revisit of each page.

    Pages are fetched one a second in order of their id. Each is asked for again two hours later,
    by its URL with another fragment; one in seven of these revisits names an outdated entity tag,
    one in five has only a date, and one in eleven pages first answered with an error.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 12), F.lit('"'))
    dated = F.concat(F.lit("day "), (F.col("page_id") % 1000).cast("string"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id"))
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        at.alias("captured_at"),
        F.lit("response").alias("kind"),
        F.when(F.col("page_id") % 11 == 10, 500).otherwise(200).alias("status"),
        F.create_map(
            F.lit("etag"), tag, F.lit("last-modified"), dated, F.lit("content-type"), F.lit("text/html"),
            F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("cache-control"), F.lit("max-age=60"),
        ).alias("headers"),
        F.col("html").alias("payload"),
    )
    stale = F.col("page_id") % 7 == 6
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        F.concat(F.col("url"), F.lit("#again")).alias("url"),
        (at + F.expr("interval 2 hours")).alias("captured_at"),
        F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"),
        F.map_filter(
            F.create_map(
                F.lit("etag"), F.when(F.col("page_id") % 5 == 4, F.lit(None)).when(stale, F.lit('"old"')).otherwise(F.concat(F.lit("W/"), tag)),
                F.lit("last-modified"), dated, F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=90"),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return first.unionByName(again)


def digest(resolved: DataFrame) -> DataFrame:
    """The resolved captures with digests in place of headers and payload."""
    h = F.col("headers")
    return resolved.select(
        "record_id",
        "url",
        "outcome",
        "response_id",
        h["etag"].alias("etag"),
        h["cache-control"].alias("cache_control"),
        h["content-length"].alias("content_length"),
        F.md5(F.col("payload").cast("binary")).alias("payload_md5"),
    )


#: DuckDB SQL of digest(resolve_revisits(captures_of_pages(pages))).
ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, url, html, '"' || substr(md5(html), 1, 12) || '"' AS tag,
         'day ' || CAST(page_id % 1000 AS VARCHAR) AS dated, page_id AS fetched,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages
), k AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(bare, '^[^/?]*(/[^?]*)?', 1), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
         lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&'), ''), '') AS key
  FROM p
), full_ AS (
  SELECT key, fetched, page_id * 2 AS record_id, html, tag, dated FROM k WHERE page_id % 11 <> 10
), hit AS (
  SELECT r.page_id, r.url, r.tag, r.dated, max({'fetched': f.fetched, 'record_id': f.record_id}) AS m
  FROM k r LEFT JOIN full_ f ON f.key = r.key AND f.fetched < r.fetched + 7200 GROUP BY ALL
), two AS (
  SELECT h.page_id, h.url, f.record_id AS response_id, f.html, f.tag AS old_tag,
    CASE WHEN h.page_id % 5 = 4 THEN NULL WHEN h.page_id % 7 = 6 THEN '"old"' ELSE 'W/' || h.tag END AS etag,
    CASE WHEN f.record_id IS NULL THEN 'no_response'
         WHEN CASE WHEN h.page_id % 5 = 4 THEN h.dated = f.dated WHEN h.page_id % 7 = 6 THEN FALSE ELSE h.tag = f.tag END
         THEN 'resolved' ELSE 'not_matching' END AS outcome
  FROM hit h LEFT JOIN full_ f ON f.record_id = h.m.record_id
)
SELECT page_id * 2 AS record_id, url, 'response' AS outcome, CAST(NULL AS BIGINT) AS response_id, tag AS etag,
       'max-age=60' AS cache_control, CAST(strlen(html) AS VARCHAR) AS content_length, md5(html) AS payload_md5
FROM p
UNION ALL
SELECT page_id * 2 + 1, url || '#again', outcome, response_id,
       CASE WHEN outcome = 'resolved' THEN coalesce(etag, old_tag) ELSE etag END, 'max-age=90',
       CASE WHEN outcome = 'resolved' THEN CAST(strlen(html) AS VARCHAR) ELSE '0' END,
       CASE WHEN outcome = 'resolved' THEN md5(html) END
FROM two
"""
