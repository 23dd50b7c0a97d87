"""Resolving "not modified" revisits of a web archive to the full responses they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occugrid.llm.shared import ordered_chunks

HEADERS = "array<struct<name:string,value:string>>"

# Header fields that a "not modified" answer may bring up to date.
PERMITTED = (
    "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary",
)
# Query parameters that name a campaign, not a page.
TRACKING = r"utm_[a-z]+|gclid|fbclid|ref"


def canonical_url(url: Column) -> Column:
    """A key that URLs of the same page share.

    Scheme, ``www.``, default port, fragment, campaign parameters and a closing slash go, the
    host is lower-cased, the other parameters are sorted. A null URL stays null.
    """
    bare = F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    wanted = F.array_sort(
        F.filter(
            F.split(query, "&"),
            lambda part: (part != "") & ~part.rlike(rf"^(?:{TRACKING})(?:=|$)"),
        )
    )
    tail = F.when(F.size(wanted) > 0, F.concat(F.lit("?"), F.array_join(wanted, "&"))).otherwise("")
    return F.concat(host, path, tail)


def header(headers: Column, name: str) -> Column:
    """The last value of a header field, whatever its case; null if there is none."""
    same = F.filter(headers, lambda one: F.lower(one["name"]) == name)
    return F.when(F.size(same) > 0, F.element_at(same, -1)["value"])


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def merged_headers(full: Column, revisit: Column) -> Column:
    """The response's fields, those that a revisit may renew replaced by the revisit's."""

    def allowed(one: Column) -> Column:
        return F.lower(one["name"]).isin(*PERMITTED)

    renewed = F.transform(F.filter(revisit, allowed), lambda one: F.lower(one["name"]))
    return F.concat(
        F.filter(full, lambda one: ~F.array_contains(renewed, F.lower(one["name"]))),
        F.filter(revisit, allowed),
    )


def resolve(captures: DataFrame) -> DataFrame:
    """The response that each revisit stands for.

    ``captures``: ``(record_id long, kind string, url string, at long, status int, headers)``,
    ``headers`` an array of ``(name, value)``. Of kind "response" with status 200 is a full
    response, of kind "revisit" a "not modified" answer; other rows are not looked at. Returns
    a row per revisit: ``(record_id, canonical_url, at, outcome, response_id, response_at,
    headers)``. The latest response of the same canonical URL strictly before the revisit is
    compared: entity tags weakly where both have one, else dates of modification where both
    have one. ``outcome`` is "resolved", "unchecked" where neither can be compared, "changed"
    where they differ, or "missing" without an earlier response; the last two have no response
    and keep the revisit's own headers.

    Of responses at the same time the greatest id counts. A null URL or time matches nothing.
    Null headers are empty. Repeated revisits are resolved each. Other columns are not read.

    The as-of join sorts captures by URL and time into ranges, so that a URL with most of the
    captures is spread over many; each range hands its last response on to the next.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = captures.where(full | (F.col("kind") == "revisit")).select(
        "record_id",
        canonical_url(F.col("url")).alias("url"),
        F.col("at").cast("long").alias("at"),
        F.coalesce(full, F.lit(False)).alias("full"),
        F.coalesce(F.col("headers"), F.array().cast(HEADERS)).cast(HEADERS).alias("headers"),
    )
    # At the same time revisits come first, so that only earlier responses are before them.
    order = [F.col(name).asc() for name in ("at", "full", "record_id")]
    chunked = ordered_chunks(rows, "captures", F.col("url").asc(), *order)
    response = F.when(
        F.col("full") & F.col("at").isNotNull() & F.col("url").isNotNull(),
        F.struct("record_id", "at", "headers"),
    )
    inside = Window.partitionBy("url", "chunk").orderBy(*order)
    lasts = (
        chunked.withColumn("response", response)
        .where(F.col("response").isNotNull())
        .groupBy("url", "chunk")
        .agg(F.max_by("response", F.struct("at", "record_id")).alias("last"))
    )
    # A URL has a row for each range it reaches into.
    places = chunked.where("not full").select("url", "chunk").distinct()
    handed = (
        places.join(lasts, ["url", "chunk"], "full")
        .select(
            "url",
            "chunk",
            F.last("last", ignorenulls=True)
            .over(
                Window.partitionBy("url")
                .orderBy("chunk")
                .rowsBetween(Window.unboundedPreceding, -1)
            )
            .alias("handed"),
        )
        .where(F.col("handed").isNotNull())
    )
    found = (
        chunked.withColumn(
            "inside",
            F.last(response, ignorenulls=True).over(
                inside.rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .where("not full")
        .join(handed, ["url", "chunk"], "left")
        .withColumn(
            "response",
            F.when(F.col("at").isNotNull() & F.col("url").isNotNull(),
                   F.coalesce("inside", "handed")),
        )
    )
    theirs, own = F.col("response.headers"), F.col("headers")
    tags = (_weak(header(theirs, "etag")), _weak(header(own, "etag")))
    dates = (header(theirs, "last-modified"), header(own, "last-modified"))
    outcome = (
        F.when(F.col("response").isNull(), "missing")
        .when(tags[0].isNotNull() & tags[1].isNotNull(),
              F.when(tags[0] == tags[1], "resolved").otherwise("changed"))
        .when(dates[0].isNotNull() & dates[1].isNotNull(),
              F.when(dates[0] == dates[1], "resolved").otherwise("changed"))
        .otherwise("unchecked")
    )
    linked = F.col("outcome").isin("resolved", "unchecked")
    return found.withColumn("outcome", outcome).select(
        "record_id",
        F.col("url").alias("canonical_url"),
        "at",
        "outcome",
        F.when(linked, F.col("response.record_id")).alias("response_id"),
        F.when(linked, F.col("response.at")).alias("response_at"),
        F.when(linked, merged_headers(theirs, own)).otherwise(own).alias("headers"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Captures derived from ``pages (page_id, url, html)``: each page, and three revisits of it.

    A page is a response at ``100 * page_id``. Revisits ask again later for another spelling
    of its URL; one has the page's entity tag, one only its date of modification, and one,
    for two pages in five, a tag that has changed meanwhile. One revisit in three of the first
    kind comes before the page was captured.
    """
    page = F.col("page_id")
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    date = F.concat(F.lit("day "), (page % 365).cast("string"))

    def field(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    def record(i: int, kind: str, url: Column, at: Column, status: int, *headers: Column) -> Column:
        return F.struct(
            (page * 4 + i).alias("record_id"),
            F.lit(kind).alias("kind"),
            url.alias("url"),
            at.alias("at"),
            F.lit(status).alias("status"),
            F.array(*headers).cast(HEADERS).alias("headers"),
        )

    at = page * 100
    spelled = F.concat(F.regexp_replace(F.col("url"), r"#.*$", ""), F.lit("#again"))
    records = F.array(
        record(0, "response", F.col("url"), at, 200,
               field("ETag", tag), field("Last-Modified", date),
               field("Content-Length", F.length("html").cast("string")),
               field("Date", at.cast("string"))),
        record(1, "revisit", spelled, F.when(page % 3 == 0, at - 7).otherwise(at + 7), 304,
               field("etag", F.concat(F.lit("W/"), tag)), field("Date", (at + 7).cast("string"))),
        record(2, "revisit", spelled, at + 20, 304,
               field("Last-Modified", date), field("Content-Length", F.lit("0"))),
        record(3, "revisit", spelled, at + 30, 304,
               field("ETag", F.when(page % 5 < 2, F.lit("new")).otherwise(tag)),
               field("Expires", (at + 1000).cast("string"))),
    )
    return pages.select(F.explode(records).alias("one")).select("one.*")
