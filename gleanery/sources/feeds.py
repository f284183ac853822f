"""Landed feed payloads (one document per row) to item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import strip_html

RSS = "channel struct<title: string, description: string, item: array<struct<title: string, link: string, guid: string, description: string, pubDate: string, isoDate: string, creator: string, category: array<string>, enclosure: struct<_url: string, _type: string>, thumbnail: struct<_url: string>>>>"
ATOM = "entry array<struct<id: string, title: string, summary: string, published: string, author: array<struct<name: string>>, category: array<struct<_term: string>>, doi: string>>"
IMAGE = r"(?i)\.(jpe?g|png|gif|webp|avif)(\?|$)"


def feed_time(*texts: Column) -> Column:
    """The first text that is an ISO or an RFC 822 time."""
    tries = []
    for t in texts:
        tries += [F.try_to_timestamp(t), F.try_to_timestamp(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(t, r"^[A-Za-z]{3},\s*|\s+GMT$", ""), F.lit("d MMM yyyy HH:mm:ss"))]
    return F.coalesce(*tries)


def pick_image(item: Column) -> Column:
    """S3: an enclosure that is an image, else the media thumbnail, else the first ``img`` of the text."""
    enclosure = F.when(F.startswith(item["enclosure"]["_type"], F.lit("image/")) | item["enclosure"]["_url"].rlike(IMAGE), item["enclosure"]["_url"])
    inline = F.nullif(F.regexp_extract(item["description"], r"(?i)<img[^>]+src=[\"']([^\"']+)[\"']", 1), F.lit(""))
    url = F.coalesce(enclosure, item["thumbnail"]["_url"], inline)
    return F.trim(F.replace(F.replace(url, F.lit("&amp;"), F.lit("&")), F.lit("&#39;"), F.lit("'")))


def rss_items(payloads: DataFrame, source: str, body: str, limit: int, as_of: Column, wanted: Column | None = None) -> DataFrame:
    """The first ``limit`` items of each payload that have a title and a link or guid.

    A missing time is ``as_of``; a payload that is no XML gives no rows.
    ``wanted`` is a condition on the columns title and summary.
    """
    parsed = payloads.select(source, F.from_xml(body, F.lit(RSS))["channel"].alias("channel"))
    rows = parsed.select(source, F.col("channel.description").alias("_about"), F.posexplode("channel.item").alias("pos", "item"))
    link = F.coalesce(F.nullif(F.trim("item.link"), F.lit("")), F.nullif(F.trim("item.guid"), F.lit("")))
    rows = rows.select(
        source, "pos", F.nullif(F.trim("item.title"), F.lit("")).alias("title"), link.alias("url"), F.coalesce(F.nullif(strip_html(F.col("item.description")), F.lit("")), "_about", "item.title").alias("summary"),
        F.coalesce(feed_time(F.col("item.isoDate"), F.col("item.pubDate")), as_of).alias("published_at"), F.col("item.creator").alias("author"), F.slice(F.coalesce("item.category", F.array().cast("array<string>")), 1, 4).alias("tags"), pick_image(F.col("item")).alias("image"),
    ).filter("title is not null and url is not null")
    if wanted is not None:
        rows = rows.filter(wanted)
    place = F.row_number().over(Window.partitionBy(source).orderBy("pos"))
    return rows.withColumn("_n", place).filter(F.col("_n") <= limit).drop("_n")


def atom_papers(payloads: DataFrame, source: str, body: str) -> DataFrame:
    """The papers of Atom payloads, authors and categories as arrays."""
    from gleanery.functions.urls import arxiv_id

    parsed = payloads.select(source, F.inline(F.from_xml(body, F.lit(ATOM))["entry"]))
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return parsed.select(
        source, arxiv_id(F.col("id")).alias("arxiv_id"), squeeze("title").alias("title"), squeeze("summary").alias("abstract"), F.try_to_timestamp("published").alias("submitted_at"),
        F.transform("author", lambda a: a["name"]).alias("authors"), F.transform("category", lambda c: c["_term"]).alias("categories"), "doi",
    )


def proceedings(payloads: DataFrame, source: str, body: str) -> DataFrame:
    """Papers of a table of contents (article, inproceedings, incollection); front matter is skipped."""
    blocks = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<(?:article|inproceedings|incollection)\b.*?</(?:article|inproceedings|incollection)>"), F.lit(0))
    rows = payloads.select(source, F.explode(blocks).alias("b"))
    title = F.trim(F.regexp_replace(strip_html(F.regexp_extract("b", r"(?is)<title>(.*?)</title>", 1)), r"\.$", ""))
    doi = F.regexp_extract("b", r"(?i)<ee[^>]*>https?://(?:dx\.)?doi\.org/([^<]+)</ee>", 1)
    rows = rows.select(source, title.alias("title"), F.nullif(F.lower(doi), F.lit("")).alias("doi"), F.regexp_extract_all(F.col("b"), F.lit(r"(?is)<author[^>]*>(.*?)</author>"), F.lit(1)).alias("authors"))
    return rows.filter((F.col("title") != "") & ~F.col("title").rlike(r"(?i)^proceedings of\b"))
