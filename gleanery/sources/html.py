"""Landed HTML and Markdown pages to rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import squeeze, strip_html
from gleanery.functions.urls import canonical_url, host

# Anchor texts of page furniture.
FURNITURE = r"(?i)^(?:featured|read more|learn more|view (?:more|all)|this documentation|next|previous|blog|home)$"


def listed_links(pages: DataFrame, page: str, url: str, html: str, path: str, limit: int) -> DataFrame:
    """The first ``limit`` links of each page whose path holds ``path`` and whose text is a title.

    Relative links are resolved against the page's host; links to the page's own
    path are skipped; of links with one canonical URL the first stays.  Where a
    link's text is too short or furniture, its aria-label stands in.
    """
    anchor = r"(?is)<a\b[^>]*href=[\"'][^\"']+[\"'][^>]*>.*?</a>"
    rows = pages.select(page, F.col(url).alias("_page_url"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(anchor), F.lit(0))).alias("pos", "_a"))
    href = F.regexp_extract("_a", r"(?is)href=[\"']([^\"']+)[\"']", 1)
    full = F.when(href.rlike(r"(?i)^https?://"), href).when(F.startswith(href, F.lit("/")), F.concat(F.regexp_extract("_page_url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), href))
    shown = strip_html(F.regexp_extract("_a", r"(?is)>(.*)</a>", 1))
    aria = F.regexp_extract("_a", r"(?is)aria-label=[\"']([^\"']+)[\"']", 1)
    fits = lambda t: (F.length(t) >= 6) & ~t.rlike(FURNITURE)
    rows = rows.select(page, "pos", "_page_url", full.alias("link"), F.when(fits(shown), shown).when(fits(aria), aria).alias("title")).filter("link is not null and title is not null")
    path_of = lambda c: F.regexp_replace(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/$", "")
    rows = rows.filter(F.contains(path_of("link"), F.lit(path)) & ((path_of("link") != path_of("_page_url")) | (host(F.col("link")) != host(F.col("_page_url")))))
    rows = rows.withColumn("canonical", canonical_url(F.col("link")))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(page, "canonical").orderBy("pos"))).filter("_n = 1").drop("_n", "_page_url")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(page).orderBy("pos"))).filter(F.col("_n") <= limit).drop("_n")


def article(html: Column) -> dict[str, Column]:
    """h1, og description, and the visible text of the article, main or page scope without furniture."""
    none = lambda c: F.nullif(c, F.lit(""))
    scope = F.coalesce(none(F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article>", 1)), none(F.regexp_extract(html, r"(?is)<main\b[^>]*>(.*?)</main>", 1)), html)
    bare = F.regexp_replace(scope, r"(?is)<(script|style|nav|footer|header|aside|form|noscript)\b.*?</\1>", " ")
    og = F.regexp_extract(html, r"(?is)<meta[^>]+property=[\"']og:description[\"'][^>]+content=[\"']([^\"']+)[\"']", 1)
    return {"h1": squeeze(strip_html(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))), "og": none(og), "visible": strip_html(bare)}


def og_image(html: Column) -> Column:
    """The og or twitter image, attributes in either order."""
    out = []
    for name in ("og:image", "twitter:image"):
        key = rf"(?:property|name)=[\"']{name}[\"']"
        out += [F.regexp_extract(html, rf"(?is)<meta[^>]+{key}[^>]+content=[\"']([^\"']+)[\"']", 1), F.regexp_extract(html, rf"(?is)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+{key}", 1)]
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in out])


def fill_images(items: DataFrame, pages: DataFrame, url: str, image: str, html: str) -> DataFrame:
    """Items without an image take the one of their page."""
    found = pages.select(F.col(url).alias("_of"), og_image(F.col(html)).alias("_image")).filter("_image is not null").dropDuplicates(["_of"])
    return items.join(found, F.col(url) == F.col("_of"), "left").withColumn(image, F.coalesce(image, "_image")).drop("_of", "_image")


MONTHS = "january february march april may june july august september october november december".split()


def day_of(label: str) -> str | None:
    """An ISO or English date label as YYYY-MM-DD; impossible days are none."""
    import datetime

    label = label.strip()
    m = re.search(r"\b((?:19|20)\d\d)-(\d\d)-(\d\d)\b", label)
    parts = m and (int(m[1]), int(m[2]), int(m[3]))
    if not parts and (m := re.search(r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+((?:19|20)\d\d)\b", label)):
        month = next((k + 1 for k, name in enumerate(MONTHS) if name.startswith(m[1].lower()[:3]) and name.startswith(m[1].lower())), None)
        parts = month and (int(m[3]), month, int(m[2]))
    try:
        return datetime.date(*parts).isoformat() if parts else None
    except ValueError:
        return None


def plain(markdown: str) -> str:
    """Markdown and tags taken off, white space squeezed."""
    text = re.sub(r"!?\[([^\]]*)\]\([^)]+\)", r"\1", markdown)
    text = re.sub(r"`([^`]+)`", r"\1", text)
    return " ".join(re.sub(r"[*_~#>]+", " ", re.sub(r"<[^>]+>", " ", text)).split())


def note_entries(body: str, kind: str) -> Iterator[tuple[str, str, str]]:
    """(day, title, summary) of release notes.

    ``html``: h3 entries under h2 dates.  ``sections``: Markdown headings with
    dates, entries by subheading.  ``bullets``: entries by bullet.
    """
    if kind == "html":
        marks = [(m.start(), m.end(), int(m[1]), plain(m[2])) for m in re.finditer(r"(?is)<h([23])\b[^>]*>(.*?)</h\1>", body)]
    else:
        marks = [(m.start(), m.end(), len(m[1]), m[2].strip()) for m in re.finditer(r"(?m)^(#{2,6})\s+(.+?)\s*$", body)]
    day, level, month = None, 0, None
    for k, (_, end, depth, label) in enumerate(marks):
        upto = marks[k + 1][0] if k + 1 < len(marks) else len(body)
        if m := re.fullmatch(rf"(?i)({'|'.join(MONTHS)}),?\s+((?:19|20)\d\d)", label):
            month, day = (m[1], m[2]), None
            continue
        found = day_of(label)
        if not found and month and (m := re.fullmatch(r"[A-Za-z]{3,9}\.?\s+(\d{1,2})", label)):
            found = day_of(f"{month[0]} {m[1]}, {month[1]}")
        text = body[end:upto]
        if found:
            day, level = found, depth
            if kind == "bullets":
                for bullet in re.findall(r"(?m)^[*+-]\s+(.+(?:\n(?!\s*(?:[*+-]|#{1,6})\s).+)*)", text) or [text]:
                    yield day, re.split(r"(?<=[.!?])\s+", plain(bullet))[0], plain(bullet)
            elif kind == "sections" and plain(text):
                yield day, re.split(r"(?<=[.!?])\s+", plain(text))[0], plain(text)
        elif day and depth > level:
            yield day, plain(label), plain(text)


def release_notes(pages: DataFrame, page: str, body: str, kind: str, least: int = 6, limit: int = 10) -> DataFrame:
    """Page, pos, day, title, summary and a stable id of the first ``limit`` entries of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["page"], batch["body"]):
                entries = [e for e in note_entries(text or "", kind) if len(e[1]) >= least][:limit]
                rows += [(key, k, day, title[:240], summary[:1000]) for k, (day, title, summary) in enumerate(entries)]
            yield pd.DataFrame(rows, columns=["page", "pos", "day", "title", "summary"])

    key_type = pages.schema[page].dataType.simpleString()
    rows = pages.select(F.col(page).alias("page"), F.col(body).alias("body")).mapInPandas(run, f"page {key_type}, pos int, day string, title string, summary string")
    return rows.withColumn("entry_id", F.substring(F.sha2(F.concat_ws("|", "day", F.lower("title"), F.col("page").cast("string")), 256), 1, 20))
