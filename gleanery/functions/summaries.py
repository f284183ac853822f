"""Summaries composed of a page's parts within a budget of characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import spaced, squeeze

# Limits of a composed summary.
MOST_CHARS, LEAD_SENTENCES, LEAST_SENTENCE = 800, 2, 20


def kept_parts(parts: Column) -> Column:
    """P26 in order: of two strings of which one holds the other the longer stays, in the place of the first."""

    def step(seen: Column, part: Column) -> Column:
        value = squeeze(part)
        at = F.array_position(F.transform(seen, lambda e: F.contains(e, value) | F.contains(value, e)), True)
        longer = F.transform(seen, lambda e, k: F.when((k + 1 == at) & (F.length(value) > F.length(e)), value).otherwise(e))
        return F.when(F.coalesce(value, F.lit("")) == "", seen).when(at > 0, longer).otherwise(F.array_append(seen, value))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def joined(parts: Column) -> Column:
    return F.array_join(kept_parts(parts), " ")


def identifies(listing: Column, h1: Column) -> Column:
    """Whether a listing's title, of six characters or more, and the page's heading hold one another; any such title does where there is no heading."""
    a, b = spaced(listing), spaced(h1)
    return (F.length(a) >= 6) & ((F.trim(h1) == "") | F.contains(b, a) | F.contains(a, b))


def compose(h1: Column, og: Column, lead: Column, later: Column, listing: Column | None = None, wanted: Callable[[Column], Column] | None = None, most: int = MOST_CHARS) -> Column:
    """P25: heading, og text, leads while they fit, then later sentences that are ``wanted``, while they fit.

    The heading is taken only if a listing title is given that does not identify
    the page.  The first part always goes in; the first lead or later sentence
    that would pass ``most`` characters ends its list.  Lengths are code points.
    Null strings and arrays count as empty.
    """
    h1, og = F.coalesce(h1, F.lit("")), F.coalesce(og, F.lit(""))
    lead, later = (F.coalesce(x, F.array().cast("array<string>")) for x in (lead, later))
    with_h1 = F.lit(False) if listing is None else (h1 != "") & listing.isNotNull() & ~identifies(listing, h1)
    given = F.filter(F.array(F.when(with_h1, h1), og), lambda p: F.coalesce(p, F.lit("")) != "")

    def taken(parts: Column, offered: Column, first_free: bool) -> Column:
        def step(acc: Column, p: Column) -> Column:
            fits = F.length(joined(F.array_append(acc["parts"], p))) <= most
            fits = fits | (F.size(acc["parts"]) == 0) if first_free else fits
            more = F.struct(F.array_append(acc["parts"], p).alias("parts"), F.lit(True).alias("open"))
            return F.when(~acc["open"], acc).when(fits, more).otherwise(F.struct(acc["parts"].alias("parts"), F.lit(False).alias("open")))

        return F.aggregate(offered, F.struct(parts.alias("parts"), F.lit(True).alias("open")), step)["parts"]

    parts = taken(given, lead, True)
    if wanted is not None:
        parts = taken(parts, F.filter(later, wanted), False)
    return F.substring(joined(parts), 1, most)


def sentences(html: Column, least: int = LEAST_SENTENCE) -> Column:
    """Sentences of ``least`` characters or more of the paragraphs of a piece of HTML, in order."""
    blocks = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1), lambda b: squeeze(F.regexp_replace(b, r"<[^>]*>", " ")))
    long = F.filter(blocks, lambda b: F.length(b) >= least)
    return F.filter(F.flatten(F.transform(long, lambda b: F.split(b, r"(?<=[.!?])\s+"))), lambda s: F.length(s) >= least)


def lead_and_later(body: Column, leads: int = LEAD_SENTENCES) -> tuple[Column, Column]:
    """Sentences before the first heading below the title (the first few of them), and those from it on."""
    rest = F.regexp_replace(body, r"(?is)^(.*?)<h1\b[^>]*>.*?</h1>", "$1 ")
    head = F.regexp_extract(rest, r"(?is)^(.*?)(?:<h[1-6]\b|\z)", 1)
    return F.slice(sentences(head), 1, leads), sentences(F.substring(rest, F.length(head) + 1, F.length(rest)))
