"""Text and identity expressions; all but the inverted index stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_VERBS = ("introducing", "announcing", "launching", "releasing")  # fixed values
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))  # fixed values, in this order


# Letters whose upper case is several letters, and the one that stands for each: its title case, or itself if that is long as well.
LONG_UPPER = "".join(x for x in map(chr, range(0x10000)) if len(x.upper()) > 1)
ONE_UPPER = "".join("ẞ" if x == "ß" else x.title() if len(x.title()) == 1 else x for x in LONG_UPPER)


def upper_letter(letter: Column) -> Column:
    """One character in upper case as one character: ß gives ẞ, not SS."""
    up = F.upper(letter)
    return F.when(F.length(up) > F.length(letter), F.translate(letter, LONG_UPPER, ONE_UPPER)).otherwise(up)


def upper_word(word: Column) -> Column:
    """A word in upper case, character by character."""
    up = F.upper(word)
    return F.when(F.length(up) > F.length(word), F.array_join(F.transform(F.split(word, ""), upper_letter), "")).otherwise(up)


def squeeze(text: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def strip_html(html: Column) -> Column:
    """Tags to spaces, six entities decoded in a fixed order, white space squeezed."""
    text = F.regexp_replace(html, r"<[^>]+>", " ")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return squeeze(text)


def slug(raw: Column, most: int = 80) -> Column:
    """The slug part of an id: lower case, one dash for other runs, one cut at each end."""
    base = F.regexp_replace(F.lower(raw), r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(base, r"^-|-$", ""), 1, most)


def slug_id(prefix: str, raw: Column) -> Column:
    """Prefix and slug; a text without slug gets a hash of itself, so ids are the same in every run."""
    base = slug(raw)
    return F.concat(F.lit(prefix + "-"), F.when(base == "", F.substring(F.sha2(raw, 256), 1, 12)).otherwise(base))


def spaced(text: Column) -> Column:
    """Lower case, anything but ASCII letters and digits to single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def launch_title(title: Column) -> Column:
    """The normal form of a launch title: no quotes, no launch verbs."""
    text = F.regexp_replace(F.lower(title), r"['’]", "")
    text = F.regexp_replace(text, rf"(?<![a-z0-9_])(?:{'|'.join(TITLE_VERBS)})(?![a-z0-9_])", "")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def reading_time(text: Column) -> Column:
    """Minutes at 180 words a minute, between 2 and 12."""
    return F.greatest(F.lit(2), F.least(F.lit(12), F.floor(word_count(text) / 180 + 0.5))).cast("int")


def rounded(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + 0.5)


def first_sentence(text: Column, claims: str, boilerplate: str, title: Column, least: int = 40) -> Column:
    """The first sentence over ``least`` characters with a claim, else the first that is not boilerplate, else the title."""
    parts = F.filter(F.split(squeeze(text), r"(?<=[.!?])\s+"), lambda s: s != "")
    claim = F.filter(parts, lambda s: (F.length(s) > least) & s.rlike(claims))
    first = F.get(parts, F.lit(0))
    return F.coalesce(F.get(claim, F.lit(0)), F.when(~first.rlike(boilerplate), first), title)


def mask_secrets(text: Column, most: int = 300) -> Column:
    """Keys and bearer tokens to placeholders, squeezed, cut."""
    out = F.regexp_replace(text, r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]")
    out = F.regexp_replace(out, r"(?i)(api[_-]?key|token|secret|password)(\s*[=:]\s*)[^\s&]+", "$1$2[redacted]")
    return F.substring(squeeze(out), 1, most)


def hash_id(size: int, *parts: Column, sep: str = "|") -> Column:
    """The first hex digits of a SHA-256 over joined parts; null parts are empty."""
    return F.substring(F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, size)


def pair_key(a: Column, b: Column, size: int = 24) -> Column:
    """A key that does not depend on the order of the two."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array(a, b)), "|"), 256), 1, size)


def clamp_score(x: Column) -> Column:
    """A number from 0 to 100, rounded; what is not a number is null."""
    n = x.try_cast("double")
    return F.when(n.isNotNull(), F.least(F.lit(100), F.greatest(F.lit(0), rounded(n)))).cast("int")


def cut(text: Column, most: int) -> Column:
    """Squeezed and cut."""
    return F.substring(squeeze(text), 1, most)


def inverted(words: Column) -> Column:
    """map<word, positions> of one row's words, without a shuffle; null stays null."""

    @F.pandas_udf("map<string, array<int>>")
    def index(lists: pd.Series) -> pd.Series:
        def one(words):
            at: dict[str, list[int]] = {}
            for p, w in enumerate(words):
                at.setdefault(w, []).append(p)
            return at

        return pd.Series([None if words is None else one(words) for words in lists], dtype=object)

    return index(words)


def rebuild(positions: Column) -> Column:
    """Words put back at their positions from map<word, positions>; gaps close, a later word wins a place."""
    pairs = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def english_list(names: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``."""
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", ")
    last = F.element_at(names, -1)
    return F.when(n == 0, "").when(n == 1, F.element_at(names, 1)).when(n == 2, F.array_join(names, " and ")).otherwise(F.concat(head, F.lit(", and "), last))
