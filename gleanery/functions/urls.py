"""URL and identifier normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source")  # fixed values


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def canonical_url(url: Column) -> Column:
    """No fragment and tracking parameters, lower host without www., no doubled or last slash, sorted query.

    What is not a URL with a host is only trimmed.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    name = F.regexp_replace(host(url), r"^www\.", "")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/{2,}", "/"), r"/$", "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    key = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    wanted = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(key(p), F.lit("utm_")) & ~key(p).isin(*TRACKING))
    query = F.array_join(F.array_sort(wanted), "&")
    out = F.concat(scheme, F.lit("://"), name, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host(url) == "", F.trim(url)).otherwise(out)


def identity_url(url: Column) -> Column:
    """P5: the canonical URL and the lower-cased fragment."""
    fragment = F.lower(F.regexp_extract(url, r"#(.*)$", 1))
    return F.concat(canonical_url(url), F.when(fragment == "", "").otherwise(F.concat(F.lit("#"), fragment)))


def registrable_host(url: Column) -> Column:
    """The last two labels of the host."""
    return F.array_join(F.slice(F.split(host(url), r"\."), F.greatest(F.lit(1), F.size(F.split(host(url), r"\.")) - 1), 2), ".")


def same_site(a: Column, b: Column) -> Column:
    """Whether two URLs share their registrable host."""
    return (registrable_host(a) == registrable_host(b)) & (host(a) != "")


def arxiv_id(raw: Column) -> Column:
    """An arXiv id without URL, prefix, query and version."""
    text = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^https?://arxiv\.org/abs/", ""), r"(?i)^arxiv:", "")
    return F.regexp_replace(F.regexp_extract(text, r"^([^?#]*)", 1), r"(?i)v\d+$", "")


def doi(raw: Column) -> Column:
    """A DOI without its resolver, lower case; empty is null."""
    return F.nullif(F.lower(F.regexp_replace(F.trim(raw), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", "")), F.lit(""))
