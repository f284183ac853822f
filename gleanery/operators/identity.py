"""Whom an item is from and what it is about, by its role; keys of organisations and families; labels of codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import lexicons
from gleanery.functions.rules import Rule, ascii_edges, classify_first

def filled(column: Column) -> Column:
    """Null where a string is empty."""
    return F.nullif(column, F.lit(""))


def author_head(author: Column) -> Column:
    """The first of the names that commas part, null if it is blank."""
    return filled(F.trim(F.split_part(author, F.lit(","), F.lit(1))))


def naming_tag(tags: Column, plain: Sequence[str] = lexicons.PLAIN_TAGS, prefix: str = lexicons.PLAIN_TAG_PREFIX) -> Column:
    """The first tag that may name a product."""
    return F.get(F.filter(tags, lambda t: ~t.isin(list(plain)) & ~F.startswith(t, F.lit(prefix))), F.lit(0))


def organization(role: Column, id_: Column, source: Column, author: Column, tags: Column, paper: Column) -> Column:
    """Who stands behind an item.

    Launches and background go by their source; community items by the author's
    first name, else a tag that names a product, else ``community``; papers by
    their paper id, else the first author, else their own id.
    """
    adopted = F.coalesce(author_head(author), filled(naming_tag(tags)), F.lit("community"))
    written = F.coalesce(filled(paper), author_head(author), id_)
    return F.when(role == "ADOPTION", F.lower(adopted)).when(role == "CAPABILITY", F.lower(written)).otherwise(source)


def topic(
    role: Column, title: Column, summary: Column, subtitle: Column, tags: Column, model: Column, product: Column, cue: Column,
    models: str = lexicons.LAUNCH_MODELS, tagged: Sequence[str] = lexicons.TAGGED_TOPICS, adoption: Sequence[Rule] = lexicons.ADOPTION_TOPICS, papers: Sequence[Rule] = lexicons.PAPER_TOPICS,
) -> Column:
    """What an item is about.

    A launch is about its model or product, else a model that the text names,
    else ``launch``; a community item about a topic among its tags, else a rule's,
    else ``adoption``; all others about a rule's topic, else their cue, else ``paper``.
    """
    said = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")), F.coalesce(subtitle, F.lit(""))))
    known = F.regexp_replace(F.lower(F.coalesce(filled(model), filled(product))), "[^a-z0-9]+", "-")
    launched = F.coalesce(known, filled(F.regexp_extract(said, "(?i)" + ascii_edges(models), 1)), F.lit("launch"))
    by_tag = F.get(F.filter(F.array(*[F.lit(t) for t in tagged]), lambda t: F.array_contains(tags, t)), F.lit(0))
    adopted = F.coalesce(by_tag, classify_first(said, adoption, "adoption"))
    written = F.coalesce(F.nullif(classify_first(said, papers, ""), F.lit("")), F.lower(filled(cue)), F.lit("paper"))
    return F.when(role == "SUPPLY", launched).when(role == "ADOPTION", adopted).otherwise(written)


def organization_key(organization_id: Column, organization_: Column, source: Column) -> Column:
    """The first name that is given, in lower case with hyphens for all but letters and digits; ``unknown`` without any."""
    raw = F.coalesce(filled(organization_id), filled(organization_), filled(source), F.lit("unknown"))
    return F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "-"), "^-|-$", "")


def product_family(role: Column, products: Column, title: Column, key: Column) -> Column:
    """Of community items the first known product, else a prefix of the title before a colon; of all others their organisation."""
    named = F.get(F.filter(products, lambda p: p.isNotNull() & ~p.isin("", "unknown")), F.lit(0))
    prefix = filled(F.regexp_extract(title, "^([A-Za-z0-9-]+):", 1))
    return F.when(role == "ADOPTION", F.coalesce(F.lower(named), F.lower(prefix), key)).otherwise(key)


def label(code: Column, labels: Mapping[str, str], default: str | None = None) -> Column:
    """The label of a code; ``default`` (or null) for codes that have none, and for null."""
    out = F
    for key, value in labels.items():
        out = out.when(code == key, value)
    return out.otherwise(F.lit(default))


def value_cue(role: Column) -> Column:
    """What an item of this role is worth to a reader, null for background."""
    return label(role, lexicons.VALUE_CUES)


def evidence_role(role: Column) -> Column:
    """The label of evidence of this role."""
    return label(role, lexicons.EVIDENCE_ROLES, lexicons.OTHER_EVIDENCE_ROLE)


def reason_status(reason: Column) -> Column:
    """The status that a reason stands for."""
    return label(reason, lexicons.REASON_STATUSES, lexicons.OTHER_REASON_STATUS)


def source_group(source: Column, groups: Mapping[str, Sequence[str]] = lexicons.SOURCE_GROUPS, default: str = lexicons.OTHER_SOURCE_GROUP) -> Column:
    """The group of a source."""
    return label(source, {s: g for g, names in groups.items() for s in names}, default)
