"""Published rows as feed items of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import rounded, slug_id

FIELDS = ("id", "title", "summary", "source", "category", "tags", "subtitle", "published_at")
DAY = 86_400_000_000  # microseconds


def span_days(first: Column, last: Column) -> Column:
    """Whole days between two times, rounded, one at least."""
    return F.greatest(F.lit(1), rounded((F.unix_micros(last) - F.unix_micros(first)) / DAY)).cast("int")


def launch_items(events: DataFrame) -> DataFrame:
    """Launch events; the trend weighs novelty with 0.7 and confidence with 0.3."""
    c = F.col
    known = c("model").isNotNull() & c("version").isNotNull()
    trend = F.least(F.lit(100.0), c("novelty_score") * 0.7 + F.when(known, 0.9).otherwise(0.76) * 30)
    return events.select(
        c("event_id").alias("id"), "title", F.concat_ws(" ", "product", "model", "version").alias("summary"), c("org").alias("source"), F.when(c("model").isNotNull(), "Model Releases").otherwise("AI Products").alias("category"),
        F.concat_ws(",", F.lit("live"), F.lit("official-launch"), "org").alias("tags"), F.when(c("n_sources") > 1, F.concat(c("n_sources").cast("string"), F.lit(" official sources"))).otherwise(F.concat("org", F.lit(" · Official"))).alias("subtitle"),
        "published_at", c("impact_score").alias("impact"), rounded(trend).cast("int").alias("trend"),
    )


def byline(authors: Column, institution: Column) -> Column:
    """The institution, or else up to three authors."""
    names = F.array_join(F.slice(authors, 1, 3), ", ")
    return F.coalesce(institution, F.when(F.size(authors) > 3, F.concat(names, F.lit(" et al."))).when(F.size(authors) > 0, names))


def paper_items(papers: DataFrame) -> DataFrame:
    """Papers with key, title, finding, source, cue, byline and published_at."""
    c = F.col
    return papers.select(
        slug_id("paper", c("key")).alias("id"), "title", c("finding").alias("summary"), "source", F.lit("Research Papers").alias("category"), F.concat_ws(",", F.lit("live"), F.lit("research-paper"), "lang").alias("tags"),
        F.concat_ws(" · ", "byline", F.coalesce("cue", "lang")).alias("subtitle"), "published_at",
    )


def finding_items(findings: DataFrame) -> DataFrame:
    """Community findings, named by what recurs where."""
    c = F.col
    days = span_days(c("first_seen_at"), c("last_seen_at"))
    size = F.format_string("%d evidence · %dd", "n_evidence", days)
    kind = F.lower(F.replace("finding_type", F.lit("_"), F.lit("-")))
    key = F.concat_ws(" ", "product", "topic", F.date_format("window_start", "yyyyMMdd"))
    title = F.concat_ws(" ", kind, F.lit("around"), "topic", F.lit("in"), "product")
    return findings.select(
        slug_id("dc", key).alias("id"), title.alias("title"), F.concat_ws(" · ", title, size).alias("summary"), F.lit("Developer Community").alias("source"), F.lit("Industry Trends").alias("category"),
        F.concat_ws(",", F.lit("live"), F.lit("developer-community"), kind, F.concat(F.lit("evidence:"), c("n_evidence").cast("string"))).alias("tags"), F.concat_ws(" · ", "finding_type", size).alias("subtitle"), c("last_seen_at").alias("published_at"),
    )


def union_branches(branches: dict[str, DataFrame | Exception]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """U-all: the union of the branches that were read, with ``branch``, and (branch, error) of those that could not be."""
    rows, errors = None, []
    for name, branch in branches.items():
        if isinstance(branch, Exception):
            errors.append((name, type(branch).__name__))
            continue
        named = branch.withColumn("branch", F.lit(name))
        rows = named if rows is None else rows.unionByName(named, allowMissingColumns=True)
    if rows is None:
        raise ValueError("no branch could be read")
    return rows, errors
