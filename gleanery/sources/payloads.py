"""Landed JSON payloads to rows; what does not parse gives no rows, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import rebuild
from gleanery.operators.dedupe import keep_first, keep_last


def json_rows(payloads: DataFrame, body: str, element: str, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The elements (a DDL struct) of a JSON array, at the top or under ``path``, with their ``pos``."""
    schema = f"array<struct<{element}>>" if path is None else f"struct<{path}: array<struct<{element}>>>"
    parsed = F.from_json(body, schema)
    return payloads.select(*keep, F.posexplode(parsed if path is None else parsed[path]).alias("pos", "_e")).select(*keep, "pos", "_e.*")


def author_names(raw: Column) -> Column:
    """Names from a JSON array whose elements are strings or objects with a ``name``."""
    each = F.from_json(raw, "array<string>")  # objects come as their JSON text
    name = lambda a: F.coalesce(F.get_json_object(a, "$.name"), F.when(~F.startswith(a, F.lit("{")), a))
    return F.filter(F.transform(each, lambda a: F.nullif(F.trim(name(a)), F.lit(""))), lambda a: a.isNotNull())


def captured_papers(payloads: DataFrame, body: str, day: str) -> DataFrame:
    """Daily papers, the last row of each id by day and position."""
    rows = json_rows(payloads, body, "paper struct<id: string, title: string, summary: string, upvotes: long, authors: string>", keep=(day,))
    rows = rows.select(day, "pos", F.col("paper.id").alias("paper_id"), F.col("paper.title").alias("title"), F.col("paper.summary").alias("abstract"), F.col("paper.upvotes").alias("upvotes"), author_names(F.col("paper.authors")).alias("authors"))
    return keep_last(rows.filter("paper_id is not null"), ["paper_id"], F.struct(day, "pos"))


def works(payloads: DataFrame, body: str) -> DataFrame:
    """Works with the abstract put together from its inverted index."""
    rows = json_rows(payloads, body, "id string, title string, abstract_inverted_index map<string, array<int>>", "results")
    return rows.select("id", "title", rebuild(F.col("abstract_inverted_index")).alias("abstract"))


def repositories(payloads: DataFrame, body: str, least_stars: int, most: int) -> DataFrame:
    """Repositories with enough stars, once each, the first ``most`` by stars."""
    rows = json_rows(payloads, body, "id long, full_name string, stargazers_count long", "items")
    rows = keep_first(rows.filter(F.col("stargazers_count") >= least_stars), ["id"], [F.desc("stargazers_count"), F.col("full_name")])
    return rows.select("id", "full_name", "stargazers_count").orderBy(F.desc("stargazers_count"), "id").limit(most)


def issues(payloads: DataFrame, body: str, reject: Column) -> DataFrame:
    """Every issue or story with the reason of its rejection, null for evidence."""
    rows = json_rows(payloads, body, "id string, title string, author string, comments long, created_at timestamp, pull_request string", "items")
    return rows.withColumn("reject", F.coalesce(F.when(F.col("pull_request").isNotNull(), "pull-request"), F.when(F.col("author").isNull(), "bot"), reject))
