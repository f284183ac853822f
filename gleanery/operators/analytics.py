"""Counts over groupings and preference vectors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped_counts(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Counts by ``first``, by ``second`` and in all, in one pass; ``level`` tells which."""
    counts = rows.groupingSets([[F.col(first)], [F.col(second)], []], F.col(first), F.col(second))
    return counts.agg(F.count("*").alias("n"), F.grouping_id(first, second).alias("level"))


def preferences(used: DataFrame, user: str, weight: str, fields: Mapping[str, Column], tags: str) -> DataFrame:
    """User, kind, key, weight: weighted sums by field and tag; tags ``ai-...`` say nothing and weigh 0.6.

    Weights are whole numbers (tenths, here times 10 or 6), so sums do not
    depend on their order.
    """
    pairs = [F.struct(F.lit(k).alias("kind"), v.cast("string").alias("key"), F.lit(10).alias("f")) for k, v in fields.items()]
    wanted = F.filter(F.transform(tags, F.lower), lambda t: ~F.startswith(t, F.lit("ai-")))
    tagged = F.transform(wanted, lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("key"), F.lit(6).alias("f")))
    rows = used.select(user, F.col(weight).alias("_w"), F.explode(F.concat(F.array(*pairs), tagged)).alias("p"))
    return rows.groupBy(user, "p.kind", "p.key").agg(F.sum(F.col("_w") * F.col("p.f")).cast("long").alias("weight"))


def boosts(items: DataFrame, prefs: DataFrame, id_col: str, fields: Mapping[str, tuple[Column, int]], tags: tuple[str, int], cap: int, among: DataFrame | None = None) -> DataFrame:
    """User, item, boost: weighted look-ups of an item's fields and tags in the preferences, capped; for all users, or for the (user, item) rows of ``among``."""
    pairs = [F.struct(F.lit(k).alias("kind"), v.cast("string").alias("key"), F.lit(f).alias("f")) for k, (v, f) in fields.items()]
    tagged = F.transform(tags[0], lambda t: F.struct(F.lit("tag").alias("kind"), F.lower(t).alias("key"), F.lit(tags[1]).alias("f")))
    keys = items.select(id_col, F.explode(F.concat(F.array(*pairs), tagged)).alias("p")).select(id_col, "p.*")
    user = next(c for c in prefs.columns if c not in ("kind", "key", "weight"))
    known = keys.join(prefs, ["kind", "key"]) if among is None else keys.join(among, id_col).join(prefs, [user, "kind", "key"])
    return known.groupBy(user, id_col).agg(F.least(F.lit(cap).cast("long"), F.sum(F.col("weight") * F.col("f"))).alias("boost"))
