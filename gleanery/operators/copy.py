"""Copy of insights: templates with slots filled from each group's members, checked for direction and grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.names import names_in, uncovered

TEMPLATE = "group_id string, place int, needs array<string>, lacks array<string>, least_supply int, type string, headline string, thesis string, why string, implication string, verb string"
TEXTS = ("headline", "thesis", "why", "implication")
SLOTS = ("supply", "capability", "families", "all")
# Words by which a thesis says where things go.
DIRECTION = r"\b(becoming|shifting|failing|blocking|breaking|shipping|drop(?:ping)?|expected|converging|remain(?:ing)?|positioned|faster than|default|changing)\b"
ANY = "*"


def english_list(names: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``; empty for none."""
    n = F.size(names)
    most = F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.when(n > 2, ", and ").otherwise(" and "), F.element_at(names, -1))
    return F.when(n == 0, "").when(n == 1, F.element_at(names, 1)).otherwise(most)


def slots(members: DataFrame) -> DataFrame:
    """group_id and, per slot, the distinct names in order: organisations by role, families of adoption, all organisations.

    Names are made distinct before they meet in a group, so a group with many members costs what its names do.
    """
    c = F.col
    named = F.array(
        F.struct(F.when(c("role") == "SUPPLY", "supply").when(c("role") == "CAPABILITY", "capability").alias("slot"), c("organization").alias("name")),
        F.struct(F.when(c("role") == "ADOPTION", "families").alias("slot"), c("product_family").alias("name")),
        F.struct(F.lit("all").alias("slot"), c("organization").alias("name")),
    )
    rows = members.select("group_id", "role", F.inline(named)).filter("slot is not null").distinct()
    listed = [F.array_sort(F.collect_set(F.when((c("slot") == s) & (c("name") != ""), c("name")))).alias(s) for s in SLOTS]
    return rows.groupBy("group_id").agg(*listed, F.collect_set("role").alias("roles"))


def filled(text: Column, row: dict[str, Column]) -> Column:
    """``{slot}`` becomes the slot's names as a list, ``{slot?one|many}`` a word that agrees with their number."""
    for s, names in row.items():
        text = F.regexp_replace(text, F.lit(rf"\{{{s}\?([^|}}]*)\|([^}}]*)\}}"), F.when(F.size(names) == 1, F.lit("$1")).otherwise(F.lit("$2")))
        text = F.replace(text, F.lit(f"{{{s}}}"), english_list(names))
    return text


def synthesize(members: DataFrame, templates: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """group_id, type, headline, thesis, why, implication, verb, violations of each group that a template fits.

    A group takes the template of the least ``place`` among its own and the
    general ones (null ``group_id``) whose ``needs`` it has, whose ``lacks`` it has not,
    and whose ``least_supply`` organisations supply it.  A thesis without a
    direction gives no row.  ``violations`` are the ``known`` names in a thesis that no
    organisation or family of the group covers (C21): publish where it is empty.
    """
    c = F.col
    groups = slots(members).withColumn("_key", F.explode(F.array(c("group_id"), F.lit(ANY))))
    offered = templates.withColumnRenamed("group_id", "_of").withColumn("_key", F.coalesce("_of", F.lit(ANY)))
    fits = (F.size(F.array_except("needs", "roles")) == 0) & ~F.arrays_overlap("lacks", "roles") & (F.size("supply") >= F.coalesce("least_supply", F.lit(0)))
    fields = ["place", "type", *TEXTS, "verb"]
    chosen = groups.join(offered, "_key").filter(F.coalesce(fits, F.lit(False))).groupBy("group_id").agg(F.min(F.struct(*fields)).alias("t"), *[F.first(s).alias(s) for s in SLOTS])
    row = {s: c(s) for s in SLOTS}
    out = chosen.select("group_id", "t.type", *[filled(c(f"t.{x}"), row).alias(x) for x in TEXTS], "t.verb", F.transform(F.array_union("all", "families"), lambda n: F.lower(n)).alias("_cover"))
    out = out.filter(c("thesis").rlike(f"(?i){DIRECTION}"))
    if known is None:
        return out.withColumn("violations", F.array().cast("array<string>")).drop("_cover")
    found = names_in(out.withColumn("_low", F.lower("thesis")), "_low", known.select(F.lower("name").alias("name")), out="_names")
    return found.withColumn("violations", F.array_sort(uncovered("_names", "_cover"))).drop("_names", "_low", "_cover")
