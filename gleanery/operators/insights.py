"""Cross-source insights: evidence joined to capability groups, routed by ordered rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(evidence: DataFrame, groups: DataFrame) -> DataFrame:
    """Evidence of each group, many to many; a group stays if all its required keys occur.

    ``groups`` is a rule table of a few rows (group_id, keys, required, role), so it
    is broadcast by its key: evidence is exploded by capability key and meets
    the groups in an equi-join, not in a product.
    """
    rules = groups.select("group_id", F.explode("keys").alias("_key"), "required", F.col("role").alias("_role"))
    hits = evidence.withColumn("_key", F.explode(F.array_distinct("capability_keys"))).join(rules, "_key")
    members = hits.filter(F.col("_role").isNull() | (F.col("_role") == F.col("role"))).drop("_key", "_role").dropDuplicates(["group_id", "object_id"])
    held = members.select("group_id", "required", F.explode("capability_keys").alias("key")).filter(F.array_contains("required", F.col("key"))).groupBy("group_id").agg(F.count_distinct("key").alias("n"), F.first(F.size(F.array_distinct("required"))).alias("need"))
    return members.join(held.filter("n = need").select("group_id"), "group_id").drop("required")


def cluster_facts(members: DataFrame, friction_keys: list[str]) -> DataFrame:
    """A4: one row of aggregates per group."""
    c = F.col
    rough = (c("finding_type") == "FRICTION") | F.arrays_overlap("capability_keys", F.array(*[F.lit(k) for k in friction_keys]))
    rough = F.coalesce(rough, F.lit(False))
    is_ = lambda r: F.bool_or(c("role") == r)
    return members.groupBy("group_id").agg(
        F.count_distinct("object_id").alias("n_members"), F.count_distinct(F.when(c("role") == "ADOPTION", c("product_family")).otherwise(c("organization"))).alias("n_independent"),
        is_("SUPPLY").alias("supply"), is_("CAPABILITY").alias("capability"), is_("ADOPTION").alias("adoption"), F.bool_or("current").alias("current"), F.bool_or((c("role") == "ADOPTION") & rough).alias("friction"),
        F.bool_and(rough).alias("all_friction"), F.bool_or("hidden").alias("hidden"), F.max("updated_at").alias("updated_at"),
    )


def route(facts: DataFrame) -> DataFrame:
    """C14: status, confidence and reason of each group, by ordered rules."""
    c = F.col
    ready = (c("supply") | c("capability")) & c("adoption") & c("friction")
    one_role = c("supply").cast("int") + c("capability").cast("int") + c("adoption").cast("int") == 1
    rules = [
        (c("n_members") < 2, "NOT_INSIGHT", "LOW", "one-item"),
        (one_role & c("supply") & (c("n_independent") == 1), "NOT_INSIGHT", "LOW", "same-org-supply"),
        (c("n_independent") < 2, "WATCH", "LOW", "one-family"),
        (~c("current"), "WATCH", "LOW", "aging"),
        (c("supply") & c("capability") & ~c("adoption"), "WATCH", "MEDIUM", "supply-capability-no-adoption"),
        (one_role & c("supply") & (c("n_independent") >= 4), "PUBLISH", "HIGH", "convergence"),
        (one_role & c("supply") & (c("n_independent") >= 3), "PUBLISH", "MEDIUM", "convergence"),
        (one_role & c("supply"), "WATCH", "LOW", "supply-under-three-orgs"),
        (one_role & c("adoption") & c("all_friction"), "PUBLISH", "MEDIUM", "friction-pattern"),
        (one_role & c("adoption"), "WATCH", "LOW", "adoption-incomplete"),
        (one_role & c("capability"), "NOT_INSIGHT", "LOW", "papers-only"),
        (c("adoption") & ((c("n_independent") >= 3) | ready), "PUBLISH", "HIGH", "cross-role"),
        (c("adoption") & c("hidden"), "PUBLISH", "LOW", "cross-role"),
        (c("adoption"), "PUBLISH", "MEDIUM", "cross-role"),
    ]
    decision = F
    for condition, status, confidence, reason in rules:
        decision = decision.when(condition, F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason")))
    decision = decision.otherwise(F.struct(F.lit("WATCH").alias("status"), F.lit("LOW").alias("confidence"), F.lit("incomplete").alias("reason")))
    return facts.withColumns({"_d": decision, "contradiction_ready": ready}).select("*", "_d.*").drop("_d")


def suppress_overlap(routed: DataFrame, weaker: str, stronger: str) -> DataFrame:
    """The weaker group yields if the stronger one is published."""
    winner = routed.filter((F.col("group_id") == stronger) & (F.col("status") == "PUBLISH")).select(F.lit(weaker).alias("_weak"))
    out = routed.join(winner, F.col("group_id") == F.col("_weak"), "left")
    yields = F.col("_weak").isNotNull()
    return out.withColumns({"status": F.when(yields, "WATCH").otherwise(F.col("status")), "reason": F.when(yields, "overlap").otherwise(F.col("reason"))}).drop("_weak")


def ungrounded(insights: DataFrame, names: list[str], thesis: str = "thesis", allowed: str = "tokens") -> DataFrame:
    """Known names in a thesis that no token of its members covers."""
    low = F.lower(thesis)
    named = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(low, n))
    return insights.withColumn("violations", F.array_except(named, F.col(allowed)))
