"""Evidence clusters: roll-up, recurrence and the gate that publishes them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.rules import cascade
from gleanery.operators.anchors import same

CLUSTER_DAYS, RECURRENCE_DAYS, PUBLISH_CAP = 14, 7, 4


def roll_up(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A1, A2: one row per cluster of evidence.

    last_seen_at is the update time of the row created last, not the latest
    update.  finding_type is the most frequent one; of equally frequent ones the
    one seen first.  Ties in time go by evidence_id.
    ``rows`` are read twice: store what is dear to compute.
    """
    seen, c = F.struct("created_at", "evidence_id"), F.col
    types = rows.groupBy(*keys, "finding_type").agg(
        F.count("*").alias("n"), F.min(seen).alias("since"), F.max(seen).alias("until"), F.max_by("updated_at", seen).alias("updated"), F.min_by("family", seen).alias("family"), F.bool_or("implication").alias("implication"), F.bool_or("artifact").alias("artifact"),
    )
    parts = types.groupBy(*keys).agg(
        F.sum("n").alias("n_evidence"), F.min("since.created_at").alias("first_seen_at"), F.max_by("updated", "until").alias("last_seen_at"), F.bool_or("implication").alias("implication"), F.bool_or("artifact").alias("artifact"),
        F.min_by("family", "since").alias("first_family"), F.min_by("finding_type", F.struct(-c("n"), "since")).alias("finding_type"),
    )
    # who and where: a narrow row for each value, equal ones combined before and after the shuffle
    who, where, family, none = c("author_id"), c("thread"), c("family"), lambda name: F.lit(None).cast(rows.schema[name].dataType)
    told = lambda a, t, f, allowed: F.struct(a.alias("author"), t.alias("thread"), f.alias("family"), allowed.alias("allowed"))
    allowed, no = F.coalesce(c("allowed"), F.lit(False)), F.lit(False)
    values = F.array(told(who, none("thread"), none("family"), allowed), told(none("author_id"), where, none("family"), no), told(none("author_id"), none("thread"), family, no))
    single = rows.select(*keys, F.inline(values)).groupBy(*keys, "author", "thread", "family").agg(F.bool_or("allowed").alias("allowed"))
    counts = single.groupBy(*keys).agg(F.count("author").alias("n_authors"), F.count("family").alias("n_families"), F.count("thread").alias("n_threads"), F.count(F.when(c("allowed"), c("author"))).alias("n_allowed_authors"))
    both = parts.alias("a").join(counts.alias("b"), same(keys, "a", "b")).select("a.*", *[f"b.{n}" for n in ("n_authors", "n_families", "n_threads", "n_allowed_authors")])
    return both.withColumn("confidence", F.when((c("n_authors") >= 3) & (c("n_families") >= 2), "high").otherwise("medium"))


def gate(findings: DataFrame, weak_types: Sequence[str] = ("BACKLASH", "EMERGING_TOOL"), lone_family: str = "hn", no_topic: str = "other") -> DataFrame:
    """Status and reason of each cluster, by ordered rules."""
    c = F.col
    lone = c("n_evidence") == 1
    spread = (c("n_families") >= 2) | (c("n_allowed_authors") >= 3)
    recurs = (F.unix_micros("last_seen_at") - F.unix_micros("first_seen_at") >= RECURRENCE_DAYS * 86_400_000_000) | (c("n_threads") >= 2)
    reason = cascade(
        (c("finding_type").isin(*weak_types), "insufficient-evidence"),
        (c("topic").isNull() | c("topic").isin("", no_topic) | ~c("implication"), "no-product-implication"),
        (lone & (c("first_family") == lone_family), "single-source"),
        (~c("artifact"), "no-concrete-artifact"),
        (~spread, "insufficient-authors"),
        (~recurs, "insufficient-recurrence"),
    )
    status = F.when(reason.isNull(), "PUBLISH").when(reason.isin("no-product-implication", "no-concrete-artifact"), "REVIEW_QUEUE").otherwise("WATCH")
    return findings.withColumns({"reason": reason, "status": status})


def publish_findings(evidence: DataFrame, cap: int = PUBLISH_CAP, days: float = CLUSTER_DAYS, feed: Sequence[str] = ("product",)) -> DataFrame:
    """E3 core: anchored windows, roll-up, gate, and the cap per feed."""
    from gleanery.operators.windows import anchored_windows, publish_cap

    placed = anchored_windows(evidence, ["product", "topic"], "created_at", days)
    findings = gate(roll_up(placed, ["product", "topic", "window_start"]))
    return publish_cap(findings, feed, [F.col("last_seen_at").desc(), F.col("topic"), F.col("window_start")], cap)


def evidence_window(ts: Column, as_of: Column, days: float, future: bool = False) -> Column:
    """Whether a time lies in the days before ``as_of``; ``future`` also admits later ones.  Null is outside."""
    age = F.unix_micros(as_of) - F.unix_micros(ts)
    inside = (age <= int(days * 86_400_000_000)) & (F.lit(True) if future else age >= 0)
    return F.coalesce(inside, F.lit(False))


def near(a: Column, b: Column, days: float) -> Column:
    """Whether two times are at most ``days`` apart, either way."""
    return F.coalesce(F.abs(F.unix_micros(a) - F.unix_micros(b)) <= int(days * 86_400_000_000), F.lit(False))
