"""Paper gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.rules import cascade


def taxonomy_capture(user_facing: Column, background: Column, ai_context: Column, hci_venue: Column) -> tuple[Column, Column]:
    """Whether a paper is captured, and if not, why."""
    capture = ai_context & (user_facing | hci_venue)
    return capture, F.when(capture, None).when(background, "background-only").otherwise("taxonomy-mismatch")


def paper_gate(papers: DataFrame, theory: Column, users: Column, infra: Column, incremental: Column, cue: Column, implication: Column) -> DataFrame:
    """Publish, pass_candidate, reason and cue, by the ordered rules R1 to R6."""
    c = F.col
    # the flags scan whole texts: they are computed once, in a projection of their own
    flags = papers.withColumns({"_theory": theory & ~users, "_infra": infra, "_incremental": incremental, "_cue": cue, "_implication": implication})
    none = c("_cue").isNull()
    reason = cascade((c("_theory"), "r1-theory"), (c("_infra") & none, "r2-infra"), (c("_incremental") & none, "r3-incremental"), (none | ~c("_implication"), "r6-else"))
    rows = flags.withColumn("reason", reason).drop("_theory", "_infra", "_incremental", "_implication")
    named = F.col("reason").isNull() | (F.col("reason") == "r6-else")
    return rows.withColumns({"publish": F.col("reason").isNull(), "pass_candidate": named & F.col("_cue").isNotNull(), "cue": F.when(named, F.col("_cue"))}).drop("_cue")
