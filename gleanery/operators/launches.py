"""Launch records: scores, qualification and enrichment eligibility."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.rules import cascade


def launch_scores(records: DataFrame) -> DataFrame:
    """P20: qualification (62 and bonuses, 100 at most) and confidence of each record."""
    c = F.col
    bonus = F.when(c("model").isNotNull(), 12).otherwise(0) + F.when(c("version").isNotNull(), 9).otherwise(0) + F.when(F.length("summary") > 100, 8).otherwise(0) + F.when(c("authority") >= 80, 10).otherwise(0)
    return records.withColumns({"qualification": F.least(F.lit(100), 62 + bonus), "confidence": F.when(c("model").isNotNull() & c("version").isNotNull(), 0.9).otherwise(0.76)})


def qualify(records: DataFrame, excluded: Column, minor: Column, evidence: Column) -> DataFrame:
    """The reason why a record is no launch, null if it is one."""
    return records.withColumn("reason", cascade((excluded, "excluded"), (minor, "minor"), (~evidence, "no-evidence"), (F.col("product").isNull(), "no-entity")))


def enrichment_skip(trusted: Column, sparse: Column, excluded: Column, entity: Column, first_party: Column) -> Column:
    """C11: why a record's page is not fetched, null if it is."""
    return cascade((~trusted, "untrusted-channel"), (~sparse, "rich-surface"), (excluded, "excluded"), (~entity, "no-entity"), (~first_party, "third-party"))


def with_pages(records: DataFrame, provider: Callable[[DataFrame], DataFrame], key: str, url: str) -> DataFrame:
    """Records with the responses that a provider of pages gives for them.

    The provider maps a table (key, url) of pages that are asked for to one of (key, columns
    of the response); a page that it does not return leaves nulls.
    """
    pages = provider(records.select(key, url).distinct())
    return records.join(pages.drop(url), key, "left")
