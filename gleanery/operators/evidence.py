"""Filters on who wrote a piece of evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.rules import found

# Names of automated authors.
BOTS = r"(\[bot\]$|github-actions|dependabot|copilot|openhands|swe-agent|cursor-agent|claude-code-action)"


def is_bot(login: Column, kind: Column, names: str = BOTS, bot_kind: str = "Bot") -> Column:
    """C4: whether the author is automated; a missing author is."""
    return F.coalesce(login, F.lit("")).isin("") | F.coalesce(kind == bot_kind, F.lit(False)) | found(login, names)
