"""Windows over time: start-anchored, epoch-aligned, caps, streaks and neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.anchors import FOLD_TIMES, lookup, start_rows

DAY = 86_400_000_000  # microseconds


def window_starts(rows: DataFrame, keys: Sequence[str], ts: Column, width: int, closed: bool) -> DataFrame:
    """keys, _starts: the ascending starts of the windows of each key, in microseconds."""
    return start_rows(rows, keys, ts, width, closed).groupBy(*keys).agg(F.array_sort(F.collect_list("_start")).alias("_starts"))


def anchored_windows(rows: DataFrame, keys: Sequence[str], ts: str, days: float, most: int = FOLD_TIMES) -> DataFrame:
    """G1: ``window_start`` for each row: rows join while t - start <= width, a later one opens a new window.

    Only the distinct times of a key are moved to find the starts; each row then
    looks its own up.  Null times get null.  A key with over ``most`` distinct
    times is worked on by many tasks.
    """
    at, width = F.col(ts).cast("timestamp"), int(days * DAY)
    found = lookup(rows, keys, F.unix_micros(at), start_rows(rows, keys, at, width, True, most), width + 1)
    return found.withColumn("window_start", F.timestamp_micros("_start")).drop("_start")


def epoch_bucket(ts: Column, days: int) -> Column:
    """The number of the epoch-aligned bucket."""
    return F.floor(F.unix_millis(ts.cast("timestamp")) / F.lit(days * 86_400_000)).cast("long")


def publish_cap(rows: DataFrame, feed: Sequence[str], order: Sequence[Column], cap: int, status: str = "status", reason: str = "reason", published: str = "PUBLISH", overflow: str = "WATCH") -> DataFrame:
    """The first ``cap`` published rows of a feed stay, the rest become ``overflow`` with reason ``capped``.

    The cut is found among the first rows only (a limited window), and
    everything else is left as it is.
    """
    w = Window.partitionBy(*feed, F.col(status) == published).orderBy(*order)
    ranked = rows.withColumn("_place", F.row_number().over(w))
    over = (F.col(status) == published) & (F.col("_place") > cap)
    return ranked.withColumns({reason: F.when(over, "capped").otherwise(F.col(reason)), status: F.when(over, overflow).otherwise(F.col(status))}).drop("_place")


def first_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_place") <= n).drop("_place")


def running_cap(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], counts: Column, cap: int) -> DataFrame:
    """Rows before which fewer than ``cap`` rows with ``counts`` stand in their group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_n", F.coalesce(F.sum(counts.cast("int")).over(w), F.lit(0))).filter(F.col("_n") < cap).drop("_n")


def streaks(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """``same_as_before`` and ``streak``, the length of the run of equal values up to the row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(w)
    out = rows.withColumn("same_as_before", F.coalesce(before.eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), F.lit(False)))
    out = out.withColumn("_island", F.sum((~F.col("same_as_before")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.withColumn("streak", F.row_number().over(Window.partitionBy(*keys, "_island").orderBy(*order))).drop("_island")


def preference_bump(rows: DataFrame, keys: Sequence[str], pos: str, cls: str, org: str, preferred: str) -> DataFrame:
    """In each feed the first preferred row may pass the row before it.

    Only within one class, past a row that is not preferred, and if no two
    neighbours come to share an organisation.  Returns the rows with ``seat``.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    out = rows.withColumns({"_c": F.lag(cls).over(w), "_p": F.lag(preferred).over(w), "_o": F.lag(org).over(w), "_oo": F.lag(org, 2).over(w), "_on": F.lead(org).over(w)})
    apart = (F.col("_oo").isNull() | (F.col("_oo") != F.col(org))) & (F.col("_on").isNull() | (F.col("_on") != F.col("_o")))
    can = F.col(preferred) & (F.col("_c") == F.col(cls)) & ~F.col("_p") & apart
    out = out.withColumn("_swap", F.min(F.when(can, F.col(pos))).over(Window.partitionBy(*keys)))
    seat = F.when(F.col(pos) == F.col("_swap"), F.col(pos) - 1).when(F.col(pos) == F.col("_swap") - 1, F.col(pos) + 1).otherwise(F.col(pos))
    return out.withColumn("seat", seat).drop("_c", "_p", "_o", "_oo", "_on", "_swap")
