"""Keyed tables: merges, action logs, retention, toggles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_queue(stored: DataFrame, new: DataFrame, key: str, value: str, locked: str, keep: int) -> DataFrame:
    """W1, ST6: new values replace stored ones unless those are locked; the ``keep`` largest values stay."""
    n = new.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    both = stored.join(n, F.col(key).eqNullSafe(F.col("_k")), "full_outer")
    merged = F.when(F.coalesce(F.col(locked), F.lit(False)) | F.col("_v").isNull(), F.col(value)).otherwise(F.col("_v"))
    rows = both.select(F.coalesce(key, "_k").alias(key), merged.alias(value), F.coalesce(locked, F.lit(False)).alias(locked))
    return rows.orderBy(F.desc(value), key).limit(keep)


def fold_actions(actions: DataFrame, key: str, action: str, order: Sequence[str], confirming: str) -> DataFrame:
    """The last action of each key, when it was last confirmed, and how many actions it had."""
    return actions.groupBy(key).agg(F.max_by(action, F.struct(*order)).alias("last_action"), F.max(F.when(F.col(action) == confirming, F.col(order[0]))).alias("confirmed_at"), F.count("*").alias("n_actions"))


def retain_runs(rows: DataFrame, run: str, order: Sequence[Column], runs: int, per_run: int) -> DataFrame:
    """The newest ``runs`` runs, the first ``per_run`` rows of each.

    The run names are few and are cut by a global top-k before the rows are read.
    """
    newest = rows.select(F.col(run).alias("_run")).distinct().orderBy(F.desc("_run")).limit(runs)
    kept = rows.join(F.broadcast(newest), F.col(run) == F.col("_run"), "left_semi")  # at most ``runs`` names
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(*order))).filter(F.col("_n") <= per_run).drop("_n")


def prune(rows: DataFrame, ts: str, as_of: Column, days: int, keep: int, tie: str) -> DataFrame:
    """Rows of the last days, the newest ``keep``; a missing time counts as now."""
    at = F.coalesce(F.col(ts), as_of)
    return rows.filter(at >= as_of - F.make_dt_interval(days=F.lit(days))).orderBy(at.desc(), tie).limit(keep)


def toggled(log: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Keys with an odd number of toggles, with the value of the last one."""
    return log.groupBy(*keys).agg(F.count("*").alias("_n"), F.max_by(value, F.struct(*order)).alias("last_id")).filter("_n % 2 = 1").drop("_n")
