"""Dedupe: greedy over several keys, by one key, and against recent rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.storage import stored


def greedy_dedupe(rows: DataFrame, id_col: str, order: Sequence[Column], keys: Sequence[Column], most_rounds: int | None = None) -> DataFrame:
    """Id, kept, target_id, hit_key: rows in order are kept unless a kept row before shares a key.

    The lexicographically first independent set, not connected components:
    with A-B and B-C sharing keys, A and C are both kept.  In each round a row
    that is first on all its keys is kept, and rows that share a key with a kept
    row are dropped; both are aggregations by key, so no pairs arise.  Null keys
    are no keys.  ``order`` has to be total; its columns must be fixed ascending.
    target_id is the kept row at the first key that hits one.  Every round decides
    the first open row at least, so the rounds end; an error tells if
    ``most_rounds`` are not enough.
    """
    ord_ = F.struct(*order)
    listed = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), k.cast("string").alias("key")) for i, k in enumerate(keys)]), lambda x: x["key"].isNotNull())
    base = rows.select(F.col(id_col).alias("id"), ord_.alias("ord"), listed.alias("keys"))
    if len(keys) == 1:  # the first of each key is kept: no rounds
        one = rows.select(F.col(id_col).alias("id"), ord_.alias("ord"), keys[0].cast("string").alias("hit_key"))
        first = one.filter("hit_key is not null").groupBy(F.col("hit_key").alias("of")).agg(F.min_by("id", "ord").alias("winner"))
        won = F.col("winner").isNull() | (F.col("winner") == F.col("id"))
        return one.join(first, F.col("hit_key") == F.col("of"), "left").select("id", won.alias("kept"), F.when(~won, F.col("winner")).alias("target_id"), F.when(~won, F.col("hit_key")).alias("hit_key"))
    open_rows = stored(base, "round")
    done = open_rows.filter(F.size("keys") == 0).select("id", F.lit(True).alias("kept"), F.lit(None).cast(rows.schema[id_col].dataType).alias("target_id"), F.lit(None).cast("string").alias("hit_key"))
    open_rows = open_rows.filter(F.size("keys") > 0)
    for done_rounds in count():
        if open_rows.isEmpty():
            break
        if done_rounds == most_rounds:
            raise RuntimeError(f"rows are still open after {most_rounds} rounds")
        exploded = open_rows.select("id", "ord", F.explode("keys").alias("k")).select("id", "ord", "k.i", "k.key")
        firsts = exploded.groupBy("key").agg(F.min("ord").alias("first"))
        led = exploded.join(firsts, "key").groupBy("id").agg(F.bool_and(F.col("ord") == F.col("first")).alias("leads"))
        winners = open_rows.join(led.filter("leads").select("id"), "id", "left_semi")
        winner_keys = winners.select(F.explode("keys").alias("k"), F.col("id").alias("winner"), F.col("ord").alias("winner_ord")).select(F.col("k.key").alias("key"), "winner")
        hits = exploded.join(winner_keys, "key").filter(F.col("id") != F.col("winner")).groupBy("id").agg(F.min(F.struct("i", "winner", "key")).alias("hit"))
        won = winners.select("id", F.lit(True).alias("won"))
        now = open_rows.join(hits, "id", "left").join(won, "id", "left")
        now = stored(now.select("id", "ord", "keys", F.when(F.col("won"), True).when(F.col("hit").isNotNull(), False).alias("kept"), F.when(F.col("won").isNull(), F.col("hit.winner")).alias("target_id"), F.when(F.col("won").isNull(), F.col("hit.key")).alias("hit_key")), "round")
        done = done.unionByName(now.filter("kept is not null").select(*done.columns))
        if done_rounds % 50 == 49:
            done = stored(done, "done")  # a union of many tables is slow to plan
        open_rows = now.filter("kept is null").select("id", "ord", "keys")
    return done


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """D3: the first row of each key by an explicit order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def keep_last(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The whole last row of each key, by aggregation."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def capped_accept(rows: DataFrame, group: str, id_col: str, order: Sequence[Column], keys: Sequence[Column], reject: Column, cap: int) -> DataFrame:
    """Id, outcome of each row up to the cap: a reject reason, ``duplicate`` or ``accepted``; what follows the last accepted row is not reported.

    With one key a row is accepted if it is the first of its group and key, so one shuffle by group does all.
    """
    if len(keys) == 1:
        named = rows.repartition(group).withColumn("_reject", reject).withColumn("_key", F.when(F.col("_reject").isNull(), keys[0].cast("string")))
        at = F.xxhash64(group, "_key")  # sorted by first, so that few rows compare their keys
        first = F.row_number().over(Window.partitionBy(at, group, "_key").orderBy(*order)) == 1
        outcome = F.coalesce(F.col("_reject"), F.when(F.col("_key").isNull() | first, "accepted").otherwise("duplicate"))
        before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        counted = named.withColumn("outcome", outcome).drop("_key").withColumn("_n", F.coalesce(F.sum((F.col("outcome") == "accepted").cast("int")).over(before), F.lit(0)))
        return counted.filter(F.col("_n") < cap).select(*rows.columns, "outcome")
    named = rows.withColumn("_reject", reject)
    inside = named.filter(F.col("_reject").isNull())
    scoped = [F.when(k.isNotNull(), F.concat_ws("|", F.col(group).cast("string"), F.lit(str(i)), k.cast("string"))) for i, k in enumerate(keys)]
    decided = greedy_dedupe(inside, id_col, [F.col(group), *order], scoped).select(F.col("id").alias("_id"), "kept")
    all_rows = named.join(decided, named[id_col] == F.col("_id"), "left")
    outcome = F.coalesce(F.col("_reject"), F.when(F.col("kept"), "accepted").otherwise("duplicate"))
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = all_rows.withColumn("outcome", outcome).withColumn("_n", F.coalesce(F.sum((F.col("outcome") == "accepted").cast("int")).over(w), F.lit(0)))
    return counted.filter(F.col("_n") < cap).select(*rows.columns, "outcome")


def suppress_recent(rows: DataFrame, keys: Sequence[str], ts: str, id_col: str, days: float) -> DataFrame:
    """Rows without a reported row of their key in the days before; a suppressed row does not extend the period.

    These are the starts of anchored windows, open at their end.
    """
    from gleanery.operators.anchors import same, start_rows

    starts = start_rows(rows, keys, F.col(ts), int(days * 86_400_000_000), closed=False)
    first = keep_first(rows.withColumn("_t", F.unix_micros(ts)), [*keys, "_t"], [F.col(id_col)])
    return first.alias("a").join(starts.alias("b"), same(keys, "a", "b") & (F.col("a._t") == F.col("b._start")), "left_semi").drop("_t")
