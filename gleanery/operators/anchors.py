"""Starts of anchored windows: a fold for keys with few times, contracted next pointers for hot ones.

The next pointer of a time is the first time of its key at least ``gap``
later; the starts are the chain of pointers from a key's first time.  For a
key with very many times the chain is found in parallel: spans of 2, 4, 8, ...
gaps keep only the times at which a chain can enter them, each with its
pointer to the next span, so every level halves the work; on the way back each
level fills in the starts that it skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.storage import drop, stored

#: Distinct times up to which one key is folded in order.
FOLD_TIMES = 10_000
#: Times that one lookup bucket of a hot key holds on average.
BUCKET_TIMES = 4096
#: Buckets whose running minimum is worked out together.
BLOCK = 4096

def same(keys: Sequence[str], left: str, right: str) -> Column:
    """Equal keys, nulls included."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def start_rows(rows: DataFrame, keys: Sequence[str], ts: Column, width: int, closed: bool, most: int = FOLD_TIMES) -> DataFrame:
    """keys, _start (microseconds): where the windows of each key open.

    A window opens at the first time over ``width`` after the start before
    (``closed``), or at least that far.  Rows without a time open none; null
    keys are keys.  Only distinct times are moved.
    """
    gap = width + closed
    times = stored(rows.filter(ts.isNotNull()).select(*keys, F.unix_micros(ts).alias("_t")).distinct(), "times")
    hot = times.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_t").alias("_first"), F.max("_t").alias("_last")).filter(F.col("_n") > most)
    if hot.isEmpty():
        return folded(times, keys, gap)
    t = F.col("_t")
    hot = stored(hot, "hot").withColumn("_k", F.monotonically_increasing_id())  # of a written table: the same each time
    few = times.alias("a").join(hot.alias("b"), same(keys, "a", "b"), "left_anti")
    many = times.alias("a").join(hot.alias("b"), same(keys, "a", "b")).select("b._k", "b._n", (F.col("a._t") - F.col("b._first")).alias("_t"), (F.col("b._last") - F.col("b._first")).alias("_span"))
    found = chained(many, gap).join(hot, "_k").select(*keys, (t + F.col("_first")).alias("_start"))
    return folded(few, keys, gap).unionByName(found)


def folded(times: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """A key's times in order, holding the time from which the next window may open."""
    empty = F.struct(F.array().cast("array<long>").alias("starts"), F.lit(None).cast("long").alias("limit"))

    def step(acc: Column, at: Column) -> Column:
        opens = acc["limit"].isNull() | (at >= acc["limit"])
        return F.when(opens, F.struct(F.array_append(acc["starts"], at).alias("starts"), (at + gap).alias("limit"))).otherwise(acc)

    every = times.groupBy(*keys).agg(F.array_sort(F.collect_list("_t")).alias("_all"))
    return every.select(*keys, F.explode(F.aggregate("_all", empty, step)["starts"]).alias("_start"))


def with_next(times: DataFrame, gap: int) -> DataFrame:
    """_k, _t, _next: the first time of the key at least ``gap`` later, or null.

    Times and the places asked for meet in buckets small enough for a task;
    what a bucket does not hold is the first time of a later bucket.
    """
    t = F.col("_t")
    width = F.greatest(F.lit(1), F.ceil((F.col("_span") + gap + 1) / F.ceil(F.col("_n") / BUCKET_TIMES)))
    sized = times.withColumn("_w", width.cast("long"))
    own = sized.select("_k", F.floor(t / F.col("_w")).alias("_b"), "_t", F.lit(0).alias("_asks"))
    ask = sized.select("_k", F.floor((t + gap) / F.col("_w")).alias("_b"), (t + gap).alias("_t"), F.lit(1).alias("_asks"))
    down = Window.partitionBy("_k", "_b").orderBy(F.desc("_t"), "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = own.unionByName(ask).withColumn("_here", F.min(F.when(F.col("_asks") == 0, t)).over(down)).filter("_asks = 1")
    heads = own.groupBy("_k", "_b").agg(F.min("_t").alias("_head")).unionByName(ask.select("_k", "_b", F.lit(None).cast("long").alias("_head")).distinct())
    heads = heads.groupBy("_k", "_b").agg(F.max("_head").alias("_head")).withColumn("_block", F.floor(F.col("_b") / BLOCK))
    later = lambda by, order: Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    blocks = heads.groupBy("_k", "_block").agg(F.min("_head").alias("_head")).select("_k", "_block", F.min("_head").over(later(["_k"], "_block")).alias("_beyond"))
    after = heads.withColumn("_within", F.min("_head").over(later(["_k", "_block"], "_b"))).join(blocks, ["_k", "_block"]).select("_k", "_b", F.coalesce("_within", "_beyond").alias("_after"))
    return met.join(after, ["_k", "_b"]).select("_k", (t - gap).alias("_t"), F.coalesce("_here", "_after").alias("_next"))


def chained(times: DataFrame, gap: int) -> DataFrame:
    """_k, _t: the chain of next pointers from time 0 of each key."""
    t = F.col("_t")
    nodes = stored(with_next(times, gap), "pointers")
    last = times.agg(F.max("_span")).first()[0]
    levels, size = [], gap
    while size <= last:
        size *= 2
        span = F.floor(t / size)
        placed = nodes.withColumn("_s", span)
        enters = placed.groupBy("_k", "_s").agg(F.min(F.when(t >= F.col("_s") * size + gap, t)).alias("_later"))
        kept = placed.join(enters, ["_k", "_s"]).filter((t < F.col("_s") * size + gap) | t.eqNullSafe(F.col("_later")))
        inside = F.when(F.floor(F.col("_next") / size) == F.col("_s"), F.col("_next"))
        hop = nodes.select("_k", t.alias("_via"), F.col("_next").alias("_onward"))
        onward = kept.withColumn("_via", inside).join(hop, ["_k", "_via"], "left")
        levels.append((size, nodes))
        nodes = stored(onward.select("_k", "_t", F.when(F.col("_via").isNull(), F.col("_next")).otherwise(F.col("_onward")).alias("_next")), "pointers")
    chain = times.select("_k", F.lit(0).cast("long").alias("_t")).distinct()
    for size, lower in reversed(levels):
        skipped = chain.join(lower, ["_k", "_t"]).filter(F.floor(F.col("_next") / size) == F.floor(t / size)).select("_k", F.col("_next").alias("_t"))
        chain = stored(chain.unionByName(skipped), "chain")
        drop(lower)
    return chain


def lookup(rows: DataFrame, keys: Sequence[str], at: Column, starts: DataFrame, gap: int) -> DataFrame:
    """``rows`` with ``_start``, the last of the starts up to its time ``at`` (microseconds).

    Starts of a key are ``gap`` or more apart, so a bucket of that length
    holds one at most, and a row's start lies in its own bucket or the one before:
    an equi-join on key and bucket, in which even one key spreads over all its buckets.
    The starts are stored, so that their size is known when the join is planned: few are broadcast and no row is shuffled.
    """
    bucket = F.floor(F.col("_start") / gap)
    both = starts.select(*keys, F.inline(F.array(F.struct(bucket.alias("_b"), F.col("_start").alias("_own"), F.lit(None).cast("long").alias("_prev")), F.struct((bucket + 1).alias("_b"), F.lit(None).cast("long").alias("_own"), F.col("_start").alias("_prev")))))
    slots = stored(both.groupBy(*keys, "_b").agg(F.max("_own").alias("_own"), F.max("_prev").alias("_prev")), "slots")
    asked = rows.withColumns({"_at": at, "_b": F.floor(at / gap)})
    joined = asked.alias("a").join(slots.alias("b"), same(keys, "a", "b") & (F.col("a._b") == F.col("b._b")), "left")
    start = F.when(F.col("b._own") <= F.col("a._at"), F.col("b._own")).otherwise(F.col("b._prev"))
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], start.alias("_start"))
