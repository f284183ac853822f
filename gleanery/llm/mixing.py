"""Mix sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import staged

MOST = 3  # copies of a document at most, and target over source size at most
STEPS = 100  # Newton steps at most; some ten are usual
TOLERANCE = 1e-6
SALTS = 256
REPAIRS = 4


def word_count(column: str = "text"):
    """Words of a text, 0 for null: each ends where a white space follows, one being added at the end."""
    text = F.concat(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(" "))
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D][\x20\x09-\x0D]")).cast("long")


def same(left, right):
    return left.eqNullSafe(right)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, target from one row per source with its total size.

    Sources by code point, null last, take the weights in turn and share the
    total; a target above ``most`` times its source's size stops there and the
    excess is shared again by weight.  In closed form: order the sources by how
    soon they stop (cap over weight); the first that its share of what is left
    does not stop sets the level for all after it.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "utf-8"))  # one row a source
    soonest = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumns({"weight": weight, "cap": F.col("source_size").cast("double") * most})
        .withColumns({
            "stopped": F.coalesce(F.sum("cap").over(soonest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "left": F.sum("weight").over(soonest.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(soonest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        })
        .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("left"))
    )
    free = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))
    rows = rows.withColumn("free", F.min(free).over(soonest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("free.level") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def feature():
    """What a document's tilt is multiplied by: 1 for one of mean size, at least a half; 1 in a source without words."""
    return (1 + F.coalesce(F.try_divide(F.col("size"), F.col("mean_size")), F.lit(1.0))) / 2


def tilted_rate(most: int):
    return F.least(F.lit(float(most)), F.exp(F.col("tilt") * feature()))


def solve_tilts(groups: DataFrame, targets: DataFrame, most: int = MOST, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """source, target, mean_size, tilt: rates min(most, exp(tilt * z)) meet the target.

    ``groups`` has source, size and n, the number of documents that share them.
    Of all rates w <= most with sum(w * size) = target, these minimise the entropy
    balance sum(size / z * (w log w - w + 1)), the relative entropy of w to 1 with
    weights size / z.  Its dual, sum(size / z * exp(tilt * z)) - tilt * target, is convex in one
    number a source.  z = (1 + size / mean size) / 2 tempers the tilt, so that long
    documents neither vanish nor crowd out the rest; z = size would be the
    plain relative entropy, z = 1 one rate for all.  A Newton step on the dual is one
    aggregation over the groups of all sources at once; one that leaves the
    bracket around the solution is replaced by its middle.  It is an error if ``steps`` are not enough.
    """
    means = groups.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean_size")).withColumnRenamed("source", "of")
    start = F.when(F.col("target") > 0, F.log(F.col("target") / F.col("source_size"))).otherwise(0.0)
    state = targets.join(means, same(targets["source"], means["of"])).select("source", "target", "mean_size", start.alias("tilt"), F.lit(-80.0).alias("low"), F.lit(80.0).alias("high"))
    state = staged(state, "tilts")
    z, rate = feature(), tilted_rate(most)
    words = F.col("n") * F.col("size") * rate
    off = F.col("taken") - F.col("target")
    newton = F.col("tilt") - F.try_divide(off, F.col("slope"))
    for _ in range(steps):
        of = state.withColumnRenamed("source", "of")
        sums = groups.join(of, same(groups["source"], of["of"])).groupBy(F.col("of").alias("source"), "target", "mean_size", "tilt", "low", "high")
        sums = sums.agg(F.sum(words).alias("taken"), F.sum(F.when(rate < most, words * z).otherwise(0.0)).alias("slope"))
        sums = sums.withColumns({"low": F.when(off < 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))})
        done = F.abs(off) <= tolerance * F.col("target")
        step = F.when(done, F.col("tilt")).when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = staged(sums.select("source", "target", "mean_size", step.alias("tilt"), "low", "high", done.alias("done")), "tilts")
        if state.filter(~F.col("done")).isEmpty():
            break
        state = state.drop("done")
    else:
        raise RuntimeError(f"tilts have not converged after {steps} steps")
    return state.select("source", "target", "mean_size", "tilt")


def round_groups(groups: DataFrame, tilts: DataFrame, most: int = MOST) -> DataFrame:
    """source, size, n, copies: whole copies for each group, the words of a source near its target.

    The expected copies are rounded along the sizes, longest first, so that the
    count is never off by more than one; then shorter documents make up, a few
    times, for the words that this leaves over or short.
    """
    of = tilts.withColumnRenamed("source", "of")
    rate = tilted_rate(most)
    along = Window.partitionBy("source").orderBy(F.col("size").desc())  # sizes, not documents
    upto = F.floor(F.round(F.sum("expected").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 6) + 0.5)
    rows = groups.join(of, same(groups["source"], of["of"])).select("source", "size", "n", "target", (F.col("n") * rate).alias("expected"))
    rows = rows.withColumn("upto", upto)
    copies = F.least(F.col("upto") - F.coalesce(F.lag("upto").over(along), F.lit(0)), F.col("n") * most)
    rows = staged(rows.select("source", "size", "n", "target", copies.cast("long").alias("copies")), "copies")
    room = F.when(F.col("short") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
    change = F.least(room, F.floor(F.abs(F.col("short")) / F.col("size"))).cast("long")
    for _ in range(REPAIRS):
        short = rows.groupBy(F.col("source").alias("of")).agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
        able = rows.join(short, same(rows["source"], short["of"])).filter(F.col("size") > 0).withColumn("change", change).filter(F.col("change") > 0)
        best = able.groupBy(F.col("source").alias("of")).agg(F.max(F.struct("size", (F.signum("short") * F.col("change")).cast("long").alias("change"))).alias("best"))
        rows = rows.join(best, same(rows["source"], best["of"]), "left")
        more = F.when(F.col("size") == F.col("best.size"), F.col("best.change")).otherwise(0)
        rows = staged(rows.select("source", "size", "n", "target", (F.col("copies") + F.coalesce(more, F.lit(0))).alias("copies")), "copies")
    return rows.select("source", "size", "n", "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document.

    Returns doc_id, mark (a hash of the text), source, size (words), source_size,
    target, rate (the tilted rate), copies (0 to ``most``) and taken = copies * size.  Only ids, sources
    and sizes are shuffled.  The documents of one source and size share their
    group's copies by a hash of the id; ranks are counted in ``SALTS`` parts of
    a group, so that a source or a group of copies of any share of the rows
    spreads over many tasks.

    A null text has size 0; null sources are one source, the last.  Rows with
    equal ids are ranked by their texts.  Documents of size 0 are
    taken at the rate of their source, with 0 words.  A source without words has
    target 0.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("mark"), word_count(text_col).alias("size"))
    sized = staged(sized, "sizes")
    groups = staged(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "groups")
    targets = staged(source_targets(groups.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most), "targets")
    tilts = solve_tilts(groups, targets, most)
    counts = round_groups(groups, tilts, most)

    salted = sized.withColumns({"salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)), "order": F.xxhash64("doc_id", F.lit(1)), "row": F.monotonically_increasing_id()})
    parts = salted.groupBy("source", "size", "salt").agg(F.count("*").alias("m"))
    before = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # SALTS rows at most
    parts = parts.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    # as many rows as (source, size, salt) occur: never broadcast
    parts = parts.join(counts.hint("merge").withColumnsRenamed({"source": "of", "size": "of_size"}), same(F.col("source"), F.col("of")) & (F.col("size") == F.col("of_size")))
    parts = parts.select(F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("salt").alias("of_salt"), "before", "n", "copies")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("order", "mark", "row")) - 1)  # rows that share order and mark are alike
    ranked = ranked.join(parts.hint("merge"), same(F.col("source"), F.col("of")) & (F.col("size") == F.col("of_size")) & (F.col("salt") == F.col("of_salt")))
    own = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("before") + F.col("rank") < F.col("copies") % F.col("n"), 1).otherwise(0)
    ranked = ranked.select("doc_id", "mark", "source", "size", own.cast("long").alias("own"))
    about = targets.withColumnRenamed("source", "of").join(tilts.select(F.col("source").alias("named"), "tilt", "mean_size"), same(F.col("of"), F.col("named")))
    rate = tilted_rate(most)
    return ranked.join(about, same(F.col("source"), F.col("of"))).select(
        "doc_id", "mark", "source", "size", "source_size", "target", rate.alias("rate"), F.col("own").alias("copies"), (F.col("own") * F.col("size")).alias("taken")
    )
