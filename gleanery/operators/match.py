"""Entity matching: blocked pairs, pair decisions, event roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.rules import found
from gleanery.functions.text import hash_id, launch_title, pair_key
from gleanery.operators.storage import stored

#: Records of one block that one part holds.
BLOCK_ROWS = 2_000
RELEASE = r"\b(introducing|announcing|launch|release|released|available)\b"


def tokens(product: str = "product", model: str = "model") -> Column:
    """The entity tokens of a record, cleaned; empty ones are no tokens."""
    clean = lambda c: F.nullif(F.regexp_replace(F.lower(F.col(c)), r"[^a-z0-9.-]+", ""), F.lit(""))
    return F.array_distinct(F.array_compact(F.array(clean(product), clean(model))))


def candidate_pairs(records: DataFrame, days: float = 7, most: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of one organisation that share a token, are at most ``days`` apart and have no conflicting versions.

    Blocks (organisation, token) are cut into spans of ``days``: a record meets
    its own span and the next one.  A span of over ``most`` records is dealt by id
    into parts of about that many, and each pair of parts is a cell of
    its own: no task's group holds more than two parts, however many records
    share a token.  Each unordered pair comes once, from the least token that
    both have, so nothing has to be made distinct.
    """
    width = int(days * 86_400_000_000)
    rows = records.select("id", "org", F.lower("version").alias("version"), F.unix_micros("published_at").alias("t"), tokens().alias("tokens")).filter("t is not null")
    rows = stored(rows.withColumn("token", F.explode("tokens")).withColumn("span", F.floor(F.col("t") / width)), "blocks")  # read four times, and narrow
    block = ["org", "token", "span"]
    large = rows.groupBy(*block).agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).filter("parts > 1")
    own = rows.join(large, block, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = own.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    side = F.struct("id", "version", "t", "tokens")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    near = own.select(*block, side.alias("l"), F.col("part").alias("i"), every(F.col("parts")).alias("j"))
    far = own.select(*block, side.alias("r"), every(F.col("parts")).alias("i"), F.col("part").alias("j"))
    within = near.join(far, [*block, "i", "j"]).filter("l.id < r.id").select("l", "r", "token")

    after = large.select("org", "token", (F.col("span") - 1).alias("span"), F.col("parts").alias("next_parts"))
    before = large.select("org", "token", (F.col("span") + 1).alias("span"), F.col("parts").alias("last_parts"))
    near = own.join(after, block, "left").select("org", "token", (F.col("span") + 1).alias("span"), side.alias("l"), F.col("part").alias("i"), every(F.coalesce("next_parts", F.lit(1))).alias("j"))
    far = own.join(before, block, "left").select(*block, side.alias("r"), every(F.coalesce("last_parts", F.lit(1))).alias("i"), F.col("part").alias("j"))
    across = near.join(far, [*block, "i", "j"]).filter(F.col("r.t") - F.col("l.t") <= width).select("l", "r", "token")

    conflict = F.coalesce(F.col("l.version") != F.col("r.version"), F.lit(False))
    pairs = within.unionByName(across).filter(~conflict & (F.col("token") == F.array_min(F.array_intersect("l.tokens", "r.tokens"))) & (F.col("l.id") != F.col("r.id")))
    return pairs.select(F.least("l.id", "r.id").alias("left_id"), F.greatest("l.id", "r.id").alias("right_id"))


def title_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two launch titles; 0 if either has none."""
    words = lambda t: F.array_distinct(F.filter(F.split(launch_title(t), " "), lambda w: w != ""))
    both, either = F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))
    return F.when((F.size(words(a)) == 0) | (F.size(words(b)) == 0), 0.0).otherwise(both / F.greatest(either, F.lit(1)))


def decide(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """left_id, right_id, similarity, decision (true, false, or null where undecided), by ordered rules."""
    fields = ["id", "title", "product", "model", "version", "event_type", "published_at"]
    side = lambda p: records.select(*[F.col(c).alias(f"{p}_{c}") for c in fields])
    l, r = lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}")  # noqa: E731, E741
    rows = pairs.join(side("l"), F.col("left_id") == l("id")).join(side("r"), F.col("right_id") == r("id"))
    same = lambda c: F.coalesce(F.lower(l(c)) == F.lower(r(c)), F.lit(False))
    rows = rows.withColumn("similarity", title_jaccard(l("title"), r("title")))
    close = F.abs(F.unix_micros(l("published_at")) - F.unix_micros(r("published_at"))) <= 2 * 86_400_000_000
    wording = found(l("title"), RELEASE) & found(r("title"), RELEASE)
    s = F.col("similarity")
    decision = (
        F.when(F.coalesce(F.lower(l("version")) != F.lower(r("version")), F.lit(False)), False)
        .when(same("model") & close & wording, True)
        .when(same("model") & (s >= 0.2), True)
        .when(same("product") & same("event_type") & (s >= 0.35), True)
        .when(s < 0.12, False)
    )
    return rows.select("left_id", "right_id", s, decision.alias("decision"))


def resolve(decided: DataFrame, decisions: DataFrame, default: bool = False) -> DataFrame:
    """Undecided pairs take the answer of a decision table (pair_key, answer), else ``default``."""
    keyed = decided.withColumn("pair_key", pair_key(F.col("left_id"), F.col("right_id")))
    out = keyed.join(decisions.select(F.col("pair_key").alias("of"), "answer"), F.col("pair_key") == F.col("of"), "left")
    return out.select("left_id", "right_id", "pair_key", "decision", F.coalesce("decision", "answer", F.lit(default)).alias("matched"))


def roll_up_events(records: DataFrame, components: DataFrame) -> DataFrame:
    """One event per component.

    The primary source has the highest authority, then the best source rank,
    then it is not a cue, then it is the earliest, then its id is smallest.
    product, model and version are the first that are known, by authority.
    """
    rows = records.join(components.select(F.col("id").alias("of"), "component"), F.col("id") == F.col("of"))
    primary = F.struct(-F.col("authority"), -F.col("source_rank"), F.col("is_cue"), F.col("published_at"), F.col("id"))
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(-F.col("authority"), F.col("published_at"), F.col("id")))).alias(c)
    events = rows.groupBy("component").agg(
        F.min_by(F.struct("id", "url", "title", "org"), primary).alias("primary"), F.min("published_at").alias("published_at"), F.max("authority").alias("authority"), F.count("*").alias("n_sources"),
        known("product"), known("model"), known("version"), F.count_distinct(F.lower("version")).alias("n_versions"), F.max("impact_score").alias("impact_score"), F.max("novelty_score").alias("novelty_score"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("capabilities")))), ",").alias("capabilities"),
    )
    event_id = hash_id(16, F.col("primary.org"), F.col("product"), F.col("model"), F.col("version"), F.date_format("published_at", "yyyy-MM-dd"), F.col("component"))
    return events.select(event_id.alias("event_id"), F.col("primary.id").alias("primary_id"), F.col("primary.org").alias("org"), F.col("primary.title").alias("title"), "component", "published_at", "authority", "n_sources", "product", "model", "version", (F.col("n_versions") > 1).alias("version_conflict"), "impact_score", "novelty_score", "capabilities")
