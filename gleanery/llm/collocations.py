"""Phrase collocations by best-first branch-and-bound growth of phrases from their prefixes.

A phrase of three words scores at most what its first two words allow: with
a <= f(w1 w2) and a <= f(w2 w3), the cut after one word gives
a * a / (f(w1) * f(w2 w3)) <= f(w1 w2) / f(w1).  So the two-word prefixes of a
language, best bound first, are expanded in batches until its ``top`` best
surviving scores, with ties, all lie at or above the bound that the
batch reached; prefixes below it are never grown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import staged, text_or_empty

#: Bits of the filters that tell tasks which pairs of words to grow: 8 MB each, whatever the input.
FILTER_BITS = 26
#: Words counted together before a task passes counts on.
CHUNK = 1_000_000
#: Bytes after which a longer text is worked on piece by piece.
SEGMENT = 4_000_000
#: The first batch ends where a language has this many times ``top`` pairs; each later one holds as many times more.
WIDEN = 4

# What ends a piece, and the byte (never in UTF-8) that stands for it.
ENDS = b".,;:!?\n\x0b\x0c\r"
MARK = b"\xff"
TO_MARK = bytes.maketrans(ENDS, MARK * len(ENDS))
GRAMS = "lang string, w1 string, w2 string, w3 string, f long"
PAIR = ["lang", "w1", "w2"]
WHOLE = "decimal(20,0)"


def segments(raw: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """A text whose ends are marks, cut at marks into parts of little more than ``size``."""
    lo = 0
    while len(raw) - lo > size:
        cut = raw.find(MARK, lo + size)
        if cut < 0:
            break
        yield raw[lo:cut]
        lo = cut + 1
    yield raw[lo:]


class Vocabulary(dict):
    """Codes of words in the order in which they come; 0 is the mark."""

    def __init__(self):
        super().__init__({MARK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, words by code, codes) of about ``size`` words and marks each; every text ends with a mark.

    Words are coded as they come, so a task holds each word of a chunk once.
    """
    held: dict[str, tuple[Vocabulary, list[np.ndarray]]] = {}
    n = 0

    def passed() -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        while held:
            lang, (known, parts) = held.popitem()
            yield lang, list(known), np.concatenate(parts).astype(np.int64)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_py().encode("utf-8", "surrogatepass").lower().translate(TO_MARK)
            for part in segments(raw):
                known, parts = held.setdefault(lang, (Vocabulary(), []))
                words = part.replace(MARK, b" \xff ").split()
                words.append(MARK)
                parts.append(np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)))
                n += len(words)
                if n >= size:
                    yield from passed()
                    n = 0
    yield from passed()


def rows_of(lang: str, words: list[bytes], columns: list[np.ndarray | None], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    named = pa.array(words, type=pa.binary())
    for lo in range(0, len(counts), 100_000):
        part = slice(lo, lo + 100_000)
        n = len(counts[part])
        texts = [pa.nulls(n, pa.string()) if c is None else named.take(pa.array(c[part])).cast(pa.string()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, type=pa.string()), *texts, pa.array(counts[part], type=pa.int64())], names=["lang", "w1", "w2", "w3", "f"])


def count_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, pairs and (all words null) the number of words of each chunk."""
    for lang, words, codes in chunks(batches, CHUNK):
        real, single = codes > 0, np.bincount(codes, minlength=len(words))
        if len(words) < 2:
            continue
        words[0] = b""
        yield from rows_of(lang, words, [None, None, None], np.array([single[1:].sum()]))
        yield from rows_of(lang, words, [np.arange(1, len(words)), None, None], single[1:])
        pairs, f = np.unique((codes[:-1] * len(words) + codes[1:])[real[:-1] & real[1:]], return_counts=True)
        yield from rows_of(lang, words, [pairs // len(words), pairs % len(words), None], f)


def slots(lang: np.uint64, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places of pairs in the filters; ``slot_of`` says the same in SQL."""
    return ((lang << np.uint64(2)) ^ (first << np.uint64(1)) ^ second).astype(np.int64) & ((1 << FILTER_BITS) - 1)


def slot_of(lang: str, first: str, second: str) -> Column:
    hashed = F.shiftleft(F.xxhash64(lang), 2).bitwiseXOR(F.shiftleft(F.xxhash64(first), 1)).bitwiseXOR(F.xxhash64(second))
    return hashed.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def count_grown(prefixes, suffixes):
    """Triples of which the first two words are among ``prefixes`` or the last two among ``suffixes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = xxhash.xxh64_intdigest
        for lang, words, codes in chunks(batches, CHUNK):
            if len(codes) < 3:
                continue
            real = codes > 0
            h = np.array([key(w, 42) for w in words], dtype=np.uint64)[codes]
            at = slots(np.uint64(key(lang.encode(), 42)), h[:-1], h[1:])
            del h
            grow, back = (((f.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) for f in (prefixes, suffixes))
            del at
            (where,) = np.nonzero(real[:-2] & real[1:-1] & real[2:] & (grow[:-1] | back[1:]))
            starts, which = np.unique(codes[where] * len(words) + codes[where + 1], return_inverse=True)
            triples, f = np.unique(which * len(words) + codes[where + 2], return_counts=True)
            pair, words[0] = starts[triples // len(words)], b""
            yield from rows_of(lang, words, [pair // len(words), pair % len(words), triples % len(words)], f)

    return run


def as_filter(pairs: DataFrame) -> Broadcast:
    """The pairs' slots as bits: at most 2^20 rows of 64 bits reach the driver, however many pairs there are."""
    bit = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    got = pairs.select(slot_of(*PAIR).alias("slot")).groupBy(F.shiftright("slot", 6).alias("place")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype="<i8")
    out[got["place"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    return pairs.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole decimals; an overflow would raise, never round."""
    return F.expr(f"(1000000BD * (cast({a} AS {WHOLE}) * {a})) div (cast({left} AS {WHOLE}) * {right})")


def batch_ends(pairs: DataFrame, size: int) -> DataFrame:
    """lang, reach: the best score down to which a language has ``size`` pairs; 0 if it has fewer.

    The running sum is over the distinct scores of a language, at most 1,000,001.
    """
    counts = pairs.groupBy("lang", "score").count()
    upto = counts.withColumn("upto", F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("score"))))
    return upto.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= size, F.col("score"))), F.lit(0)).cast("long").alias("reach"))


def survivors(pairs: DataFrame, triples: DataFrame, reach: DataFrame, cover: int) -> DataFrame:
    """lang, phrase, a, l, r, score of what scores ``reach`` or more and lies in no triple that covers it."""
    ends = [triples.select("lang", "w1", "w2", "f"), triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f")]
    over = ends[0].unionByName(ends[1]).groupBy(*PAIR).agg(F.max("f").alias("over"))
    alone = pairs.join(over, PAIR, "left").filter(F.col("over").isNull() | (100 * F.col("over") < cover * F.col("f")))
    two = alone.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), "score")

    head = pairs.select(*PAIR, F.col("f").alias("f12"), "f1")
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23"), F.col("f2").alias("f3"))
    cuts = triples.join(head, PAIR).join(tail, ["lang", "w2", "w3"]).withColumns({"one": score("f", "f1", "f23"), "two": score("f", "f12", "f3")})
    late = F.col("two") < F.col("one")
    three = cuts.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), F.when(late, F.col("f12")).otherwise(F.col("f1")).alias("l"),
        F.when(late, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("one", "two").alias("score"),
    )
    return two.unionByName(three).join(reach, "lang").filter("score >= reach").drop("reach")


def mine(docs: DataFrame, top: int = 2000, least: int = 10, cover: int = 50, widen: int = WIDEN, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` best phrases of two or three words of each language.

    Returns lang, rank, phrase, a, l, r, n, score, all counted over whole
    texts.  Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and
    line breaks, and those into words at blanks and tabs.  A phrase needs
    ``least`` occurrences; its score is that of its lowest cut.  A pair
    goes if a triple with ``cover`` percent of its count holds it.

    One pass over the texts counts words and pairs; each batch of the search
    counts in another one the triples that grow from its prefixes, and those
    that may cover its pairs.  A language is settled once ``top`` survivors reach
    the score at which the batch ends, or no prefix is left; mostly the first
    batch settles all.  Tasks combine counts before the shuffle, which is by whole
    phrase, so neither a frequent language nor a frequent phrase is a hot key.

    Null texts count as empty, null languages as ``und``; repeated rows count as
    often as they are there; ids do not matter.  An empty table gives no rows.
    """
    if widen <= 1:
        raise ValueError("each batch must reach further than the one before")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    counted = texts.mapInArrow(count_short, GRAMS).groupBy(*PAIR).agg(F.sum("f").alias("f"))
    grams = staged(counted.filter((F.col("f") >= least) | F.col("w1").isNull()), "grams")
    words = grams.filter(F.col("w1").isNotNull() & F.col("w2").isNull())
    first = words.select("lang", "w1", F.col("f").alias("f1"))
    second = words.select("lang", F.col("w1").alias("w2"), F.col("f").alias("f2"))
    pairs = grams.filter(F.col("w2").isNotNull()).join(first, ["lang", "w1"]).join(second, ["lang", "w2"])
    bound = F.expr(f"(1000000BD * f) div cast(f1 AS {WHOLE})")
    pairs = staged(pairs.select(*PAIR, "f", "f1", "f2", score("f", "f1", "f2").alias("score"), bound.alias("bound")), "pairs")

    frontier, grown, settled, size = pairs.withColumn("above", F.lit(1_000_001)), None, None, top
    while True:
        size *= widen
        reach = staged(batch_ends(frontier, size), "reach")
        due = frontier.join(reach, "lang").filter("bound >= reach")
        starts, stops = as_filter(due.filter("bound < above")), as_filter(due.filter("score >= reach AND score < above"))
        found = texts.mapInArrow(count_grown(starts, stops), GRAMS).groupBy("lang", "w1", "w2", "w3").agg(F.sum("f").alias("f"))
        found = staged(found.filter(F.col("f") >= least), "triples")
        starts.unpersist()
        stops.unpersist()
        grown = found if grown is None else staged(grown.unionByName(found).distinct(), "triples")  # counts are whole in every batch
        alive = staged(survivors(pairs, grown, reach, cover), "alive")
        state = reach.join(alive.groupBy("lang").agg(F.count("*").alias("n_alive")), "lang", "left")
        done = (F.coalesce("n_alive", F.lit(0)) >= top) | (F.col("reach") == 0)
        best = alive.join(state.filter(done).select("lang"), "lang", "left_semi")
        settled = best if settled is None else settled.unionByName(best)
        left = staged(state.filter(~done).select("lang", F.col("reach").alias("above")), "unsettled")
        if left.isEmpty():
            break
        frontier = pairs.join(left, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = settled.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = grams.filter(F.col("w1").isNull()).select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
    FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), words AS (
    SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces)
), f1 AS (SELECT lang, w1, count(*) AS f FROM words GROUP BY ALL
), f2 AS (SELECT lang, w1, w2, count(*) AS f FROM words WHERE w2 IS NOT NULL GROUP BY ALL
), f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM words WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), covered AS (
    SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL
), cuts AS (
    SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, 1 AS k, p.f AS a, x.f AS l, y.f AS r
    FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
    LEFT JOIN covered c ON c.lang = p.lang AND c.w1 = p.w1 AND c.w2 = p.w2
    WHERE p.f >= 10 AND (c.f IS NULL OR 100 * c.f < 50 * p.f)
    UNION ALL
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, x.f, y.f
    FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f2 y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
    UNION ALL
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, x.f, y.f
    FROM f3 t JOIN f2 x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w3
), scored AS (
    SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, (SELECT count(*) FROM words w WHERE w.lang = ranked.lang) AS n, score FROM ranked WHERE rank <= 2000
"""
