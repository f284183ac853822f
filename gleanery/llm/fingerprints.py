"""Improbable-feature digests of texts: rare byte windows in chained Bloom filters."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_rows, sliced, text_or_empty

WINDOW = 64  # bytes of a feature
SPAN = 64  # neighbouring features among which the rarest wins
WINS = 16  # times that a feature has to win
LEVELS = 1000  # entropy classes
FILTER_BITS = 2048
FILTER_FEATURES = 128
CHUNK = 1 << 16
RANGE_BYTES = 1 << 26  # of text that one task works through
SLICE = 200  # texts worked on at once


def _steps() -> np.ndarray:
    """Change of sum(n log2 n) when a byte's count rises from k to k + 1, as integers."""
    n = np.arange(WINDOW + 1, dtype=np.float64)
    f = np.where(n > 0, n * np.log2(np.maximum(n, 1)), 0) * (1 << 20)
    return np.diff(np.round(f).astype(np.int64))


STEPS = _steps()


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Entropy class (0 to LEVELS) of every byte window, from sliding counts."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, dtype=np.int32)
    out = np.empty(n - WINDOW + 1, dtype=np.int32)
    for lo in range(0, len(out), CHUNK):
        hi = min(lo + CHUNK, len(out))
        block = data[lo : hi + WINDOW - 1]
        before = np.zeros(len(block), dtype=np.uint8)
        after = np.zeros(len(block), dtype=np.uint8)
        for lag in range(1, WINDOW):
            same = (block[lag:] == block[:-lag]).view(np.uint8)
            before[lag:] += same
            after[:-lag] += same
        first = np.bincount(block[:WINDOW], minlength=256)
        total = np.concatenate(([0], np.cumsum(STEPS)))[first].sum()
        change = STEPS[before[WINDOW:]] - STEPS[after[: hi - lo - 1]] if hi - lo > 1 else np.empty(0, dtype=np.int64)
        # the byte that leaves has `after` equals among the 63 that follow it, the one that enters `before` among the 63 left
        sums = total + np.concatenate(([0], np.cumsum(change)))
        bits = np.log2(WINDOW) - sums / (1 << 20) / WINDOW
        out[lo:hi] = np.clip(np.round(bits / np.log2(WINDOW) * LEVELS), 0, LEVELS)
    return out


def rarest(ranks: np.ndarray) -> np.ndarray:
    """Starts of the features that are the rarest (leftmost in ties) of enough spans."""
    n = len(ranks)
    span = min(SPAN, n)
    if not n:
        return np.empty(0, dtype=np.int64)
    shift, kind = (20, np.int32) if n < 1 << 20 else (40, np.int64)  # ranks take 11 bits
    code = (ranks.astype(kind) << shift) | np.arange(n, dtype=kind)
    least, width = code, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n - span + 1], least[span - width : span - width + n - span + 1])
    wins = np.bincount(least & ((1 << shift) - 1), minlength=n)
    chosen = np.flatnonzero(wins >= min(WINS, len(least)))
    return chosen if len(chosen) else np.array([int(np.argmin(code))])


def joined_classes(raws: list[bytes]) -> Iterator[np.ndarray]:
    """Entropy classes of the windows of each text, worked out over the joined bytes."""
    classes = entropy_classes(np.frombuffer(b"".join(raws), dtype=np.uint8))
    at = 0
    for raw in raws:
        yield classes[at : max(at, at + len(raw) - WINDOW + 1)]
        at += len(raw)


def digests(texts: list[str], ranking: np.ndarray) -> list[np.ndarray]:
    """Chained filters of each text, one row of FILTER_BITS flags for each FILTER_FEATURES features.

    The features are the selected byte windows, each once, in order; a text
    shorter than a window is its only feature, an empty one has none.
    """
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = []
    for raw, classes in zip(raws, joined_classes(raws)):
        if len(raw) < WINDOW:
            found = [raw] if raw else []
        else:
            found = list(dict.fromkeys(raw[s : s + WINDOW] for s in rarest(ranking[classes]).tolist()))
        filters = np.zeros((-(-len(found) // FILTER_FEATURES), FILTER_BITS), dtype=bool)
        if found:
            hashes = np.frombuffer(b"".join(hashlib.sha1(f).digest() for f in found), dtype="<u4").reshape(-1, 5)
            filters[np.repeat(np.arange(len(found)) // FILTER_FEATURES, 5), (hashes % FILTER_BITS).ravel()] = True
        out.append(filters)
    return out


def to_string(filters: np.ndarray) -> str:
    return base64.b64encode(np.packbits(filters).tobytes()).decode() if len(filters) else ""


def from_string(text: str) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(base64.b64decode(text or ""), dtype=np.uint8))
    return bits.reshape(-1, FILTER_BITS).astype(bool)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: bit overlap above what chance gives, filter by filter.

    Each filter of the shorter chain is held against its best partner.  The
    sum, weighted by set bits, is divided by the longer chain's bits, so a text
    is only like another if both are covered.  Two empty digests are alike.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = a.sum(1).astype(float), b.sum(1).astype(float)
    both = a.astype(np.float32) @ b.T.astype(np.float32)
    chance = np.outer(na, nb) / FILTER_BITS
    most = np.minimum.outer(na, nb)
    score = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    score[most <= chance] = 0
    if a.shape == b.shape and (a == b).all():
        return 1.0
    return float((score.max(1) * na).sum() / max(na.sum(), nb.sum()))


def class_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """How many byte windows of all texts fall in each entropy class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(LEVELS + 1, dtype=np.int64)
        for part in sliced(batches, SLICE):
            for classes in joined_classes([t.encode("utf-8", "surrogatepass") for t in part["text"]]):
                total += np.bincount(classes, minlength=LEVELS + 1)
        yield pd.DataFrame({"entropy": np.flatnonzero(total), "n": total[np.flatnonzero(total)]})

    each = docs.select(text_or_empty(text_col).alias("text")).mapInPandas(run, "entropy int, n long")
    return each.groupBy("entropy").agg(F.sum("n").alias("n"))


def rarity(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Rank of each entropy class, rarest first (classes never seen come first of all), and how many windows all texts have.

    The table has LEVELS + 1 entries at any corpus size.  The extreme classes
    (constant runs, almost random bytes) are rare and would win everywhere, so
    windows under a tenth of the full entropy rank last.
    """
    counts = np.zeros(LEVELS + 1, dtype=np.int64)
    for row in class_counts(docs, text_col).collect():  # at most LEVELS + 1 rows
        counts[row["entropy"]] = row["n"]
    order = np.lexsort((np.arange(LEVELS + 1), counts))
    ranking = np.empty(LEVELS + 1, dtype=np.int64)
    ranking[order] = np.arange(LEVELS + 1)
    ranking[: LEVELS // 10] += LEVELS + 1
    return ranking, int(counts.sum())


def fingerprint(docs: DataFrame, ranking: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of each row; a null text is an empty one, with an empty fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sliced(batches, SLICE):
            prints = [to_string(d) for d in digests(part["text"].tolist(), ranking)]
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "fingerprint": prints})

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, "doc_id long, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


def ranges(cuts: np.ndarray):
    """A function of (id, text hash of 32 bits) that gives the range of a row, descending, from the ascending cuts.

    A cut that is there m times is an id with rows for m ranges: these are
    dealt by hash, as many hashes to each.
    """

    @F.pandas_udf("int")
    def of(low: pd.Series, hashed: pd.Series) -> pd.Series:
        x = low.to_numpy()
        first, last = np.searchsorted(cuts, x, side="left"), np.searchsorted(cuts, x, side="right")
        m = last - first
        inside = m - (hashed.to_numpy() * np.maximum(m, 1) >> 32)  # 1 to m, the largest hashes first
        return pd.Series(len(cuts) - last + np.where(m > 0, inside, 0))

    return of


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited text, and compare.

    The next document is the one with the next smaller doc_id (null ids come
    last, rows with one id are ordered by their text); after the last comes the
    first.  Rows are dealt by ranges of doc_id; each range gets a copy of the
    row that follows its last one, so texts are shuffled once and every range
    is worked through in order by one task, one row in memory at a time.  There are
    as many ranges as give each about ``RANGE_BYTES``; rows that share one id,
    or have none, and would fill several ranges are split by the hashes of their texts.

    A null text is an empty one.  One row is its own next document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    spark = rows.sparkSession
    ranking, size = rarity(docs, text_col)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    # the cuts are a few numbers; any cuts give the same result
    low = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    parts = [k / n for k in range(1, n)] or [0.5]
    cuts = rows.agg(F.percentile_approx(low, parts, max(10000, 10 * n))).first()[0] or []
    keyed = rows.withColumn("sha", F.sha2("text", 256))
    keyed = keyed.withColumn("range", ranges(np.array(sorted(cuts), dtype=np.int64))(low, F.conv(F.substring("sha", 1, 8), 16, 10).cast("long")))
    # the first row of each range, by (doc_id, text) descending; it ends the range before it
    heads = keyed.groupBy("range").agg(F.max(F.struct(low.alias("low"), "sha")).alias("top"))
    tops = sorted(((r["range"], r["top"]["low"], r["top"]["sha"]) for r in heads.collect()))  # one row a range
    if not tops:
        return rows.select("doc_id").mapInPandas(lambda batches: iter(()), EDITED)
    before = {tops[k][0]: tops[k - 1][0] for k in range(len(tops))}  # the first range's head ends the last range
    picked = spark.createDataFrame([(r, l, s, before[r]) for r, l, s in tops], "`range` int, top_low long, top_sha string, ends int")
    ends = (
        keyed.join(F.broadcast(picked), "range")  # one row a range
        .filter((low == F.col("top_low")) & (F.col("sha") == F.col("top_sha")))
        .groupBy("ends")
        .agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))  # equal rows only
        .select(F.col("ends").alias("range"), "doc_id", "text", F.lit(True).alias("end"))
    )
    all_rows = keyed.select("range", "doc_id", "text", F.lit(False).alias("end")).unionByName(ends)
    dealt = all_rows.repartition(len(tops), "range").sortWithinPartitions("range", "end", F.col("doc_id").desc_nulls_last(), F.sha2("text", 256).desc())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row before, with its digest
        for part in sliced(batches, SLICE):
            own = digests(part["text"].tolist(), ranking)
            todo = []
            for where, doc, text, end, print_ in zip(part["range"], part["doc_id"], part["text"], part["end"], own):
                if held is not None:
                    assert held[0] == where
                    todo.append((held[1], held[2], edited_text(held[2], text), held[3], print_))
                held = None if end else (where, doc, text, print_)
            changed = digests([t[2] for t in todo], ranking)
            out = [
                (doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_string(mine), to_string(other), likeness(mine, other), likeness(mine, following))
                for (doc, text, edited, mine, following), other in zip(todo, changed)
            ]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EDITED.split(", ")])

    return map_rows(dealt, run, EDITED)
