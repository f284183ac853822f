"""Quality rules: plain counts, and a log-likelihood ratio between trusted and raw n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_rows, sliced, split_words, text_or_empty, windows_of

BUCKETS = 1 << 16
REPEAT_WINDOW = 8
SLICE = 1000  # texts worked on at once
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A text is rejected if its n-grams are, on average, less than e**LEAST_RATIO times as likely in trusted as in raw text.
LEAST_RATIO = -0.25
SYMBOLS = "#*$%&|<>"


def ngram_buckets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all word unigrams and bigrams, and the number of the text each is in."""
    one, two = windows_of(hashes, counts, 1), windows_of(hashes, counts, 2)
    values = np.concatenate((one[0], two[0])) % np.uint64(BUCKETS)
    return values.astype(np.int64), np.concatenate((one[1], two[1]))


def bucket_counts(docs: DataFrame, text_col: str = "text", trusted_col: str = "trusted") -> DataFrame:
    """How often each n-gram bucket occurs in all texts (raw) and in the trusted ones (target)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for part in sliced(batches, SLICE):
            buckets, owner = ngram_buckets(*split_words(part["text"].tolist(), lower=True))
            raw += np.bincount(buckets, minlength=BUCKETS)
            trusted = part["trusted"].to_numpy(dtype=bool)
            target += np.bincount(buckets[trusted[owner]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": some, "raw": raw[some], "target": target[some]})

    rows = docs.select(text_or_empty(text_col).alias("text"), F.coalesce(F.col(trusted_col), F.lit(False)).alias("trusted"))
    each = rows.mapInPandas(run, "bucket int, raw long, target long")
    return each.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


SMOOTHING = 1.0


def totals(counts: DataFrame) -> np.ndarray:
    """Rows raw and target of the counts of all buckets: 2 x BUCKETS numbers at any corpus size."""
    out = np.zeros((2, BUCKETS), dtype=np.int64)
    for row in counts.collect():  # at most BUCKETS rows
        out[:, row["bucket"]] = row["raw"], row["target"]
    return out


def log_ratios(texts: list[str], all_counts: np.ndarray) -> np.ndarray:
    """Mean log p(n-gram) - log q(n-gram) of each text; 0 without words or other trusted text.

    Two rows: the ratios of texts outside of the target, and those of trusted
    ones.  p is the multinomial of trusted text, q that of raw text, both over
    all buckets.  A text's own n-grams are taken from the raw counts first, and
    of a trusted text from the target too: each is judged by the others alone,
    labelled or not.  p is smoothed by one occurrence a bucket, q by as many as
    make up the same share of its mass (the ratio of the totals): so rare
    n-grams say little, frequent ones that trusted text lacks say much.
    """
    buckets, owner = ngram_buckets(*split_words(texts, lower=True))
    sizes, out = np.bincount(owner, minlength=len(texts)), np.zeros((2, len(texts)))
    pairs, own = np.unique(owner * BUCKETS + buckets, return_counts=True)
    who, bucket = pairs // BUCKETS, pairs % BUCKETS
    raw, target = all_counts[0][bucket] - own, all_counts[1][bucket]
    left = (all_counts[0].sum() - sizes)[who]
    for within in (0, 1):
        good = all_counts[1].sum() - within * sizes[who]
        some = good > 0
        alpha = SMOOTHING * np.maximum(left, good) / np.where(some, good, 1)
        p = (target - within * own + SMOOTHING) / (good + SMOOTHING * BUCKETS)
        q = (raw + alpha) / (left + alpha * BUCKETS)
        # a text outside of the target may hold more of a bucket than trusted text does: its second row is not for use
        each = np.log(np.where(some, p, 1.0), where=p > 0, out=np.zeros(len(p))) - np.log(np.where(some, q, 1.0))
        sums = np.bincount(who, weights=own * each, minlength=len(texts))
        np.divide(sums, sizes, out=out[within], where=sizes > 0)
    return out


def symbol_count(text: str) -> int:
    return sum(text.count(c) for c in SYMBOLS)


def word_chars(text: str) -> int:
    return len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray, size: int = REPEAT_WINDOW) -> int:
    """Words covered by windows of ``size`` words that occur twice or more in the text."""
    windows, _ = windows_of(hashes, np.array([len(hashes)]), size)
    if len(windows) < 2:
        return 0
    _, inverse, n = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[inverse] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, outside double, inside double"


def apply_rules(docs: DataFrame, trusted: DataFrame, least_ratio: float = LEAST_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and a verdict for every document.

    ``trusted`` has the ids of trusted documents; their n-grams are the target
    multinomial, those of all documents the raw one, each without the text's own
    n-grams.  log_ratio is the mean over
    a text's unigrams and bigrams of the log-likelihood ratio (0 for a text
    without words); a document is kept if it passes the base rules and
    log_ratio >= ``least_ratio``.

    Null texts have no words and fail.  Null or repeated ids are judged row by
    row.  Without trusted documents every ratio is 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    marks = trusted.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(True).alias("trusted")).distinct()
    # the marks grow with the labels, so they are never broadcast: texts are shuffled once, at every size, and only counts and ratios again
    counted = totals(bucket_counts(rows.join(marks.hint("merge"), "doc_id", "left")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sliced(batches, SLICE):
            texts = part["text"].tolist()
            hashes, counts = split_words(texts)
            ends = np.cumsum(counts)
            outside, inside = log_ratios(texts, counted)
            repeats = np.array([repeated_words(hashes[e - c : e]) for e, c in zip(ends, counts)], dtype=np.int64)
            failed = (counts < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * counts)
            yield pd.DataFrame({
                "doc_id": part["doc_id"].array, "n_words": counts, "word_chars": [word_chars(t) for t in texts], "n_symbols": [symbol_count(t) for t in texts],
                "n_dup_lines": [repeated_lines(t) for t in texts], "n_repeat_words": repeats, "base_failed": failed, "outside": outside, "inside": inside,
            })

    scored = map_rows(rows, run, SCORED).join(marks.hint("merge"), "doc_id", "left")
    scored = scored.withColumn("log_ratio", F.when(F.col("trusted"), F.col("inside")).otherwise(F.col("outside")))
    return scored.drop("outside", "inside", "trusted").withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= least_ratio))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents marked as good and not toxic."""
    return labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id")
