"""A corpus pipeline: quality, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import jaccard, lines, mixing, packing, quality
from gleanery.llm.common import read_table, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.filter_quality(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before; one of which nothing is left goes."""
    out = lines.dedup_lines(docs, keep=("lang", "source"))
    out = out.filter(~lines.emptied(F.col("text"), F.col("n_deleted")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates (5 words, 0.8)."""
    groups = jaccard.jaccard_components(docs, ngram=5, percent=80)
    heads = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("head")).distinct()
    return docs.join(heads, F.col("doc_id").eqNullSafe(F.col("head")), "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    copies = mixing.mix(docs).groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark")).agg(F.max("copies").alias("times")).filter("times > 0")
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("own_mark"))
    taken = named.join(copies, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("own_mark") == F.col("of_mark")))
    return taken.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express a trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
