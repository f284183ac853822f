"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only a session on one machine
    without it, as in tests, gets a temporary one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts the lineage: later steps read the files, whichever executors are lost.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sliced(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches cut to at most so many rows, so that what is derived from them stays small."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.iloc[lo : lo + rows]


def map_rows(rows: DataFrame, run: Callable, schema: str, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """mapInPandas with the id columns carried as text: pandas would turn long columns with nulls into doubles."""
    as_text = re.sub(rf"\b({'|'.join(ids)}) long", r"\1 string", schema)
    given = {c: F.col(c).cast("string") for c in ids if c in rows.columns}
    out = rows.withColumns(given).mapInPandas(run, as_text)
    return out.withColumns({c: F.col(c).cast("long") for c in ids})


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element by element."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def split_words(texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and how many each text has.

    bytes.split() and bytes.lower() know ASCII only, which is what the word
    definition asks for.
    """
    parts, counts = [], np.empty(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        words = (raw.lower() if lower else raw).split()
        counts[i] = len(words)
        parts += words
    if not parts:
        return np.empty(0, dtype=np.uint64), counts
    codes, uniques = pd.factorize(np.array(parts, dtype=object))
    return pd.util.hash_array(uniques, categorize=False)[codes], counts


def windows_of(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word windows of ``size`` inside one text, with the text's number.

    The hash depends on the order of the words.
    """
    n = len(hashes)
    if n < size:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    out = hashes[: n - size + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - size + 1 + k])
    same = owner[: n - size + 1] == owner[size - 1 :]
    return out[same], owner[: n - size + 1][same]
