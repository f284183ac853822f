"""Versioned tables that batches of a stream write: snapshots with an age, and keyed tables of hash buckets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """Small tables ``version=n`` that name what is finished: a version counts once its table is written."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def numbers(self) -> list[int]:
        """Finished versions, ascending; one that is being written has no mark of success yet."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = (s.getPath() for s in fs.listStatus(root))
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and fs.exists(done(p, "_SUCCESS")))

    def write(self, rows: list[tuple], n: int) -> None:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={n}")

    def read(self, n: int) -> list[tuple]:
        """Bounded: one row a bucket, or one in all."""
        return [tuple(r) for r in self.spark.read.schema(self.schema).parquet(f"{self.path}/version={n}").collect()]


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Snapshots:
    """ST1: whole results, one a version, with the time at which each was built."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.done = Versions(spark, f"{path}/finished", "built_at timestamp")

    def publish(self, rows: DataFrame, n: int, built_at: datetime) -> None:
        """Write a version, then name it finished: readers see the one before until then."""
        rows.write.mode("overwrite").parquet(f"{self.path}/data/version={n}")
        self.done.write([(built_at,)], n)

    def version(self, n: int, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(f"{self.path}/data/version={n}")

    def latest(self) -> DataFrame:
        finished = self.done.numbers()
        if not finished:
            raise LookupError(f"no finished snapshot in {self.path}")
        return self.version(finished[-1])

    def served(self, now: Column, ttl_seconds: float, stale_seconds: float | None = None) -> DataFrame:
        """The last finished snapshot with ``version``, ``built_at``, ``age_seconds`` and ``state`` as of ``now``.

        ``fresh`` up to ``ttl_seconds``, then ``stale``: served still, a refresh is due.  Beyond
        ``stale_seconds`` (if any) it is ``expired`` and no rows are served.
        """
        finished = self.done.numbers()
        if not finished:
            raise LookupError(f"no finished snapshot in {self.path}")
        n = finished[-1]
        built = F.lit(self.done.read(n)[0][0])
        age = (F.unix_micros(now) - F.unix_micros(built)) / 1e6
        state = F.when(age <= ttl_seconds, "fresh")
        state = state.otherwise("stale") if stale_seconds is None else state.when(age <= stale_seconds, "stale").otherwise("expired")
        rows = self.version(n).withColumns({"version": F.lit(n).cast("long"), "built_at": built, "age_seconds": age, "state": state})
        return rows.filter(F.col("state") != "expired")

    def prune(self, keep: int) -> None:
        """Delete all but the newest ``keep`` finished versions."""
        for n in self.done.numbers()[:-keep] if keep > 0 else []:
            delete(self.spark, f"{self.path}/finished/version={n}")
            delete(self.spark, f"{self.path}/data/version={n}")


class BucketTable:
    """ST6, W1 to W3: a keyed table in hash buckets; a manifest a version says which version each bucket is of.

    A batch reads and writes the buckets of its own keys only, so what it
    writes follows the batch and not the table.  A batch whose manifest is
    there already is a no-op; one that failed before that is written again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path, list(keys), schema, buckets
        self.manifests = Versions(spark, f"{path}/manifest", "bucket int, version long")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def parts(self, manifest: dict[int, int], only: Sequence[int] | None = None) -> DataFrame:
        """The rows of some buckets, or of all."""
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(manifest.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def manifest(self, before: int | None = None) -> dict[int, int]:
        known = [n for n in self.manifests.numbers() if before is None or n < before]
        return dict(self.manifests.read(known[-1])) if known else {}

    def apply(self, rows: DataFrame, n: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Version ``n``: ``merge(old rows of the touched buckets, rows)``, which returns the new rows of those buckets."""
        if n in self.manifests.numbers():
            return
        held = self.manifest(before=n)
        touched = sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())  # at most ``buckets``
        if touched:
            new = merge(self.parts(held, touched), rows).withColumn("bucket", self.bucket())
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={n}")
            made = [r[0] for r in self.spark.read.parquet(f"{self.path}/data/version={n}").select("bucket").distinct().collect()] if not new.isEmpty() else []
            held = {b: v for b, v in held.items() if b not in touched} | dict.fromkeys(made, n)
        self.manifests.write(sorted(held.items()), n)

    def read(self) -> DataFrame:
        """The newest finished version."""
        return self.parts(self.manifest())

    def vacuum(self) -> None:
        """Delete what no manifest but the newest needs."""
        known, held = self.manifests.numbers(), self.manifest()
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for version in fs.listStatus(root) if fs.exists(root) else []:
            v = int(version.getPath().getName().split("=")[1])
            for part in fs.listStatus(version.getPath()) if known and v <= known[-1] else []:
                name = part.getPath().getName()
                if name.startswith("bucket=") and held.get(int(name.split("=")[1])) != v:
                    fs.delete(part.getPath(), True)
        for n in known[:-1]:
            delete(self.spark, f"{self.path}/manifest/version={n}")
