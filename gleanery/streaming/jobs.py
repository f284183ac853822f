"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanery.streaming.tables import BucketTable, Snapshots


def read_files(spark: SparkSession, path: str, schema, per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def drain(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Work through all that has landed, batch by batch, and stop."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()


def to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that has landed to Parquet files, exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def snapshot(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, merge: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """ST1: each batch replaces a versioned snapshot of ``build`` over all rows so far.

    ``merge`` combines the union of the snapshot before and ``build`` of the
    batch, so only that is read; without it the batch is appended to a log and
    all of that is built anew.  A version carries the time of the trigger
    that built it, the same if the batch is repeated.
    """
    kept = Snapshots(stream.sparkSession, f"{path}/snapshot")

    def step(rows: DataFrame, n: int) -> None:
        at = rows.agg(F.max("_trigger")).first()[0]
        rows = rows.drop("_trigger")
        if merge:
            own = build(rows)
            before = kept.version(n - 1, own.schema) if n else own.limit(0)
            kept.publish(merge(before.unionByName(own)), n, at)
            return
        rows.write.mode("overwrite").parquet(f"{path}/log/batch={n}")
        whole = rows.sparkSession.read.parquet(f"{path}/log")
        kept.publish(build(whole.filter(F.col("batch") <= n).drop("batch")), n, at)

    drain(stream.withColumn("_trigger", F.current_timestamp()), step, checkpoint)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished snapshot; only its version is read."""
    return Snapshots(spark, f"{path}/snapshot").latest()


def first_seen(stream: DataFrame, keys: list[str], ts: str, horizon: str) -> DataFrame:
    """ST2: rows whose keys were not seen within the horizon."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


#: Groups of keys that share their calls and their state; fixed for the life of a stream.
KEY_BUCKETS = 512


def packed(rows: pd.DataFrame) -> tuple[bytes]:
    """Rows as a value of a state: one compressed Arrow stream."""
    batch, sink = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


def unpacked(value: tuple[bytes]) -> pd.DataFrame:
    return pa.ipc.open_stream(value[0]).read_pandas()


class AnchoredWindows(StatefulProcessor):
    """ST3 for a bucket of keys: a value state for their open windows, a map state for times the watermark has not reached.

    A call and its round trips cost more than a key's few rows, so keys share
    them by the bucket.  Waiting times lie in spans of four widths: arriving ones
    touch their own spans, settled ones those that the watermark has reached,
    and what waits beyond is not read.  Event-time timers wake the bucket when
    its first window may end.  Times are microseconds.
    """

    def __init__(self, width: int):
        self.width, self.span = width, 4 * max(width, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getValueState("windows", "rows binary")
        self.waiting = handle.getMapState("waiting", "span long", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([frame[["item", "t"]] for frame in rows]).groupby(["item", "t"], sort=False).size().reset_index(name="n")
        for span, own in new.groupby(new["t"] // self.span):
            self.wait(int(span), own)
        first, mark = int(new["t"].min()), timerValues.getCurrentWatermarkInMs() * 1000
        if first + self.width < mark:
            yield from self.settle(mark)
        else:
            self.wake(first, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settle(timerValues.getCurrentWatermarkInMs() * 1000)

    def wait(self, span: int, rows: pd.DataFrame) -> None:
        if self.waiting.containsKey((span,)):
            rows = pd.concat([unpacked(self.waiting.getValue((span,))), rows])
        self.waiting.updateValue((span,), packed(rows))

    def wake(self, start: int, mark: int) -> None:
        """A timer for the end of a window that opens at ``start``."""
        self.handle.registerTimer(max(start + self.width, mark) // 1000 + 1)

    def settle(self, mark: int) -> Iterator[pd.DataFrame]:
        """Work through all times before the watermark in order; later ones wait."""
        spans = sorted(span for (span,) in self.waiting.keys())
        due = [span for span in spans if span * self.span < mark]
        held, out = self.windows.get(), []
        windows = {k: (start, n) for k, start, n in unpacked(held).itertuples(index=False)} if held else {}
        if due:
            rows = pd.concat([unpacked(self.waiting.getValue((span,))) for span in due])
            for span in due:
                self.waiting.removeKey((span,))
            later = rows[rows["t"] >= mark]
            if len(later):
                self.waiting.updateValue((due[-1],), packed(later))
            for k, t, n in rows[rows["t"] < mark].sort_values("t").itertuples(index=False):
                start, count = windows.get(k, (t, 0))
                if t - start > self.width:
                    out.append((k, start, count))
                    start, count = t, 0
                windows[k] = start, count + n
            spans = [*due[-1:], *spans[len(due) :]] if len(later) else spans[len(due) :]
        ended = [(k, *w) for k, w in windows.items() if w[0] + self.width < mark]
        for k, *_ in ended:
            del windows[k]
        if windows:
            self.windows.update(packed(pd.DataFrame([(k, *w) for k, w in windows.items()], columns=["item", "start", "n"])))
        elif held:
            self.windows.clear()
        if windows or spans:
            self.wake(min([start for start, _ in windows.values()] + [max(span * self.span, mark) for span in spans[:1]]), mark)
        yield pd.DataFrame(out + ended, columns=["item", "start", "n"])

    def close(self) -> None:
        pass


def anchored_counts(stream: DataFrame, keys: list[str], ts: str, days: float, late: str = "0 seconds", buckets: int = KEY_BUCKETS) -> DataFrame:
    """ST3: start-anchored windows with their counts, emitted when the watermark has passed their end.

    Rows may come in any order until the watermark reaches them; only then do
    they settle.  Needs a state store that keeps states apart (RocksDB).
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    key, bucket = F.to_json(F.struct(*keys), exact), F.pmod(F.xxhash64(*keys), F.lit(buckets))
    rows = stream.withWatermark(ts, late).filter(F.col(ts).isNotNull()).select(bucket.alias("bucket"), key.alias("item"), F.unix_micros(F.col(ts)).alias("t"), F.col(ts).alias("at"))  # the watermark is that of the last column
    counted = rows.groupBy("bucket").transformWithStateInPandas(AnchoredWindows(int(days * 86_400_000_000)), "item string, start long, n long", "Append", "EventTime")
    read = F.from_json("item", ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys), exact)
    return counted.select(read.alias("_k"), F.timestamp_micros("start").alias("window_start"), "n").select(*[F.col("_k")[k].alias(k) for k in keys], "window_start", "n")


def tumbling_counts(stream: DataFrame, keys: list[str], ts: str, width: str, late: str) -> DataFrame:
    """ST4: counts by epoch-aligned window and key, emitted once the watermark has passed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def with_policy(stream: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """ST5: ``policy_reason`` of rows outside the window before ``as_of``, null inside; filter before the watermark."""
    t = F.col(ts)
    return stream.withColumn("policy_reason", F.when(t.isNull(), "no-time").when(t > as_of, "future").when(t < as_of - F.make_dt_interval(days=F.lit(days)), "late"))


def split_sinks(stream: DataFrame, reason: str, accepted: str, rejected: str, checkpoint: str) -> None:
    """ST5: each batch goes to two tables, rows with a ``reason`` to the second, each exactly once.

    A batch owns the partition ``batch=n`` of both tables and overwrites it, so
    one that is repeated after a failure between the two writes changes nothing.
    """

    def step(rows: DataFrame, n: int) -> None:
        rows.persist()
        rows.filter(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(f"{accepted}/batch={n}")
        rows.filter(F.col(reason).isNotNull()).write.mode("overwrite").parquet(f"{rejected}/batch={n}")
        rows.unpersist()

    drain(stream, step, checkpoint)


def upsert(stream: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], schema: str, path: str, checkpoint: str, buckets: int = 64) -> None:
    """ST6: each batch is merged into a keyed table of hash buckets, of which only those it touches are written anew."""
    table = BucketTable(stream.sparkSession, path, keys, schema, buckets)
    drain(stream, lambda rows, n: table.apply(rows, n, merge), checkpoint)
