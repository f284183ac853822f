"""Anchored windows of a stream: keys share calls and state by the bucket, times are exact."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from gleanery.streaming import jobs

BASE = datetime(2024, 1, 1)
SCHEMA = "k string, user long, ts timestamp"


def test_windows_are_exact_to_the_microsecond_and_keys_come_back_as_they_were(spark, tmp_path):
    us = lambda n: BASE + timedelta(microseconds=n)
    hour, odd = 3_600_000_000, 2**60 + 1
    rows = [('a"é', odd, us(100)), ('a"é', odd, us(hour + 200)), ("b", None, us(0)), ("b", None, us(hour)), (None, 7, us(900)), (None, 7, us(hour + 1_100)), ("b", 7, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("~", 0, BASE + timedelta(days=400))], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), SCHEMA)
    jobs.to_table(jobs.anchored_counts(stream, ["k", "user"], "ts", 1 / 24, "1 hour"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r["k"], r["user"], r["window_start"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).filter(F.coalesce("k", F.lit("")) != "~").collect()}
    assert got == {('a"é', odd, us(100), 1), ('a"é', odd, us(hour + 200), 1), ("b", None, us(0), 2), (None, 7, us(900), 1), (None, 7, us(hour + 1_100), 1)}


class Value:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Map(dict):
    reads = 0
    containsKey, updateValue, removeKey = dict.__contains__, dict.__setitem__, dict.__delitem__

    def getValue(self, key):
        self.reads += 1
        return self[key]


class Handle:
    def __init__(self):
        self.timers, self.value, self.map = [], Value(), Map()

    def getValueState(self, *_):
        return self.value

    def getMapState(self, *_):
        return self.map

    def registerTimer(self, at):
        self.timers.append(at)


class Mark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_bucket_of_keys_settles_as_the_watermark_rises():
    rng, width, delay = random.Random(9), 5_000, 40  # microseconds, milliseconds
    rows = sorted((rng.randrange(400_000), f"k{rng.randrange(30)}") for _ in range(2_000))
    rows.sort(key=lambda r: r[0] + rng.randrange(delay * 1000))
    handle, mark, newest, got, calls = Handle(), 0, 0, [], 0
    windows = jobs.AnchoredWindows(width)
    windows.init(handle)
    for batch in [rows[i : i + 100] for i in range(0, 2_000, 100)] + [[(10**9, "end")], []]:
        for frames in [windows.handleInputRows((0,), iter([pd.DataFrame([(0, k, t, None) for t, k in batch], columns=["bucket", "item", "t", "at"])]), Mark(mark))] if batch else []:
            got += [tuple(r) for f in frames for r in f.itertuples(index=False)]
        due = [t for t in handle.timers if t <= mark]
        handle.timers = [t for t in handle.timers if t > mark]
        for _ in due[:1]:
            calls += 1
            got += [tuple(r) for f in windows.handleExpiredTimer((0,), Mark(mark), None) for r in f.itertuples(index=False)]
        ended = {(k, s) for k, s, _ in got}
        assert all(s + width < mark * 1000 for _, s in ended)
        newest = max([newest, *[t for t, _ in batch]])
        mark = max(mark, newest // 1000 - delay)
    want, start = {}, {}
    for t, k in sorted(rows):
        if k not in start or t - start[k] > width:
            start[k] = t
        want[k, start[k]] = want.get((k, start[k]), 0) + 1
    assert len(got) == len(want) and {(k, s): n for k, s, n in got} == want
    assert calls < 60 and len(handle.map) == 1 and handle.value.value is None  # 30 keys, 22 batches: one call a batch; the last row waits
