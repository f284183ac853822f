"""Streams that stop and go on, fail between writes, and repeat batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.streaming import jobs
from gleanery.streaming.tables import BucketTable, Snapshots

BASE = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp"


def land(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_anchored_windows_survive_a_restart(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "in")
    rows = [(rng.choice("abc"), BASE + timedelta(minutes=rng.randrange(4_000))) for _ in range(300)]
    rows.sort(key=lambda r: (r[1] - BASE).total_seconds() + 3600 * rng.random() * 5)  # out of order, by less than the delay
    parts = [rows[i : i + 60] for i in range(0, 300, 60)]
    for part in parts[:2]:
        land(spark, path, part)

    def go_on():
        stream = jobs.read_files(spark, path, SCHEMA, per_trigger=1)
        jobs.to_table(jobs.anchored_counts(stream, ["k"], "ts", 0.25, "6 hours"), str(tmp_path / "out"), str(tmp_path / "check"))

    go_on()
    early = spark.read.parquet(str(tmp_path / "out")).count()
    for part in parts[2:]:
        land(spark, path, part)
        go_on()  # from the checkpoint
    land(spark, path, [("z", BASE + timedelta(days=400))])
    go_on()
    want = {}
    for key in "abc":
        start = None
        for t in sorted(t for k, t in rows if k == key):
            if start is None or t - start > timedelta(hours=6):
                start = t
            want[key, start] = want.get((key, start), 0) + 1
    got = [((r["k"], r["window_start"]), r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).filter("k != 'z'").collect()]
    assert early and len(got) == len(want) and dict(got) == want


def test_both_sinks_hold_each_row_once_after_a_failure_between_them(spark, tmp_path, monkeypatch):
    path, accepted, rejected, check = (str(tmp_path / n) for n in ("in", "accepted", "rejected", "check"))
    for k in range(3):
        land(spark, path, [(f"{k}-{i}", BASE if i % 3 else None) for i in range(9)])
    stream = lambda: jobs.with_policy(jobs.read_files(spark, path, SCHEMA, per_trigger=1), "ts", F.lit(BASE), 1)
    writer = type(spark.range(1).write)
    whole, calls = writer.parquet, []

    def failing(self, to, *args, **options):
        calls.append(to)
        if to == f"{rejected}/batch=1" and calls.count(to) == 1:
            raise OSError("lost between the two writes")
        return whole(self, to, *args, **options)

    monkeypatch.setattr(writer, "parquet", failing)
    with pytest.raises(Exception, match="lost between"):
        jobs.split_sinks(stream(), "policy_reason", accepted, rejected, check)
    jobs.split_sinks(stream(), "policy_reason", accepted, rejected, check)
    assert calls.count(f"{accepted}/batch=1") == 2
    ids = lambda p: sorted(r["k"] for r in spark.read.parquet(p).collect())
    assert ids(accepted) == sorted(f"{k}-{i}" for k in range(3) for i in range(9) if i % 3)
    assert ids(rejected) == sorted(f"{k}-{i}" for k in range(3) for i in range(9) if i % 3 == 0)
    assert {r["policy_reason"] for r in spark.read.parquet(rejected).collect()} == {"no-time"}


def keep_largest(before, rows):
    return before.unionByName(rows).groupBy("k").agg(F.max("v").alias("v"))


def test_a_batch_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    table, schema = BucketTable(spark, str(tmp_path), ["k"], "k long, v long", 16), "k long, v long"
    rows = lambda pairs: spark.createDataFrame(pairs, schema)
    table.apply(rows([(k, 0) for k in range(500)]), 0, keep_largest)
    table.apply(rows([(7, 5), (8, -1), (1000, 1)]), 1, keep_largest)
    want = {k: 0 for k in range(500)} | {7: 5, 1000: 1}
    assert {r["k"]: r["v"] for r in table.read().collect()} == want
    touched = {r[0] for r in rows([(7, 0), (8, 0), (1000, 0)]).select(table.bucket()).collect()}
    written = {p.name for p in (tmp_path / "data/version=1").iterdir() if p.name.startswith("bucket=")}
    assert written == {f"bucket={b}" for b in touched} and len(touched) < 16
    table.apply(rows([(1, 99)]), 1, keep_largest)  # the same batch again, whatever it holds: a no-op
    table.apply(rows([]), 2, keep_largest)
    assert {r["k"]: r["v"] for r in table.read().collect()} == want
    with pytest.raises(OSError):  # fails after data, before the manifest: readers see the version before
        table.manifests.write, whole = lambda *a: (_ for _ in ()).throw(OSError("lost")), table.manifests.write
        table.apply(rows([(2, 77)]), 3, keep_largest)
    table.manifests.write = whole
    assert {r["k"]: r["v"] for r in table.read().collect()} == want
    table.apply(rows([(2, 78)]), 3, keep_largest)
    table.apply(rows([(3, 0)]), 4, lambda before, new: before.filter("false"))  # a bucket may become empty
    left = {r["k"]: r["v"] for r in table.read().collect()}
    assert left[2] == 78 and 3 not in left and set(left) < set(want)
    table.vacuum()
    assert {r["k"]: r["v"] for r in table.read().collect()} == left
    assert not any(p.name.startswith("bucket=") and int(p.name[7:]) in touched for p in (tmp_path / "data/version=0").iterdir())


def test_an_upsert_stream_equals_the_batch_result(spark, tmp_path):
    rng, path = random.Random(4), str(tmp_path / "in")
    rows = [(rng.randrange(40), rng.randrange(1000)) for _ in range(200)]
    for i in range(0, 200, 50):
        land(spark, path, rows[i : i + 50], "k long, v long")
    jobs.upsert(jobs.read_files(spark, path, "k long, v long", per_trigger=1), ["k"], keep_largest, "k long, v long", str(tmp_path / "t"), str(tmp_path / "c"), buckets=4)
    want = {}
    for k, v in rows:
        want[k] = max(v, want.get(k, v))
    assert {r["k"]: r["v"] for r in BucketTable(spark, str(tmp_path / "t"), ["k"], "k long, v long", 4).read().collect()} == want


def test_snapshots_age_and_unfinished_ones_are_not_served(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path))
    with pytest.raises(LookupError):
        kept.latest()
    kept.publish(spark.createDataFrame([(1,)], "x int"), 0, BASE)
    kept.publish(spark.createDataFrame([(2,)], "x int"), 1, BASE + timedelta(minutes=10))
    spark.createDataFrame([(3,)], "x int").write.parquet(f"{tmp_path}/data/version=2")  # being built
    for minutes, state in ((20, "fresh"), (40, "fresh"), (41, "stale"), (70, "stale"), (71, None)):
        got = kept.served(F.lit(BASE + timedelta(minutes=minutes)), 1800, 3600).collect()
        assert [(r["x"], r["version"], r["age_seconds"], r["state"]) for r in got] == ([(2, 1, 60.0 * (minutes - 10), state)] if state else [])
    assert [r["state"] for r in kept.served(F.lit(BASE + timedelta(days=9)), 1800).collect()] == ["stale"]
    kept.prune(1)
    assert kept.done.numbers() == [1] and [r["x"] for r in kept.latest().collect()] == [2]


def test_a_snapshot_carries_the_time_of_its_trigger(spark, tmp_path):
    land(spark, str(tmp_path / "in"), [("a", BASE), ("b", BASE)])
    count = lambda rows: rows.groupBy("k").agg(F.count("*").alias("n"))
    add = lambda both: both.groupBy("k").agg(F.sum("n").alias("n"))
    for merge in (add, None):
        out = str(tmp_path / f"out{merge is None}")
        for _ in range(2):
            jobs.snapshot(jobs.read_files(spark, str(tmp_path / "in"), SCHEMA), count, out, out + "-check", merge)
            land(spark, str(tmp_path / "in"), [("a", BASE)])
        served = Snapshots(spark, f"{out}/snapshot").served(F.current_timestamp(), 3600).collect()
        assert {r["version"] for r in served} == {1} and all(0 <= r["age_seconds"] < 300 and r["state"] == "fresh" for r in served)
        assert {r["k"]: r["n"] for r in jobs.latest(spark, out).collect()}["b"] == 1
