"""Streaming queries: the events table as it lands, equal to the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators.storage import scratch
from gleanery.plans import views
from gleanery.plans.registry import query
from gleanery.streaming import jobs
from gleanery.streaming.tables import BucketTable, Snapshots

c = F.col
FAR = "2100-01-01"


def events(spark, d):
    """The events table as a stream of files."""
    schema = views.table(spark, d, "events").schema
    path = scratch(spark, "landed")
    views.table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp")).repartitionByRange(4, "ts").write.parquet(path)
    schema = spark.read.parquet(path).schema
    return jobs.read_files(spark, path, schema), path


def closed(spark, d, extra: dict):
    """The stream and one row far in the future that closes all windows."""
    stream, path = events(spark, d)
    last = spark.read.parquet(path).limit(1)
    last.withColumns({"ts": F.lit(FAR).cast("timestamp"), **extra}).write.mode("append").parquet(path)
    return jobs.read_files(spark, path, spark.read.parquet(path).schema)


@query("st1_snapshot_refresh", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def st1(spark, d):
    stream, _ = events(spark, d)
    out = scratch(spark, "snapshot")
    jobs.snapshot(stream, lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n")), out, scratch(spark, "st1"), merge=lambda both: both.groupBy("event_type").agg(F.sum("n").alias("n")))
    return jobs.latest(spark, out)


@query("st2_first_seen", "SELECT user_id, event_type FROM events GROUP BY ALL")
def st2(spark, d):
    stream, _ = events(spark, d)
    out = scratch(spark, "seen")
    jobs.to_table(jobs.first_seen(stream, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), out, scratch(spark, "st2"))
    return spark.read.parquet(out)


@query("st3_anchored_windows", """WITH a AS (WITH RECURSIVE a(event_type, user_id, start) AS (SELECT event_type, user_id, min(ts) FROM events GROUP BY ALL UNION ALL
    SELECT a.event_type, a.user_id, min(e.ts) FROM a JOIN events e ON e.event_type = a.event_type AND e.user_id = a.user_id AND e.ts > a.start + INTERVAL 2 DAY GROUP BY a.event_type, a.user_id, a.start) SELECT * FROM a)
  SELECT e.event_type, e.user_id, date_trunc('millisecond', start) AS window_start, count(*) AS n FROM events e ASOF JOIN a ON e.event_type = a.event_type AND e.user_id = a.user_id AND e.ts >= a.start GROUP BY ALL""")
def st3(spark, d):
    stream = closed(spark, d, {"event_type": F.lit("~end"), "user_id": F.lit(-1).cast("long")})
    out = scratch(spark, "anchored")
    jobs.to_table(jobs.anchored_counts(stream, ["event_type", "user_id"], "ts", 2, "60 days"), out, scratch(spark, "st3"))
    return spark.read.parquet(out).filter("event_type != '~end'").withColumn("window_start", F.date_trunc("millisecond", "window_start"))


@query("st4_tumbling_counts", "SELECT make_timestamp(CAST(floor(epoch_ms(ts) / 1209600000.0) * 1209600000000 AS BIGINT)) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st4(spark, d):
    stream = closed(spark, d, {"event_type": F.lit("~end")})
    out = scratch(spark, "tumbling")
    jobs.to_table(jobs.tumbling_counts(stream, ["event_type"], "ts", "14 days", "60 days"), out, scratch(spark, "st4"))
    return spark.read.parquet(out).filter("event_type != '~end'")


@query("st5_late_policy", "SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'future' WHEN ts < TIMESTAMP '2024-01-20' - INTERVAL 10 DAY THEN 'late' ELSE 'ok' END AS reason FROM events")
def st5(spark, d):
    stream, _ = events(spark, d)
    out = scratch(spark, "policy")
    rows = jobs.with_policy(stream, "ts", F.lit("2024-01-20").cast("timestamp"), 10).select("event_id", F.coalesce("policy_reason", F.lit("ok")).alias("reason"))
    jobs.to_table(rows, out, scratch(spark, "st5"))
    return spark.read.parquet(out)


TWO_SINKS = """WITH p AS (SELECT event_id, user_id, CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'future' WHEN ts < TIMESTAMP '2024-01-20' - INTERVAL 10 DAY THEN 'late' END AS reason FROM events)
  SELECT 'accepted' AS sink, event_id, user_id, CAST(NULL AS VARCHAR) AS reason FROM p WHERE reason IS NULL UNION ALL SELECT 'rejected', event_id, user_id, reason FROM p WHERE reason IS NOT NULL"""


@query("st5_two_sinks", TWO_SINKS)
def st5_sinks(spark, d):
    """Rows outside the window go to a table of their own, with the reason, from the same batches."""
    stream, _ = events(spark, d)
    accepted, rejected = scratch(spark, "accepted"), scratch(spark, "rejected")
    rows = jobs.with_policy(stream, "ts", F.lit("2024-01-20").cast("timestamp"), 10).select("event_id", "user_id", c("policy_reason").alias("reason"))
    jobs.split_sinks(rows, "reason", accepted, rejected, scratch(spark, "st5"))
    kept = spark.read.parquet(accepted).select(F.lit("accepted").alias("sink"), "event_id", "user_id", F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(spark.read.parquet(rejected).select(F.lit("rejected").alias("sink"), "event_id", "user_id", "reason"))


@query("st1_served_snapshot", "SELECT event_type, count(*) AS n, 3::BIGINT AS version, 'fresh' AS state FROM events GROUP BY event_type")
def st1_served(spark, d):
    """The snapshot after four batches, as a reader gets it within its time to live."""
    stream, path = events(spark, d)
    out = scratch(spark, "snapshot")
    one_by_one = jobs.read_files(spark, path, spark.read.parquet(path).schema, per_trigger=1)
    jobs.snapshot(one_by_one, lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n")), out, scratch(spark, "st1"), merge=lambda both: both.groupBy("event_type").agg(F.sum("n").alias("n")))
    return Snapshots(spark, f"{out}/snapshot").served(F.current_timestamp(), ttl_seconds=86_400).select("event_type", "n", "version", "state")


@query("st6_continuous_upsert", "SELECT user_id, max(event_id) AS v, false AS locked FROM events GROUP BY user_id")
def st6(spark, d):
    stream, _ = events(spark, d)
    out, schema = scratch(spark, "upsert"), "user_id long, v long, locked boolean"

    def merge(before, rows):
        new = rows.groupBy("user_id").agg(F.max("event_id").alias("v"))
        both = before.select("user_id", "v").unionByName(new).groupBy("user_id").agg(F.max("v").alias("v"))
        return both.join(before.select("user_id", "locked"), "user_id", "left").select("user_id", "v", F.coalesce("locked", F.lit(False)).alias("locked"))

    jobs.upsert(stream, ["user_id"], merge, schema, out, scratch(spark, "st6"))
    return BucketTable(spark, out, ["user_id"], schema).read()


@query("w8_snapshot_write", "SELECT event_type, user_id % 3 AS run_id, count(*) AS n FROM events WHERE user_id % 3 = 2 GROUP BY ALL")
def w8(spark, d):
    """Reports are written by run; the latest run is read by pruning."""
    out = scratch(spark, "reports")
    rows = views.activity(spark, d).groupBy("event_type", (c("user_id") % 3).alias("run_id")).agg(F.count("*").alias("n"))
    rows.write.partitionBy("run_id").parquet(out)
    saved = spark.read.schema("event_type string, n long, run_id long").parquet(out)
    return saved.join(F.broadcast(saved.agg(F.max("run_id").alias("run_id"))), "run_id")
