"""Ranking by times that pandas' nanoseconds do not reach, and by none."""

import os
import random
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleanery.operators import ranking
from gleanery.plans import views
from tests.test_kernels import items
from tests.test_queries import TABLES, rows_of

SCHEMA = "feed string, id string, attention string, role string, tier string, organization string, topic string, published_at long, impact int, novelty int"
IN_2296 = 10_308_715_200_000_000  # microseconds


def ranked(spark, rows, seats):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("published_at", F.timestamp_micros(F.col("published_at") + IN_2296))
    return [r["id"] for r in ranking.rank_feed(frame, "feed", seats).orderBy("seat").collect()]


def test_rows_of_any_century_are_ranked_to_the_microsecond(spark):
    rng = random.Random(11)
    rows = [r | {"published_at": rng.choice([None, *range(40)])} for r in items(rng, 120)]
    want = [rows[i]["id"] for i in ranking.seat_order(rows, 8)]
    assert len(want) == 8 and ranked(spark, rows, 8) == want


def test_rows_without_a_time_take_no_seat(spark):
    base = items(random.Random(3), 1)[0] | {"attention": "HIGH"}
    rows = [base | {"id": "a", "published_at": 1}, base | {"id": "b", "published_at": 2}, base | {"id": "c", "published_at": None}, base | {"id": "d", "attention": "BACKGROUND", "published_at": 3}]
    assert ranked(spark, rows, 8) == ["b", "a"]


@pytest.fixture(scope="module")
def far(spark, sf_dir, tmp_path_factory):
    """The smallest tables with each document and label twice, the second time by an id that leads to 2296."""
    to = tmp_path_factory.mktemp("far")
    for name in os.listdir(sf_dir):
        if name not in ("documents.parquet", "labels.parquet"):
            shutil.copy(f"{sf_dir}/{name}", to)
    for name in ("documents", "labels"):
        rows = views.table(spark, sf_dir, name)
        rows.unionByName(rows.withColumn("doc_id", F.col("doc_id") + 2_390_000)).coalesce(1).write.parquet(f"{to}/{name}.parquet")
    return str(to)


@pytest.mark.parametrize("name", ["g7_greedy_ranking", "e5_linked_feed", "e5_unified_feed"])
def test_feeds_of_far_documents_equal_the_oracle(spark, far, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{far}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{far}/{t}.parquet') else ''}'")
    got, want = entry.queries()[name](spark, far).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
