"""Registered queries against their oracles on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [q for q in entry.catalog.QUERIES]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)

    def show(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(pd.Timestamp(v)) if isinstance(v, pd.Timestamp) else str(v)

    return sorted("|".join(map(show, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", CORE)
def test_query_equals_oracle(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_roll_up_joins_evidence_once_and_counts_without_expansion(spark, sf_dir):
    from gleanery.plans import queries_findings as qf

    plan = qf.rolled(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "Expand" not in plan


def test_community_briefs_join_evidence_once(spark, sf_dir):
    from gleanery.plans import queries_copy

    assert "l_orderkey" not in queries_copy.community_briefs(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
