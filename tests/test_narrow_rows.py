"""Whole texts and pages stay out of joins, stores and shuffles of the feed."""

from gleanery.plans import queries_jobs, views


def optimized(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_heads_are_cut_before_the_join(spark, sf_dir):
    for rows, cut in ((views.items(spark, sf_dir).select("id", "title", "trend"), "substring("), (views.records(spark, sf_dir).select("id", "title"), "regexp_extract(html")):
        plan = optimized(rows)
        assert plan.index("Join ") < plan.index(cut)


def test_papers_are_judged_without_their_texts(spark, sf_dir):
    staged = queries_jobs.staged_papers(spark, sf_dir)
    assert not {"text", "title"} & set(staged.columns)
    origins = {r[0] for r in staged.select("origin").collect()}
    assert origins <= {r[0] for r in views.table(spark, sf_dir, "documents").select("doc_id").collect()}
    assert "html" not in optimized(queries_jobs.feed_rows(spark, sf_dir)) and "Join" not in optimized(queries_jobs.feed_rows(spark, sf_dir))


def test_rows_are_accepted_by_one_shuffle_and_two_windows(spark):
    from pyspark.sql import functions as F

    from gleanery.operators import dedupe

    rows = spark.createDataFrame([(1, 1, "a", False), (1, 2, "a", False), (1, 3, "b", True), (1, 4, "b", False), (1, 5, None, False), (1, 6, None, False), (2, 7, "a", True), (2, 8, "a", False)], "g int, id int, k string, bad boolean")
    out = dedupe.capped_accept(rows, "g", "id", [F.col("id")], [F.col("k")], F.when(F.col("bad"), "bad"), 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 2
    assert {r["id"]: r["outcome"] for r in out.collect()} == {1: "accepted", 2: "duplicate", 3: "bad", 4: "accepted", 5: "accepted", 6: "accepted", 7: "bad", 8: "accepted"}
