"""Links from items to the insights that cite them, and the orders of a feed."""

from pyspark.sql import functions as F

from gleanery.operators import links


def same(item, obj):
    """The rule in words: equal, or one is the other with the prefix."""
    return item is not None and obj is not None and (item == obj or item == "dc-" + obj or obj == "dc-" + item)


def test_links_equal_the_rule(spark):
    ids = ["a", "dc-a", "dc-dc-a", "b", "dc-", "", "dc-b", "x", None]
    cited = [(k, n, o) for k, n in enumerate(["late", "early", "mid"]) for o in ids[k::2]]
    items = spark.createDataFrame([(i, k) for k, i in enumerate(ids)] + [("a", 99)], "id string, k int")
    rows = spark.createDataFrame([(10 - k, n, o, "extra") for k, n, o in cited], "place int, insight string, object string, k string")
    got = links.insight_links(items, rows, "id", "object", [F.col("place"), F.col("insight")], ["insight"])
    assert got.columns == ["id", "k", "insight"]
    found = {r["k"]: r["insight"] for r in got.collect()}
    for k, item in [*enumerate(ids), (99, "a")]:
        fits = sorted((10 - n, name) for n, name, o in cited if same(item, o))
        assert found[k] == (fits[0][1] if fits else None), item
    assert len(found) == len(ids) + 1


def test_links_of_empty_tables(spark):
    items = spark.createDataFrame([("a",)], "id string")
    none = spark.createDataFrame([], "place int, insight string, object string")
    assert links.insight_links(items, none, "id", "object", [F.col("place")], ["insight"]).collect()[0]["insight"] is None
    some = spark.createDataFrame([(1, "i", "a")], none.schema)
    assert links.insight_links(items.limit(0), some, "id", "object", [F.col("place")], ["insight"]).count() == 0


def test_orders_keep_the_ranking_among_equals(spark):
    rows = spark.createDataFrame([("f", 1, 5, 50, 1), ("f", 2, 7, 50, None), ("f", 3, 7, 90, 3), ("g", 1, None, 1, 1)], "feed string, seat int, published_at int, impact int, novelty int")
    got = {(r["feed"], r["seat"]): tuple(r)[2:] for r in rows.select("feed", "seat", *[links.sort_place("feed", m).alias(m) for m in ("ranked", "newest", "impact", "trend")]).collect()}
    assert got == {("f", 1): (1, 3, 2, 2), ("f", 2): (2, 1, 3, 3), ("f", 3): (3, 2, 1, 1), ("g", 1): (1, 1, 1, 1)}
