"""Items of a feed and the insights that cite them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = "dc-"  # fixed value: community items may carry it where their evidence does not, and the other way round


def spellings(id_: Column, prefix: str = PREFIX) -> Column:
    """The ids that an item may have whose evidence has this one: itself, with the prefix, and without it."""
    bare = F.when(F.startswith(id_, F.lit(prefix)), F.substring(id_, len(prefix) + 1, 1 << 30))
    return F.array_compact(F.array(id_, F.concat(F.lit(prefix), id_), bare))


def insight_links(items: DataFrame, cited: DataFrame, id_col: str, object_col: str, order: Sequence[Column], shown: Sequence[str], prefix: str = PREFIX) -> DataFrame:
    """Each item with the ``shown`` columns of the first insight that cites it, nulls without one.

    ``cited`` has a row per insight and cited object; ``order`` says which insight
    is first and has to be total over insights.  Spellings of an object are
    reduced to one insight each before they meet the items, so an object
    that many insights cite is one row of the join.  Null ids are linked to
    nothing; repeated items are linked alike.
    """
    ranks = [f"_o{k}" for k in range(len(order))]
    refs = cited.select(*[o.alias(n) for n, o in zip(ranks, order)], *shown, F.explode(spellings(F.col(object_col), prefix)).alias("_ref"))
    first = refs.groupBy("_ref").agg(F.min(F.struct(*ranks, *shown)).alias("_first")).select("_ref", *[F.col("_first")[s].alias(s) for s in shown])
    return items.join(first, F.col(id_col) == F.col("_ref"), "left").drop("_ref")


def sort_place(feed: str, mode: str, seat: str = "seat", column=F.col) -> Column:
    """The place of an item among its feed's seated ones: ``ranked``, ``newest``, ``impact`` or ``trend``; equal rows keep the ranking's order."""
    by = {"ranked": [], "newest": [column("published_at").desc_nulls_last()], "impact": [column("impact").desc_nulls_last()], "trend": [column("novelty").desc_nulls_last()]}[mode]
    return F.row_number().over(Window.partitionBy(feed).orderBy(*by, column(seat)))
