"""Names of a dimension table found in texts: one automaton over all names, or a join by their beginnings."""

from __future__ import annotations

import functools
import uuid

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of names that one automaton, and so one broadcast, may hold.
MOST_CHARS = 8_000_000
#: Beyond that, names meet texts by so many of their first characters.
HEAD = 4


@functools.lru_cache(maxsize=4)
def automaton(held) -> ahocorasick.Automaton:
    """Built once a worker."""
    out = ahocorasick.Automaton()
    for name in held.names.value:
        out.add_word(name, name)
    out.make_automaton()
    return out


class Held:
    """A broadcast that workers can tell apart."""

    def __init__(self, names):
        self.names, self.ident = names, uuid.uuid4().hex

    def __hash__(self):
        return hash(self.ident)

    def __eq__(self, other):
        return self.ident == other.ident


def names_in(rows: DataFrame, text: str, names: DataFrame, name: str = "name", out: str = "names", most_chars: int = MOST_CHARS) -> DataFrame:
    """``rows`` with ``out``: the distinct names of a table that the text holds, longest first, then in order.

    The names' total size is counted first.  Up to ``most_chars`` they are
    broadcast, and each text is read once, whatever the number of names; beyond
    that texts and names meet in a join by the names' first characters.  Matching
    is by plain containment; empty and null names never match, and a null text holds none.
    """
    clean = names.select(F.col(name).cast("string").alias("_name")).filter("_name != ''").distinct()
    size = clean.agg(F.coalesce(F.sum(F.length("_name") + 1), F.lit(0))).first()[0]
    if size <= most_chars:
        return by_automaton(rows, text, clean, out)
    return by_heads(rows, text, clean, out)


def by_automaton(rows: DataFrame, text: str, clean: DataFrame, out: str) -> DataFrame:
    """``clean`` is small enough: names_in() has counted it."""
    held = Held(rows.sparkSession.sparkContext.broadcast([r[0] for r in clean.collect()]))

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        tree = automaton(held)
        found = [set() if t is None or not len(tree) else {n for _, n in tree.iter(t)} for t in texts]
        return pd.Series([sorted(f, key=lambda n: (-len(n), n)) for f in found], dtype=object)

    return rows.withColumn(out, find(F.col(text).cast("string")))


def by_heads(rows: DataFrame, text: str, clean: DataFrame, out: str) -> DataFrame:
    """Each distinct text's substrings of one to HEAD characters meet the names that begin with (or are) them."""
    heads = clean.withColumn("_head", F.substring("_name", 1, HEAD))
    texts = rows.select(F.col(text).cast("string").alias("_text")).filter("_text is not null").distinct()
    at = F.sequence(F.lit(1), F.length("_text"))
    grams = F.array_distinct(F.flatten(F.transform(at, lambda k: F.transform(F.sequence(F.lit(1), F.lit(HEAD)), lambda n: F.substr(F.col("_text"), k, n)))))
    met = texts.filter("_text != ''").withColumn("_head", F.explode(grams)).join(heads, "_head").filter(F.contains("_text", F.col("_name")))
    ranked = met.groupBy("_text").agg(F.array_sort(F.collect_set(F.struct((-F.length("_name")).alias("n"), F.col("_name").alias("name")))).alias("_found"))
    joined = rows.join(ranked, F.col(text).cast("string") == F.col("_text"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_found.name"), F.array().cast("array<string>"))).drop("_text", "_found")


def longest_name(names: str = "names"):
    """The longest known name that a text holds; of equally long ones the first in order."""
    return F.get(F.col(names), F.lit(0))


def uncovered(names: str, cover: str):
    """The names of a thesis that no text of ``cover`` (an array) holds."""
    return F.filter(names, lambda n: ~F.exists(cover, lambda t: F.contains(t, n)))
