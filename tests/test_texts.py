"""Containment among parts and budgeted composition against loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gleanery.functions import contained as C


@pytest.mark.parametrize("few", [0, 48])
def test_contained_parts_equal_all_pairs(monkeypatch, few):
    monkeypatch.setattr(C, "FEW", few)
    rng = random.Random(few)
    for _ in range(200):
        parts = list(dict.fromkeys("".join(rng.choice("ab\U0001f600é") for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(0, 60))))
        assert C.contained(parts).tolist() == [any(a in b for b in parts if b != a) for a in parts]


def test_twenty_thousand_lines_take_seconds():
    rng = random.Random(1)
    lines = list(dict.fromkeys(" ".join(rng.choice(["alpha", "be", "gamma", "x", "delta"]) + str(rng.randrange(300)) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)))
    began = time.perf_counter()
    got = C.contained(lines)
    assert time.perf_counter() - began < 20
    whole = "\n".join(lines)
    for k in rng.sample(range(len(lines)), 300):  # another occurrence than the line itself
        a = lines[k]
        assert got[k] == (whole.count(a) > 1), a


def test_nulls_empty_and_repeated_parts(spark):
    rows = [(["a", "b", "a", "ab"],), ([],), (None,), ([None, "x", "xy"],), ([""],), (["", "q"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "p array<string>").coalesce(1).select(C.uncontained(F.col("p"))).collect()]
    assert got == [["ab"], [], None, ["xy"], [""], ["q"]]


def loop_unique(parts):
    seen = []
    for p in parts:
        p = " ".join((p or "").split())
        k = next((k for k, e in enumerate(seen) if p in e or e in p), None)
        if p and k is None:
            seen.append(p)
        elif p and len(p) > len(seen[k]):
            seen[k] = p
    return " ".join(seen)


def loop_summary(h1, og, lead, later, listing, wanted, most):
    import re

    plain = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()
    known = listing is not None and len(plain(listing)) >= 6 and (not (h1 or "").strip() or plain(listing) in plain(h1) or plain(h1) in plain(listing))
    parts = [h1] if h1 and listing is not None and not known else []
    parts += [og] if og else []
    for p in lead or []:
        if parts and len(loop_unique([*parts, p])) > most:
            break
        parts.append(p)
    for p in later or []:
        if wanted in p:
            if len(loop_unique([*parts, p])) > most:
                break
            parts.append(p)
    return loop_unique(parts)[:most]


def test_composed_summaries_equal_the_loop(spark):
    from gleanery.functions import summaries as S

    rng = random.Random(7)
    say = lambda: " ".join(rng.choice(["a", "bb", "c c", "zz", "launch", "now"]) for _ in range(rng.randrange(0, 7)))
    rows = [(say() or None, rng.choice([None, "", say()]), [say() for _ in range(rng.randrange(0, 5))], rng.choice([None, [say() for _ in range(4)]]), rng.choice([None, "", "a", say()])) for _ in range(300)]
    rows += [("Big heading here", "og", ["x" * 90], ["now"], "other title"), ("Big heading here", None, [], [], "big HEADING"), ("", "", ["x" * 90, "y"], None, "listing title"), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "h1 string, og string, lead array<string>, later array<string>, listing string")
    got = [r[0] for r in frame.coalesce(1).select(S.compose(F.col("h1"), F.col("og"), F.col("lead"), F.col("later"), F.col("listing"), lambda p: F.contains(p, F.lit("now")), 40)).collect()]
    assert got == [loop_summary(*r, "now", 40) for r in rows]
    assert len({len(x) for x in got}) > 10 and max(map(len, got)) == 40


def test_leads_end_at_the_first_heading_below_the_title(spark):
    from gleanery.functions import summaries as S

    long = "This sentence is surely long enough."
    html = f"<h1>T</h1><p>Short.</p><p>{long} <b>Second</b> sentence, just as long! Tiny. Third one that is long too?</p><h2>H</h2><p>After the heading comes this.</p>"
    row = spark.createDataFrame([(html,), ("",)], "h string").coalesce(1).select(*[x.alias(n) for x, n in zip(S.lead_and_later(F.col("h")), ("lead", "later"))]).collect()
    assert row[0]["lead"] == [long, "Second sentence, just as long!"] and row[0]["later"] == ["After the heading comes this."]
    assert row[1]["lead"] == [] and row[1]["later"] == []


def test_names_by_automaton_and_by_join_equal_a_loop(spark):
    from gleanery.operators import names as N

    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abc é😀") for _ in range(n))
    known = [say(rng.randrange(0, 7)) for _ in range(60)] + [None, "", "abc", "abcabc", "x"]
    texts = [(k, say(rng.randrange(0, 30)), "names") for k in range(80)] + [(90, None, ""), (91, "", ""), (92, "abcabc", ""), (92, "abcabc", "")]
    rows, dim = spark.createDataFrame(texts, "id int, text string, name string"), spark.createDataFrame([(n,) for n in known], "name string")
    want = sorted((i, sorted({n for n in known if n and n in (t or "")}, key=lambda n: (-len(n), n))) for i, t, _ in texts)
    for most in (10_000, 10):
        got = N.names_in(rows, "text", dim, most_chars=most).withColumn("best", N.longest_name()).collect()
        assert sorted((r["id"], r["names"]) for r in got) == want
        assert all(r["best"] == (r["names"][0] if r["names"] else None) for r in got)
    assert [r["names"] for r in N.names_in(rows, "text", dim.limit(0)).limit(2).collect()] == [[], []]
    cover = N.names_in(rows, "text", dim).withColumn("cover", F.array(F.lit("abcab"), F.lit("c"))).select("names", N.uncovered("names", "cover").alias("bad")).collect()
    assert all(r["bad"] == [n for n in r["names"] if n not in "abcab" and n not in "c"] for r in cover)


def test_a_hundred_thousand_names(spark):
    from gleanery.operators import names as N

    dim = spark.range(100_000).select(F.concat(F.lit("product "), F.col("id") * 7).alias("name"))
    rows = spark.range(2_000).select("id", F.concat(F.lit("the product "), F.col("id") * 7, F.lit(" and more")).alias("text"))
    began = time.perf_counter()
    got = N.names_in(rows, "text", dim).select("id", N.longest_name().alias("best")).collect()
    assert time.perf_counter() - began < 60
    assert all(r["best"] == f"product {r['id'] * 7}" for r in got) and len(got) == 2_000


def test_copy_takes_the_first_template_that_fits(spark):
    from gleanery.operators import copy

    who = [("g", "SUPPLY", "Ada", "fa"), ("g", "SUPPLY", "Ada", "fb"), ("g", "ADOPTION", "Bo", "fx"), ("h", "CAPABILITY", "Cy", "fc"), ("h", "CAPABILITY", "Di", "fc"), ("h", "CAPABILITY", "Ed", ""), ("k", "ADOPTION", "Bo", "fx")]
    members = spark.createDataFrame(who, "group_id string, role string, organization string, product_family string")
    rows = [
        ("g", 1, ["SUPPLY"], ["ADOPTION"], 0, "A", "x", "never changing", "", "", "v"), ("g", 2, ["SUPPLY", "ADOPTION"], [], 2, "B", "x", "too few, changing", "", "", "v"), ("g", 3, ["SUPPLY"], [], 1, "C", "{supply}", "{supply} {supply?is|are} shipping; {families} fails $1", "{all}", "i", "v"),
        (None, 5, ["CAPABILITY"], ["SUPPLY"], None, "D", "{capability}", "{capability} {capability?is|are} converging, says Zed", "", "", "w"), (None, 9, [], [], 0, "E", "{all}", "no direction", "", "", "w"),
    ]
    known = spark.createDataFrame([("Zed",), ("Cy",), ("ada",)], "name string")
    got = {r["group_id"]: r for r in copy.synthesize(members, spark.createDataFrame(rows, copy.TEMPLATE), known).collect()}
    assert set(got) == {"g", "h"}  # the thesis of k has no direction
    assert (got["g"]["type"], got["g"]["thesis"], got["g"]["why"], got["g"]["violations"]) == ("C", "Ada is shipping; fx fails $1", "Ada and Bo", [])
    assert (got["h"]["headline"], got["h"]["thesis"], got["h"]["violations"]) == ("Cy, Di, and Ed", "Cy, Di, and Ed are converging, says Zed", ["zed"])
    assert copy.synthesize(members.limit(0), spark.createDataFrame(rows, copy.TEMPLATE)).collect() == []


def test_a_decider_that_raises_leaves_other_pairs_alone(spark):
    from gleanery.operators import deciders

    asked = []

    def decider(pairs):
        asked.append(len(pairs))
        if (pairs["left_n"] % 13 == 7).any():
            raise RuntimeError("boom")
        return pairs["left_n"].lt(pairs["right_n"]).astype(object).where(pairs["left_n"] != 3, None)

    import pandas as pd

    frame = pd.DataFrame({"left_n": range(100), "right_n": [50] * 100})
    got = deciders.answers(frame, decider)
    assert [bool(a) for a in got["answer"]] == [n < 50 and n % 13 != 7 and n != 3 for n in range(100)]
    assert [e for e in got["error"] if e] == ["RuntimeError: boom"] * 8 and len(asked) < 100
    assert set(deciders.answers(frame, lambda p: [])["error"]) == {"ValueError: 0 answers to 1 pairs"} and not len(deciders.answers(frame[:0], decider))
    records = spark.createDataFrame([(f"r{k}", k) for k in range(40)], "id string, n int")
    decided = spark.createDataFrame([(f"r{k}", f"r{k + 1}", [True, False, None][k % 3]) for k in range(39)], "left_id string, right_id string, decision boolean")

    def strict(pairs):
        if (pairs["left_n"] % 3 != 2).any():
            raise AssertionError("decided pairs must not be asked")
        if (pairs["left_n"] == 5).any():
            raise KeyError("five")
        return pairs["left_n"] > 20

    rows = {int(r["left_id"][1:]): (r["matched"], r["error"]) for r in deciders.decide_rest(decided, records, ["n"], strict).collect()}
    assert rows == {k: ([True, False][k % 3], None) if k % 3 < 2 else (k > 20, "KeyError: 'five'" if k == 5 else None) for k in range(39)}


def test_upper_case_keeps_the_number_of_letters(spark):
    import duckdb

    from gleanery.functions.text import LONG_UPPER, upper_word
    from gleanery.operators.briefs import capitalised, humanised

    words = [*LONG_UPPER, "ßa", "aß", "éß", "ab"]
    want = dict(duckdb.connect().execute("SELECT x, upper(x) FROM (SELECT unnest(?) AS x)", [words]).fetchall())
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", upper_word(F.col("w")).alias("up")).collect()
    assert {r["w"]: r["up"] for r in got} == want
    row = spark.createDataFrame([("ßheit und",)], "t string").select(capitalised(F.col("t")).alias("a"), humanised(F.lit("ß-ßab")).alias("b")).first()
    assert tuple(row) == ("ẞheit und", "ẞ ẞab")
