"""The iterative kernels against plain sequential loops on random cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.operators import components, dedupe, ranking, windows


def naive_windows(times, width):
    out, start = {}, None
    for t in sorted(times):
        if start is None or t - start > width:
            start = t
        out[t] = start
    return out


def test_anchored_windows_equal_the_loop(spark):
    rng = random.Random(1)
    base = datetime(2024, 1, 1)
    rows = [(k, base + timedelta(hours=rng.randrange(2000))) for k in range(12) for _ in range(rng.randrange(1, 40))] + [(99, None)]
    got = windows.anchored_windows(spark.createDataFrame(rows, "k int, ts timestamp"), ["k"], "ts", 5).collect()
    want = {k: naive_windows([t for kk, t in rows if kk == k and t], timedelta(days=5)) for k in range(12)}
    for r in got:
        assert r["window_start"] == (want[r["k"]][r["ts"]] if r["ts"] else None)
    assert len(got) == len(rows)


def test_a_window_includes_its_last_moment(spark):
    days = ["2026-08-12", "2026-07-29", "2026-08-30"]
    rows = spark.createDataFrame([("a", d) for d in days] + [("b", days[0])], "k string, d string").withColumn("ts", F.col("d").cast("timestamp"))
    got = {(r["k"], r["d"]): str(r["window_start"].date()) for r in windows.anchored_windows(rows, ["k"], "ts", 14).collect()}
    assert got == {("a", "2026-07-29"): "2026-07-29", ("a", "2026-08-12"): "2026-07-29", ("a", "2026-08-30"): "2026-08-30", ("b", "2026-08-12"): "2026-08-12"}


def naive_dedupe(rows):
    seen, out = {}, {}
    for i, keys in sorted(rows):
        keys = [k for k in keys if k is not None]
        hit = next((seen[k] for k in keys if k in seen), None)
        out[i] = (hit is None, hit)
        if hit is None:
            seen.update(dict.fromkeys(keys, i))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_dedupe_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [f"a{rng.randrange(25)}" if rng.random() < 0.8 else None, f"b{rng.randrange(25)}" if rng.random() < 0.8 else None]) for i in range(80)]
    df = spark.createDataFrame([(i, *k) for i, k in rows], "id int, k1 string, k2 string")
    got = {r["id"]: (r["kept"], r["target_id"]) for r in dedupe.greedy_dedupe(df, "id", [F.col("id")], [F.col("k1"), F.col("k2")]).collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in naive_dedupe(rows).items()}


def test_greedy_dedupe_is_not_components(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", "y"), (3, None, "y"), (4, None, None)], "id int, k1 string, k2 string")
    got = {r["id"]: r["kept"] for r in dedupe.greedy_dedupe(df, "id", [F.col("id")], [F.col("k1"), F.col("k2")]).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)]
    parent = {i: i for p in pairs for i in p} | {500: 500}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    nodes = spark.createDataFrame([(i,) for i in parent], "id int")
    got = components.connected_components(nodes, spark.createDataFrame(pairs, "left_id int, right_id int")).collect()
    assert {r["id"]: r["component"] for r in got} == {i: find(i) for i in parent}


def items(rng, n):
    return [
        {"feed": "f", "id": f"i{k:03d}", "attention": rng.choice(["HIGH", "HIGH", "MEDIUM", "BACKGROUND"]), "role": rng.choice(["SUPPLY", "ADOPTION", "CAPABILITY"]), "tier": rng.choice(["T1", "T2", None]), "organization": f"o{rng.randrange(6)}",
         "topic": f"t{rng.randrange(4)}", "published_at": datetime(2024, 1, 1) + timedelta(hours=rng.randrange(50)), "impact": rng.randrange(5), "novelty": rng.randrange(3)}
        for k in range(n)
    ]


def test_ranking_of_the_reduced_rows_is_the_whole_ranking(spark):
    rng = random.Random(5)
    rows = items(rng, 120)
    schema = "feed string, id string, attention string, role string, tier string, organization string, topic string, published_at timestamp, impact int, novelty int"
    got = [r["id"] for r in ranking.rank_feed(spark.createDataFrame(rows, schema), "feed", 8).orderBy("seat").collect()]
    rows.sort(key=lambda r: (-r["published_at"].timestamp(), -r["impact"], -r["novelty"], r["id"]))
    assert got == [rows[i]["id"] for i in ranking.seat_order(rows, 8)]


def test_ten_launches_leave_room_for_the_other_roles():
    base = {"attention": "HIGH", "topic": "x", "published_at": datetime(2024, 1, 1), "impact": 1, "novelty": 1}
    rows = [base | {"id": f"t{k}", "role": "SUPPLY", "tier": "T1", "organization": f"o{k}", "topic": f"x{k}"} for k in range(10)]
    rows += [base | {"id": "adopt", "role": "ADOPTION", "tier": None, "organization": "a", "topic": "a"}, base | {"id": "paper", "role": "CAPABILITY", "tier": None, "organization": "p", "topic": "p"}]
    order = [rows[i]["id"] for i in ranking.seat_order(rows, 10)]
    assert order[0].startswith("t") and {"adopt", "paper"} <= set(order)


@pytest.mark.parametrize("closed", [True, False])
def test_window_starts_equal_the_loop(spark, closed):
    from gleanery.operators import windows

    rng = random.Random(31)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), datetime(2024, 1, 1) + timedelta(hours=6 * rng.randrange(400)) if rng.random() < 0.95 else None) for _ in range(3000)]
    want = {}
    for key in {r[:2] for r in rows}:
        for t in sorted({r[2] for r in rows if r[:2] == key and r[2]}):
            starts = want.setdefault(key, [])
            if not starts or t - starts[-1] > timedelta(days=3) or (not closed and t - starts[-1] == timedelta(days=3)):
                starts.append(t)
    frame = spark.createDataFrame(rows, "k string, n long, t timestamp")
    got = windows.window_starts(frame, ["k", "n"], F.col("t"), 3 * windows.DAY, closed).collect()
    epoch = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert sorted(r["_starts"] for r in got) == sorted([epoch(t) for t in v] for v in want.values())


def test_a_long_chain_of_shared_keys_is_decided_to_its_end(spark):
    from gleanery.operators import dedupe

    rng = random.Random(32)
    rows = [(k, f"x{rng.randrange(60)}", f"y{rng.randrange(60)}") for k in range(400)]
    seen, want = set(), []
    for k, a, b in rows:
        want.append((k, not ({a, b} & seen)))
        if want[-1][1]:
            seen |= {a, b}
    frame = spark.createDataFrame(rows, "id long, a string, b string")
    got = dedupe.greedy_dedupe(frame, "id", [F.col("id")], [F.col("a"), F.col("b")]).collect()
    assert sorted((r["id"], r["kept"]) for r in got) == want


def test_headlines_and_presented_briefs(spark):
    from gleanery.operators import briefs

    rows = [
        ("v1.2.0", "It reads maps now. More follows", "lab", None, "Lab: It reads maps now. More follows"),
        ("v1.2.0", "", "lab", None, "Lab ships a new model release"),
        ("Changelog", "The new planner finds routes in half the time. More", "lab", None, "The new planner finds routes in half the time"),
        ("Short", "The new planner finds routes in half the time. More", "exempt", None, "Short"),
        ("A title that is long enough to stay - Official Blog", "x", "lab", None, "A title that is long enough to stay"),
        ("x", "", "hub", "me/great-API_kit", "Great API Kit — x"),
        ("v2.0", "", "hub", "me/great-API_kit", "Great API Kit: notable open-source AI project trending on GitHub"),
        ("", "", "lab", None, "AI update"),
    ]
    frame = spark.createDataFrame(rows, "title string, summary string, source string, repo string, want string")
    for r in briefs.with_headlines(frame, "exempt").collect():
        assert r["headline"] == r["want"]
    brief = [("It failed. 3 independent authors across 5 evidence records.", "structured triage template", "the session was lost again and again", "The session was lost again and again https://a.b/c")]
    got = briefs.presented(spark.createDataFrame(brief, "what_happened string, why_it_matters string, potential_impact string, key_takeaway string")).first()
    assert tuple(got) == ("It failed.", "", "the session was lost again and again", "")


def test_the_rules_of_the_seats():
    def seats(*rows):
        at = [{"attention": "HIGH", "role": "SUPPLY", "tier": None, "organization": f"o{k}", "topic": f"t{k}", "published_at": datetime(2024, 1, 1), "impact": 1, "novelty": 1, "id": f"{k:02d}"} | r for k, r in enumerate(rows)]
        return [at[i]["id"] for i in ranking.seat_order(at, len(at))]

    # the first seat is seeded: SUPPLY before an earlier id of another role, T1 before T2 before none
    assert seats({"role": "ADOPTION"}, {}, {"tier": "T2"}, {"tier": "T1"})[0] == "03"
    # after two of one role another role goes first, even before a T1
    assert seats({"tier": "T1"}, {"role": "ADOPTION"}, {"role": "CAPABILITY"}, {"role": "CAPABILITY", "tier": "T2"}, {"role": "CAPABILITY", "tier": "T1"}, {"role": "ADOPTION"})[:5] == ["00", "01", "02", "04", "05"]
    # a seed role other than SUPPLY takes its latest row, whatever its tier
    late = datetime(2024, 1, 2)
    assert seats({"tier": "T1"}, {"role": "ADOPTION", "tier": "T1"}, {"role": "ADOPTION", "published_at": late})[:2] == ["00", "02"]
    # without a tier impact does not break ties
    assert seats({"role": "BACKGROUND"}, {"role": "BACKGROUND", "impact": 9}) == ["00", "01"]
    # the same organisation or topic only follows itself if nothing else is left
    assert seats({"organization": "a"}, {"organization": "a"}, {"organization": "b", "topic": "t0"}) == ["00", "02", "01"]


def test_round_caps_do_not_end_silently(spark):
    from gleanery.operators import components, dedupe

    chain = spark.createDataFrame([(k, f"k{k}", f"k{k + 1}") for k in range(8)], "id long, a string, b string")
    with pytest.raises(RuntimeError):
        dedupe.greedy_dedupe(chain, "id", [F.col("id")], [F.col("a"), F.col("b")], most_rounds=2)
    got = dedupe.greedy_dedupe(chain, "id", [F.col("id")], [F.col("a"), F.col("b")]).collect()
    assert sorted((r["id"], r["kept"]) for r in got) == [(k, k % 2 == 0) for k in range(8)]
    pairs = spark.createDataFrame([(k, k + 1) for k in range(8)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.connected_components(chain, pairs.withColumnsRenamed({"a": "left_id", "b": "right_id"}), most_rounds=1)

@pytest.mark.parametrize("shape", ["even", "bursts", "gaps", "dense"])
def test_hot_keys_have_the_starts_of_the_loop(spark, shape, monkeypatch):
    """Keys over the fold's limit, by contracted pointers, with lookup buckets of a few times."""
    from gleanery.operators import anchors

    monkeypatch.setattr(anchors, "BUCKET_TIMES", 3)
    monkeypatch.setattr(anchors, "BLOCK", 2)
    rng, width = random.Random(len(shape)), 1000
    pick = {
        "even": lambda: rng.randrange(60_000), "bursts": lambda: rng.choice([0, 7_000, 50_000]) + rng.randrange(900), "gaps": lambda: 1001 * rng.randrange(90) + rng.choice([0, 0, 1, -1]),
        "dense": lambda: rng.randrange(1500),
    }[shape]
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), pick() - 5_000) for _ in range(700)]
    frame = spark.createDataFrame(rows, "k string, us long").withColumn("ts", F.timestamp_micros("us"))
    for closed in {"bursts": (False,), "gaps": (True, False)}.get(shape, (True,)):
        want = set()
        for key in {k for k, _ in rows}:
            limit = None
            for at in sorted({t for k, t in rows if k == key}):
                if limit is None or at >= limit:
                    want.add((key, at))
                    limit = at + width + closed
        got = [tuple(r) for r in anchors.start_rows(frame, ["k"], F.col("ts"), width, closed, most=20).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_one_key_with_most_rows_is_spread_over_tasks(spark):
    """90 % of the rows have one key: tasks that look windows up and that build pointers get like shares."""
    from gleanery.operators import anchors

    rows = spark.range(120_000, numPartitions=8).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("k"), F.timestamp_micros(F.col("id") * 977).alias("ts"))
    times = rows.filter("k = 0").select(F.lit(0).cast("long").alias("_k"), F.count("*").over(anchors.Window.partitionBy("k")).alias("_n"), F.unix_micros("ts").alias("_t"), F.lit(120_000 * 977).cast("long").alias("_span"))
    own = times.withColumn("_b", F.floor(F.col("_t") / F.ceil(F.col("_span") / F.ceil(F.col("_n") / anchors.BUCKET_TIMES))))
    shares = [r["n"] for r in own.groupBy("_b").agg(F.count("*").alias("n")).collect()]
    assert max(shares) <= 2 * sorted(shares)[len(shares) // 2] and max(shares) <= 2 * anchors.BUCKET_TIMES
    got = windows.anchored_windows(rows, ["k"], "ts", 1_000_000 / windows.DAY)
    starts = sorted(r[0] for r in got.filter("k = 0").select(F.unix_micros("window_start")).distinct().collect())
    limit, want = -1, []
    for at in (i * 977 for i in range(120_000) if i % 10 < 9):
        if at >= limit:
            want.append(at)
            limit = at + 1_000_001
    assert starts == want


@pytest.mark.parametrize("most", [3, 10_000])
def test_blocked_pairs_equal_all_pairs_also_in_parts(spark, most):
    """One token that all rows share, spans of any size, ids that repeat, versions that conflict."""
    from gleanery.operators import match

    rng, base = random.Random(most), datetime(2024, 1, 1)
    rows = [(f"r{k:03d}", rng.choice(["o", "p"]), rng.choice(["All", "ALL", None]), rng.choice(["m1", "m2", None]), rng.choice(["1", "2", None, None]), base + timedelta(hours=rng.choice([rng.randrange(30), rng.randrange(900)])) if rng.random() < 0.95 else None) for k in range(160)]
    rows.append(("r999", "o", "", "?!", "1", base))
    clean = lambda r: {x.lower() for x in (r[2], r[3]) if x and x != "?!"}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and clean(a) & clean(b) and a[5] and b[5] and abs(a[5] - b[5]) <= timedelta(days=7) and not (a[4] and b[4] and a[4] != b[4])}
    got = match.candidate_pairs(spark.createDataFrame(rows, "id string, org string, product string, model string, version string, published_at timestamp"), most=most).collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == want and len(want) > 1000


def test_parts_bound_the_rows_of_a_cell(spark):
    """A block of n records in parts of m: every cell of the join has about 2 m rows, whatever n."""
    from gleanery.operators import match

    frame = spark.range(4_000).select(F.concat(F.lit("r"), "id").alias("id"), F.lit("o").alias("org"), F.lit("t").alias("product"), F.lit(None).cast("string").alias("model"), F.col("id").cast("string").alias("version"), F.lit(datetime(2024, 1, 2)).alias("published_at"))
    assert match.candidate_pairs(frame, most=200).count() == 0  # all versions conflict
    parts = frame.select(F.pmod(F.xxhash64("id"), F.lit(20)).alias("part")).groupBy("part").count().collect()
    assert len(parts) == 20 and max(r["count"] for r in parts) < 2 * 200


def test_capped_accept_by_one_key_shuffles_once(spark):
    import random

    from pyspark.sql import functions as F

    from gleanery.operators import dedupe

    rng = random.Random(5)
    rows = [(f"e{i:03}", rng.choice(["a", "b", None]), rng.randrange(40), rng.choice(["x", "y", "z", "u", None]), rng.random() < 0.3) for i in range(200)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "id string, g string, t int, k string, bad boolean")
    got = dedupe.capped_accept(frame, "g", "id", [F.col("t"), F.col("id")], [F.col("k")], F.when(F.col("bad"), "bad"), 3)
    want, seen, taken = set(), set(), {}
    for i, g, t, k, bad in sorted(rows, key=lambda r: (r[2], r[0])):
        outcome = "bad" if bad else "duplicate" if k is not None and (g, k) in seen else "accepted"
        if taken.get(g, 0) < 3:
            want.add((i, outcome))
        seen |= {(g, k)} if not bad else set()
        taken[g] = taken.get(g, 0) + (outcome == "accepted")
    assert {(r["id"], r["outcome"]) for r in got.collect()} == want
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_few_starts_are_not_met_by_a_shuffle(spark):
    from pyspark.sql import functions as F

    from gleanery.operators import windows

    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.timestamp_seconds(F.col("id") * 3600).alias("t"))
    plan = windows.anchored_windows(rows, ["k"], "t", 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
