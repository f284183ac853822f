"""Queries over cross-source evidence, ranking and the whole feed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gleanery.functions import summaries
from gleanery.functions.contained import uncontained
from gleanery.functions.rules import found
from gleanery.operators import copy, findings, insights, names, ranking
from gleanery.plans import views
from gleanery.plans.registry import query

c = F.col
AS_OF = "2001-10-01"
GROUPS = [("metal", ["STEEL", "METAL"], ["STEEL"], None), ("brass-supply", ["BRASS"], ["BRASS"], "SUPPLY"), ("promo", ["PROMO", "ECONOMY"], ["PROMO"], None), ("large", ["BIG"], ["BIG"], None), ("rare", ["BIG", "NEVER"], ["NEVER"], None), ("reader", ["RETURN", "BRASS"], ["RETURN"], None)]


def evidence(spark, d):
    """Evidence of three roles with capability keys, by topic, size of window and family."""
    rows = views.evidence(spark, d)
    rows = rows.filter(findings.evidence_window(c("created_at"), F.lit(AS_OF).cast("timestamp"), 21))
    word = lambda k: F.when(F.contains(F.upper("topic"), F.lit(k)), k)
    keys = F.array_compact(F.array(word("STEEL"), word("METAL"), word("BRASS"), word("PROMO"), word("ECONOMY"), F.when(c("artifact"), "BIG"), F.when(c("family") == "R", "RETURN")))
    role = F.when(c("family") == "N", "SUPPLY").when(c("family") == "A", "CAPABILITY").otherwise("ADOPTION")
    current = c("created_at") >= F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(days=F.lit(7))
    return rows.select(c("evidence_id").alias("object_id"), role.alias("role"), keys.alias("capability_keys"), c("product").alias("organization"), c("topic").alias("product_family"), "finding_type", current.alias("current"), (~c("implication")).alias("hidden"), "updated_at")


EVIDENCE = f"""{views.EVIDENCE}, q AS (SELECT evidence_id AS object_id, CASE family WHEN 'N' THEN 'SUPPLY' WHEN 'A' THEN 'CAPABILITY' ELSE 'ADOPTION' END AS role,
  list_filter([CASE WHEN contains(upper(topic), 'STEEL') THEN 'STEEL' END, CASE WHEN contains(upper(topic), 'METAL') THEN 'METAL' END, CASE WHEN contains(upper(topic), 'BRASS') THEN 'BRASS' END, CASE WHEN contains(upper(topic), 'PROMO') THEN 'PROMO' END,
    CASE WHEN contains(upper(topic), 'ECONOMY') THEN 'ECONOMY' END, CASE WHEN artifact THEN 'BIG' END, CASE WHEN family = 'R' THEN 'RETURN' END], lambda x: x IS NOT NULL) AS capability_keys,
  product AS organization, topic AS product_family, finding_type, created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS current, NOT implication AS hidden, updated_at
  FROM v_evid WHERE created_at <= TIMESTAMP '{AS_OF}' AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 21 DAY),
g(group_id, keys, required, grole) AS (VALUES {', '.join(f"('{i}', {k}, {r}, {'NULL' if o is None else repr(o)})" for i, k, r, o in GROUPS)}),
m0 AS (SELECT g.*, q.* FROM g JOIN q ON list_has_any(capability_keys, keys) AND (grole IS NULL OR grole = role)),
m AS (SELECT * FROM m0 WHERE group_id IN (SELECT group_id FROM (SELECT group_id, any_value(required) AS req, list_distinct(flatten(list(capability_keys))) AS have FROM m0 GROUP BY group_id) WHERE list_has_all(have, req))),
x AS (SELECT *, coalesce(finding_type = 'FRICTION' OR list_contains(capability_keys, 'RETURN'), false) AS rough FROM m),
facts AS (SELECT group_id, count(DISTINCT object_id) AS n_members, count(DISTINCT CASE WHEN role = 'ADOPTION' THEN product_family ELSE organization END) AS n_independent, bool_or(role = 'SUPPLY') AS supply, bool_or(role = 'CAPABILITY') AS capability,
  bool_or(role = 'ADOPTION') AS adoption, bool_or(current) AS current, bool_or(role = 'ADOPTION' AND rough) AS friction, bool_and(rough) AS all_friction, bool_or(hidden) AS hidden, max(updated_at) AS updated_at FROM x GROUP BY group_id),
r AS (SELECT *, (supply OR capability) AND adoption AND friction AS ready, CAST(supply AS INT) + CAST(capability AS INT) + CAST(adoption AS INT) = 1 AS one FROM facts),
routed AS (SELECT *, CASE WHEN n_members < 2 THEN 'one-item' WHEN one AND supply AND n_independent = 1 THEN 'same-org-supply' WHEN n_independent < 2 THEN 'one-family' WHEN NOT current THEN 'aging' WHEN supply AND capability AND NOT adoption THEN 'supply-capability-no-adoption'
  WHEN one AND supply AND n_independent >= 3 THEN 'convergence' WHEN one AND supply THEN 'supply-under-three-orgs' WHEN one AND adoption AND all_friction THEN 'friction-pattern' WHEN one AND adoption THEN 'adoption-incomplete' WHEN one AND capability THEN 'papers-only'
  WHEN adoption THEN 'cross-role' ELSE 'incomplete' END AS reason FROM r),
stated AS (SELECT *, CASE WHEN reason IN ('one-item', 'same-org-supply', 'papers-only') THEN 'NOT_INSIGHT' WHEN reason IN ('convergence', 'friction-pattern', 'cross-role') THEN 'PUBLISH' ELSE 'WATCH' END AS status,
  CASE WHEN reason = 'convergence' THEN CASE WHEN n_independent >= 4 THEN 'HIGH' ELSE 'MEDIUM' END WHEN reason IN ('friction-pattern', 'supply-capability-no-adoption') THEN 'MEDIUM' WHEN reason = 'cross-role' THEN CASE WHEN n_independent >= 3 OR ready THEN 'HIGH' WHEN hidden THEN 'LOW' ELSE 'MEDIUM' END ELSE 'LOW' END AS confidence FROM routed),
final AS (SELECT group_id, n_members, CASE WHEN group_id = 'promo' AND EXISTS (SELECT 1 FROM stated WHERE group_id = 'metal' AND status = 'PUBLISH') THEN 'WATCH' ELSE status END AS status, CASE WHEN group_id = 'promo' AND EXISTS (SELECT 1 FROM stated WHERE group_id = 'metal' AND status = 'PUBLISH') THEN 'overlap' ELSE reason END AS reason, confidence, updated_at FROM stated)"""


def groups(spark):
    return spark.createDataFrame(GROUPS, "group_id string, keys array<string>, required array<string>, role string")


def members(spark, d):
    return insights.join_groups(evidence(spark, d), groups(spark))


def routed(spark, d):
    return insights.route(insights.cluster_facts(members(spark, d), ["RETURN"]))


def final(spark, d):
    return insights.suppress_overlap(routed(spark, d), "promo", "metal")


@query("j7_theta_join", f"WITH {EVIDENCE} SELECT group_id, object_id FROM m")
def j7(spark, d):
    return members(spark, d).select("group_id", "object_id")


@query("a4_cluster_facts", f"WITH {EVIDENCE} SELECT * FROM facts")
def a4(spark, d):
    return insights.cluster_facts(members(spark, d), ["RETURN"])


@query("c14_insight_routing", f"WITH {EVIDENCE} SELECT group_id, status, confidence, reason FROM stated")
def c14(spark, d):
    return routed(spark, d).select("group_id", "status", "confidence", "reason")


@query("a6_insight_report", f"WITH {EVIDENCE} SELECT status, count(*) AS n, sum(n_members)::BIGINT AS n_members FROM final GROUP BY status")
def a6(spark, d):
    return final(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.sum("n_members").alias("n_members"))


@query("e4_insights", f"WITH {EVIDENCE} SELECT group_id, status, reason, confidence, updated_at FROM final")
def e4(spark, d):
    return final(spark, d).select("group_id", "status", "reason", "confidence", "updated_at")


@query("t4_published_insights", f"WITH {EVIDENCE} SELECT group_id, updated_at FROM final WHERE status = 'PUBLISH' ORDER BY updated_at DESC, CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, group_id LIMIT 100")
def t4(spark, d):
    rank = F.when(c("confidence") == "HIGH", 0).when(c("confidence") == "MEDIUM", 1).otherwise(2)
    return final(spark, d).filter("status = 'PUBLISH'").orderBy(F.desc("updated_at"), rank, "group_id").limit(100).select("group_id", "updated_at")


@query("p31_stance", f"WITH {EVIDENCE} SELECT group_id, object_id, CASE WHEN role = 'ADOPTION' AND rough THEN 'contradicts' WHEN role = 'CAPABILITY' THEN 'enables' ELSE 'supports' END AS stance FROM x")
def p31_stance(spark, d):
    rough = F.coalesce((c("finding_type") == "FRICTION") | F.array_contains("capability_keys", "RETURN"), F.lit(False))
    return members(spark, d).select("group_id", "object_id", F.when((c("role") == "ADOPTION") & rough, "contradicts").when(c("role") == "CAPABILITY", "enables").otherwise("supports").alias("stance"))


# Templates over the test groups: one with roles of its own, one for many suppliers, one for all others.
TEMPLATES = [
    ("metal", 1, ["SUPPLY", "ADOPTION"], [], 0, "FRICTION_PATTERN", "Steel is the gate", "{supply} are shipping steel, while {families} {families?reports|report} it failing.", "It blocks.", "Reconsider steel.", "reconsider"),
    ("brass-supply", 2, ["SUPPLY"], ["ADOPTION"], 3, "CONVERGENCE", "Brass from {supply}", "{supply} {supply?is|are} converging on brass.", "It spreads.", "Watch brass.", "watch"),
    ("reader", 3, [], [], 0, "EXPECTATION_SHIFT", "Readers wait", "Readers expected Brand#99 or Brand#9 to ship.", "It waits.", "Ask readers.", "ask"),
    (None, 9, [], [], 0, "ADOPTION_SHIFT", "{all} show a shared change", "{all} {all?is|are} changing.", "It repeats.", "Watch it.", "watch"),
]


def listed(names: str) -> str:
    return f"CASE len({names}) WHEN 0 THEN '' WHEN 1 THEN {names}[1] WHEN 2 THEN {names}[1] || ' and ' || {names}[2] ELSE array_to_string({names}[1:len({names}) - 1], ', ') || ', and ' || {names}[len({names})] END"


COPY = f"""{EVIDENCE},
slot AS (SELECT group_id, coalesce(list_sort(list(DISTINCT organization) FILTER (WHERE role = 'SUPPLY')), []) AS s, coalesce(list_sort(list(DISTINCT product_family) FILTER (WHERE role = 'ADOPTION')), []) AS f, list_sort(list(DISTINCT organization)) AS a, bool_or(role = 'ADOPTION') AS adoption FROM x GROUP BY group_id),
copy AS (SELECT *, CASE WHEN group_id = 'metal' AND len(s) > 0 AND adoption THEN 1 WHEN group_id = 'brass-supply' AND len(s) >= 3 AND NOT adoption THEN 2 WHEN group_id = 'reader' THEN 3 ELSE 9 END AS place FROM slot),
said AS (SELECT *, CASE place WHEN 1 THEN 'FRICTION_PATTERN' WHEN 2 THEN 'CONVERGENCE' WHEN 3 THEN 'EXPECTATION_SHIFT' ELSE 'ADOPTION_SHIFT' END AS type,
  CASE place WHEN 1 THEN 'Steel is the gate' WHEN 2 THEN 'Brass from ' || {listed("s")} WHEN 3 THEN 'Readers wait' ELSE {listed("a")} || ' show a shared change' END AS headline,
  CASE place WHEN 1 THEN {listed("s")} || ' are shipping steel, while ' || {listed("f")} || CASE WHEN len(f) = 1 THEN ' reports' ELSE ' report' END || ' it failing.' WHEN 2 THEN {listed("s")} || CASE WHEN len(s) = 1 THEN ' is' ELSE ' are' END || ' converging on brass.' WHEN 3 THEN 'Readers expected Brand#99 or Brand#9 to ship.'
    ELSE {listed("a")} || CASE WHEN len(a) = 1 THEN ' is' ELSE ' are' END || ' changing.' END AS thesis FROM copy),
brands AS (SELECT DISTINCT lower(p_brand) AS name FROM part UNION SELECT 'brand#99'),
wrong AS (SELECT group_id, string_agg(name, ',' ORDER BY name) AS violations FROM said JOIN brands ON contains(lower(thesis), name) AND len(list_filter(list_concat(a, f), lambda t: contains(lower(t), name))) = 0 GROUP BY group_id)"""


def synthesized(spark, cited, known):
    """Copy of the groups of ``cited`` by the templates above."""
    return copy.synthesize(cited, spark.createDataFrame(TEMPLATES, copy.TEMPLATE), known)


def brand_names(spark, d):
    return views.table(spark, d, "part").select(c("p_brand").alias("name")).unionByName(spark.createDataFrame([("Brand#99",)], "name string")).distinct()


def copies(spark, d):
    return synthesized(spark, members(spark, d), brand_names(spark, d))


@query("p31_copy", f"WITH {COPY} SELECT group_id, type, headline, thesis, coalesce(violations, '') AS violations FROM said LEFT JOIN wrong USING (group_id)")
def p31_copy(spark, d):
    """Copy of each group from templates, with the names that its members do not cover."""
    return copies(spark, d).select("group_id", "type", "headline", "thesis", F.array_join("violations", ",").alias("violations"))


@query("e4_insight_copy", f"WITH {COPY} SELECT group_id, confidence, updated_at, type, thesis FROM final JOIN said USING (group_id) WHERE status = 'PUBLISH' AND group_id NOT IN (SELECT group_id FROM wrong)")
def e4_copy(spark, d):
    """Published insights whose thesis is grounded, with their copy."""
    text = copies(spark, d).filter(F.size("violations") == 0)
    return final(spark, d).filter("status = 'PUBLISH'").join(text, "group_id").select("group_id", "confidence", "updated_at", "type", "thesis")


@query("c21_grounding", "SELECT p_partkey, array_to_string(list_filter(['brass', 'steel', 'tin'], lambda n: contains(lower(p_type), n) AND NOT contains(lower(p_name), n)), ',') AS violations FROM part")
def c21(spark, d):
    rows = views.table(spark, d, "part").select("p_partkey", c("p_type").alias("thesis"), F.filter(F.array(F.lit("brass"), F.lit("steel"), F.lit("tin")), lambda n: F.contains(F.lower("p_name"), n)).alias("tokens"))
    return insights.ungrounded(rows, ["brass", "steel", "tin"]).select("p_partkey", F.array_join("violations", ",").alias("violations"))


NAMES = "names AS (SELECT DISTINCT trim(n) AS name FROM (SELECT regexp_extract(p_name, '([a-z]+)$', 1) AS n FROM part UNION ALL SELECT regexp_extract(p_name, '([a-z]+ [a-z]+)$', 1) FROM part UNION ALL SELECT lower(p_type) FROM part) WHERE n <> '')"


def part_names(spark, d):
    """A dimension of names that grows with its table: ends of part names, and types."""
    part = views.table(spark, d, "part")
    ends = [F.regexp_extract("p_name", p, 1) for p in ("([a-z]+)$", "([a-z]+ [a-z]+)$")]
    return part.select(F.explode(F.array(*ends, F.lower("p_type"))).alias("name")).filter("name != ''").select(F.trim("name").alias("name")).distinct()


@query("p19_known_names", f"""WITH {NAMES}, t AS (SELECT p_partkey, p_name || ' ' || lower(p_type) AS text FROM part), m AS (SELECT p_partkey, name FROM t JOIN names ON contains(text, name))
  SELECT p_partkey, arg_min(name, struct_pack(a := -length(name), b := name)) AS longest, count(*) AS n_names FROM m GROUP BY p_partkey""")
def p19_known(spark, d):
    """The longest known name, by one automaton over the whole dimension."""
    part = views.table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text"))
    found = names.names_in(part, "text", part_names(spark, d))
    return found.filter(F.size("names") > 0).select("p_partkey", names.longest_name().alias("longest"), F.size("names").cast("long").alias("n_names"))


@query("c21_named_grounding", f"""WITH {NAMES}, m AS (SELECT p_partkey, name FROM part JOIN names ON contains(p_name || ' ' || lower(p_type), name) AND NOT contains(p_name, name) AND NOT contains(lower(p_brand), name))
  SELECT p_partkey, string_agg(name, ',' ORDER BY name) AS violations FROM m GROUP BY p_partkey""")
def c21_named(spark, d):
    """Names in a thesis that none of its members' texts holds."""
    part = views.table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text"), F.array("p_name", F.lower("p_brand")).alias("members"))
    found = names.names_in(part, "text", part_names(spark, d)).withColumn("bad", F.array_sort(names.uncovered("names", "members")))
    return found.filter(F.size("bad") > 0).select("p_partkey", F.array_join("bad", ",").alias("violations"))


def ranked_items(spark, d):
    rows = views.items(spark, d)
    rows = rows.withColumn("tier", ranking.business_tier(c("role"), c("impact") >= 80, c("impact") >= 60, F.lit(False)))
    return rows.withColumns({"attention": ranking.attention_class(c("role"), c("tier"), c("relevance") >= 80, F.exists("tags", lambda t: t == "x3")), "novelty": c("trend")})


RANKED = f"""{views.ITEMS},
item AS (SELECT *, CASE WHEN role = 'SUPPLY' AND impact >= 80 THEN 'T1' WHEN role = 'SUPPLY' AND impact >= 60 THEN 'T2' END AS tier FROM v_item),
classed AS (SELECT *, trend AS novelty, CASE WHEN list_contains(tags, 'x3') OR role = 'BACKGROUND' THEN 3 WHEN role = 'ADOPTION' OR (role = 'SUPPLY' AND tier IS NOT NULL) OR (role = 'CAPABILITY' AND relevance >= 80) THEN 1 ELSE 2 END AS class FROM item)"""
SEATED = """seats(lang, seat, id, org, topic, role, role2, taken, roles) AS (
  SELECT DISTINCT lang, 0, '', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[], []::VARCHAR[] FROM pool
  UNION ALL
  (WITH s0 AS (SELECT s.lang, s.seat, s.org, s.topic, s.role, s.role2, s.taken, s.roles, p.id, p.organization, p.topic AS own_topic, p.role AS own_role, p.tier, p.published_at, p.impact, p.novelty, p.class
      FROM seats s JOIN pool p ON p.lang = s.lang AND NOT list_contains(s.taken, p.id) WHERE s.seat < 20),
    s1 AS (SELECT * FROM s0 QUALIFY class = min(class) OVER (PARTITION BY lang)),
    s2 AS (SELECT *, CASE WHEN seat > 0 AND organization = org THEN 1 ELSE 0 END AS o FROM s1 QUALIFY o = min(o) OVER (PARTITION BY lang)),
    s3 AS (SELECT *, CASE WHEN seat < 10 AND role = role2 THEN CASE WHEN own_role <> role THEN 0 WHEN tier = 'T1' THEN 1 ELSE 2 END ELSE 0 END AS r FROM s2 QUALIFY r = min(r) OVER (PARTITION BY lang)),
    s4 AS (SELECT *, CASE WHEN seat > 0 AND own_topic = topic THEN 1 ELSE 0 END AS t FROM s3 QUALIFY t = min(t) OVER (PARTITION BY lang)),
    s5 AS (SELECT *, min(CASE WHEN seat < 10 AND NOT list_contains(roles, own_role) THEN CASE own_role WHEN 'SUPPLY' THEN 1 WHEN 'ADOPTION' THEN 2 WHEN 'CAPABILITY' THEN 3 END END) OVER (PARTITION BY lang) AS seed FROM s4),
    s6 AS (SELECT * FROM s5 WHERE seed IS NULL OR own_role = ['SUPPLY', 'ADOPTION', 'CAPABILITY'][seed]),
    s7 AS (SELECT *, CASE WHEN seat = 0 OR (seat < 10 AND coalesce(seed, 1) = 1) THEN CASE tier WHEN 'T1' THEN 0 WHEN 'T2' THEN 1 ELSE 2 END ELSE 0 END AS g FROM s6 QUALIFY g = min(g) OVER (PARTITION BY lang)),
    s8 AS (SELECT * FROM s7 QUALIFY published_at = max(published_at) OVER (PARTITION BY lang)),
    s9 AS (SELECT * FROM s8 QUALIFY row_number() OVER (PARTITION BY lang, tier IS NULL ORDER BY CASE WHEN tier IS NOT NULL THEN impact END DESC, CASE WHEN tier IS NOT NULL THEN novelty END DESC, id) = 1)
  SELECT lang, seat + 1, id, organization, own_topic, own_role, role, list_append(taken, id), list_append(roles, own_role) FROM s9 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY id) = 1))"""


@query("g7_greedy_ranking", f"WITH RECURSIVE {RANKED}, pool AS (SELECT * FROM classed), {SEATED} SELECT lang, id, seat FROM seats WHERE seat > 0")
def g7(spark, d):
    """Feeds are languages; tests hold it against the greedy loop over all rows, too."""
    return ranking.rank_feed(ranked_items(spark, d), "lang", 20)


@query("p26_unique_parts", "WITH p AS (SELECT doc_id, list_distinct(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS parts FROM documents) SELECT doc_id, len(list_filter(parts, lambda a: len(list_filter(parts, lambda b: b <> a AND contains(b, a))) = 0))::BIGINT AS n FROM p")
def p26(spark, d):
    parts = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return views.table(spark, d, "documents").select("doc_id", F.size(uncontained(parts)).cast("long").alias("n"))


@query("p25_summary_composition", """WITH s AS (SELECT page_id, title, summary, list_filter(string_split(regexp_replace(trim(regexp_replace(summary, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS leads FROM v)
  SELECT page_id, md5(title || CASE WHEN len(leads) > 0 THEN ' ' || array_to_string(leads[1:2], ' ') ELSE '' END) AS text FROM s""".replace("WITH s AS", "WITH v AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '\\s+', ' ', 'g')) AS title, coalesce(substring(text, 1, 200), '') AS summary FROM pages LEFT JOIN documents ON page_id = doc_id), s AS"))
def p25(spark, d):
    rows = views.records(spark, d)
    leads = F.filter(F.split(F.trim(F.regexp_replace("summary", r"\s+", " ")), r"(?<=[.!?]) "), lambda s: s != "")
    return rows.select(F.substring("id", 2, 9).cast("long").alias("page_id"), F.md5(F.concat_ws(" ", "title", F.nullif(F.array_join(F.slice(leads, 1, 2), " "), F.lit("")))).alias("text"))


@query("p25_enrichment_summary")
def p25_enrichment(spark, d):
    """Whole pages: their heading if the last part of the URL does not identify it, leads, and later sentences on one topic."""
    pages = views.table(spark, d, "pages").filter("html is not null")
    body = F.coalesce(F.nullif(F.regexp_extract("html", r"(?is)<article\b[^>]*>(.*?)</article>", 1), F.lit("")), c("html"))
    lead, later = summaries.lead_and_later(body)
    h1 = F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    og = F.regexp_extract("html", r"(?is)<meta[^>]+property=[\"']og:description[\"'][^>]*content=[\"']([^\"']*)", 1)
    parts = pages.select("page_id", h1.alias("h1"), og.alias("og"), F.element_at(F.split("url", "/"), -1).alias("listing"), lead.alias("lead"), later.alias("later"))
    text = summaries.compose(c("h1"), c("og"), c("lead"), c("later"), c("listing"), lambda s: found(s, r"\b(the|la|der)\b"))
    return parts.select("page_id", F.md5(text).alias("summary"), F.length(text).cast("long").alias("n_chars"))


@query("p2_decode_entities", "SELECT page_id, md5(text) AS text FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h FROM pages), LATERAL (SELECT replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS text)")
def p2(spark, d):
    from gleanery.functions.entities import decode

    h = F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1)
    return views.table(spark, d, "pages").select("page_id", F.md5(decode(h)).alias("text"))


@query("u1_pair_decider", "SELECT DISTINCT a.s_suppkey AS left_id, b.s_suppkey AS right_id, abs(a.s_acctbal - b.s_acctbal) < 500 AS matched FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def u1(spark, d):
    """A user's decider as a pandas UDF over undecided pairs."""
    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return (a - b).abs() < 500

    s = views.table(spark, d, "supplier")
    left = s.select(c("s_suppkey").alias("left_id"), "s_nationkey", c("s_acctbal").alias("l"))
    right = s.select(c("s_suppkey").alias("right_id"), "s_nationkey", c("s_acctbal").alias("r"))
    return left.join(right, "s_nationkey").filter("left_id < right_id").select("left_id", "right_id", close("l", "r").alias("matched"))
