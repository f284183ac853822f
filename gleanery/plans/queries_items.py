"""Queries over documents, pages and feed items: projections, classifiers, scores, sorts, state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.functions import rules, scoring, text, urls
from gleanery.functions.rules import Rule
from gleanery.operators import analytics, state, windows
from gleanery.plans import views
from gleanery.plans.registry import query

c = F.col
AS_OF = "2024-02-01"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def docs(spark, d):
    return views.table(spark, d, "documents")


def pages(spark, d):
    return views.table(spark, d, "pages")


# -------------------------------------------------------------------- projections

STRIP = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '[\\s ]+', ' ', 'g'))"


@query("p1_strip_html", f"SELECT page_id, md5({STRIP}) AS text_md5, length({STRIP}) AS n FROM pages")
def p1(spark, d):
    t = text.strip_html(c("html"))
    return pages(spark, d).select("page_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("n"))


SLUG = "substring(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80)"
LINE = "split_part(text, chr(10), 1)"


@query("p3_slug_id", f"SELECT doc_id, 'doc-' || CASE WHEN {SLUG.format(LINE)} = '' THEN substring(sha256({LINE}), 1, 12) ELSE {SLUG.format(LINE)} END AS slug FROM documents")
def p3(spark, d):
    return docs(spark, d).select("doc_id", text.slug_id("doc", F.split_part("text", F.lit("\n"), F.lit(1))).alias("slug"))


@query("p4_canonical_url", f"SELECT page_id, {views.CANONICAL} AS canonical_url FROM pages")
def p4(spark, d):
    return pages(spark, d).select("page_id", urls.canonical_url(c("url")).alias("canonical_url"))


@query("p5_identity_url", f"SELECT page_id, {views.CANONICAL} || coalesce('#' || nullif(lower(regexp_extract(url, '#(.*)$', 1)), ''), '') AS identity_url FROM pages")
def p5(spark, d):
    return pages(spark, d).select("page_id", urls.identity_url(c("url")).alias("identity_url"))


@query("p6_registrable_host", f"SELECT page_id, {views.HOST2} AS host, {views.HOST2} = 'example.com' AS first_party FROM pages")
def p6(spark, d):
    return pages(spark, d).select("page_id", urls.registrable_host(c("url")).alias("host"), urls.same_site(c("url"), F.lit("https://www.example.com/x")).alias("first_party"))


@query("p7_title_forms", f"SELECT doc_id, trim(regexp_replace(lower({LINE}), '[^a-z0-9]+', ' ', 'g')) AS paper_title, trim(regexp_replace(regexp_replace(replace(replace(lower({LINE}), '''', ''), '’', ''), '\\b(?:introducing|announcing|launching|releasing)\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS launch_title FROM documents")
def p7(spark, d):
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    return docs(spark, d).select("doc_id", text.spaced(line).alias("paper_title"), text.launch_title(line).alias("launch_title"))


@query("p8_paper_ids", "SELECT doc_id, CAST(2400 + doc_id % 100 AS VARCHAR) || '.' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS arxiv, '10.1/' || lower(source) AS doi FROM documents")
def p8(spark, d):
    raw = F.concat(F.lit("https://arxiv.org/abs/"), (2400 + c("doc_id") % 100).cast("string"), F.lit("."), F.lpad(c("doc_id").cast("string"), 9, "0"), F.lit("v2?x=1"))
    return docs(spark, d).select("doc_id", urls.arxiv_id(raw).alias("arxiv"), urls.doi(F.concat(F.lit("https://doi.org/10.1/"), F.upper("source"))).alias("doi"))


@query("p9_calendar_day", f"WITH {views.ACTIVITY} SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM v_ev")
def p9(spark, d):
    return views.activity(spark, d).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("p10_age_and_freshness", f"WITH {views.ACTIVITY}, a AS (SELECT event_id, greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3.6e9) AS age FROM v_ev) SELECT event_id, round(age, 4) AS age_hours, CASE WHEN age < 12 THEN 18 WHEN age < 48 THEN 12 WHEN age < 168 THEN 6 ELSE 2 END AS freshness FROM a")
def p10(spark, d):
    age = scoring.hours_ago(c("ts"), as_of())
    return views.activity(spark, d).select("event_id", F.round(age, 4).alias("age_hours"), scoring.freshness(age).alias("freshness"))


@query("p11_reading_time", "SELECT doc_id, CAST(greatest(2, least(12, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) / 180.0 + 0.5))) AS INTEGER) AS minutes FROM documents")
def p11(spark, d):
    return docs(spark, d).select("doc_id", text.reading_time(c("text")).alias("minutes"))


KEYS = "['" + "', '".join(scoring.KEYWORDS) + "']"
LIVE = f"""{views.ITEMS}, w AS (SELECT *, len(list_filter({KEYS}, lambda k: contains(lower(title || ' ' || summary), k))) AS n, CASE source WHEN 'src1' THEN 14.0 WHEN 'src2' THEN 8.0 ELSE 5.0 END AS sw,
  greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(published_at)) / 3.6e9) AS age FROM v_item), f AS (SELECT *, CASE WHEN age < 12 THEN 18 WHEN age < 48 THEN 12 WHEN age < 168 THEN 6 ELSE 2 END AS fr FROM w)"""


@query("p12_live_scores", f"WITH {LIVE} SELECT id, CAST(floor(least(97.0, 48 + sw + least(20, n * 4) + fr / 2.0) + 0.5) AS INTEGER) AS impact, CAST(floor(least(98.0, 55 + n * 6 + sw) + 0.5) AS INTEGER) AS relevance, CAST(floor(least(98.0, 40 + fr * 2 + least(15, n * 3)) + 0.5) AS INTEGER) AS trend FROM f")
def p12(spark, d):
    body = F.concat_ws(" ", "title", "summary")
    scores = scoring.live_scores(body, c("source"), c("published_at"), as_of(), {"src1": 14.0, "src2": 8.0})
    return views.items(spark, d).select("id", scores.alias("s")).select("id", "s.impact", "s.relevance", "s.trend")


COMPOSITE = "CAST(floor((impact * 45 + relevance * 30 + trend * 25 + 50) / 100) AS INTEGER)"
TIER = "CASE WHEN impact * 45 + relevance * 30 + trend * 25 >= 7800 OR impact >= 82 THEN 'High Impact' WHEN impact * 45 + relevance * 30 + trend * 25 >= 6800 OR trend >= 75 THEN 'Trending' ELSE 'Emerging' END"


def scored(spark, d):
    args = (c("impact"), c("relevance"), c("trend"))
    return views.items(spark, d).withColumns({"composite": scoring.composite(*args), "tier": scoring.tier(*args)})


@query("p13_composite_and_tier", f"WITH {views.ITEMS} SELECT id, {COMPOSITE} AS composite, {TIER} AS tier FROM v_item")
def p13(spark, d):
    return scored(spark, d).select("id", "composite", "tier")


@query("p14_engagement", """SELECT o_orderkey, round(least(45.0, log10(floor(o_totalprice) + 1) * 12), 4) AS star_boost, round(CASE WHEN o_orderkey % 5 > 0 THEN least(20.0, log10(o_orderkey % 5) * 3) ELSE 8.0 END, 4) AS view_boost,
  CASE WHEN floor(o_totalprice) >= 1000 THEN printf('%.1f', floor(floor(o_totalprice) / 100) / 10) || 'k' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS label,
  CASE WHEN o_orderkey % 3 > 0 THEN printf('%d:%02d:%02d', o_orderkey % 3, o_orderkey % 60, o_orderkey % 7) ELSE printf('%d:%02d', o_orderkey % 60, o_orderkey % 7) END AS duration FROM orders""")
def p14(spark, d):
    n = F.floor("o_totalprice")
    iso = F.concat(F.lit("PT"), (c("o_orderkey") % 3).cast("string"), F.lit("H"), (c("o_orderkey") % 60).cast("string"), F.lit("M"), (c("o_orderkey") % 7).cast("string"), F.lit("S"))
    return views.table(spark, d, "orders").select(
        "o_orderkey", F.round(scoring.star_boost(n), 4).alias("star_boost"), F.round(scoring.view_boost(c("o_orderkey") % 5), 4).alias("view_boost"), scoring.short_count(n).alias("label"), scoring.duration_label(iso).alias("duration")
    )


@query("p15_rebuild_text", "SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(text, '[ \\n\\r\\t\\f\\v]+'), lambda w: w <> ''), ' ')) AS text_md5 FROM documents")
def p15(spark, d):
    words = F.filter(F.split("text", r"[ \n\r\t\f\x0B]+"), lambda w: w != "")
    out = docs(spark, d).select("doc_id", text.inverted(words).alias("index"))
    return out.select("doc_id", F.md5(F.coalesce(text.rebuild(c("index")), F.lit(""))).alias("text_md5"))


RELEASE, MODEL, BRANDS, OPENING = r"\b(the|launch)\b", r"\b(of|gpt)\b", r"\b(in|on)\b", r"^the\b"


@query("p17_release_priority", f"""WITH {views.ITEMS}, x AS (SELECT id, title, regexp_matches(title || ' ' || summary, '(?i){RELEASE}') AS r, regexp_matches(title || ' ' || summary, '(?i){MODEL}') AS m, role = 'SUPPLY' AS rel, source IN ('src1', 'src2', 'src3') AS lab FROM v_item)
  SELECT id, CAST(CASE WHEN rel THEN 100 ELSE 0 END + CASE WHEN lab THEN 50 ELSE 0 END + CASE WHEN r AND m THEN 90 WHEN r AND lab THEN 55 WHEN m AND lab THEN 25 WHEN r THEN 15 ELSE 0 END + CASE WHEN regexp_matches(title, '(?i){OPENING}') THEN 35 ELSE 0 END
  + CASE WHEN regexp_matches(title, '(?i){BRANDS}') AND r THEN 25 ELSE 0 END AS INTEGER) AS priority, r AND m OR regexp_matches(title, '(?i){OPENING}') AND (m OR r) AS release FROM x""")
def p17(spark, d):
    body, title = F.concat_ws(" ", "title", "summary"), c("title")
    r, m = rules.found(body, RELEASE), rules.found(body, MODEL)
    p = scoring.release_priority(title, body, c("role") == "SUPPLY", c("source").isin("src1", "src2", "src3"), RELEASE, MODEL, BRANDS, OPENING)
    return views.items(spark, d).select("id", p.alias("priority"), ((r & m) | (rules.found(title, OPENING) & (m | r))).alias("release"))


QUALITY = f"""{COMPOSITE} + CASE {TIER} WHEN 'High Impact' THEN 28 WHEN 'Trending' THEN 14 ELSE 0 END + CASE WHEN role = 'SUPPLY' THEN 22 ELSE 0 END + CASE WHEN stars > 0 THEN least(35.0, log10(stars + 1) * 12) ELSE 0.0 END
  + CASE WHEN length(title) BETWEEN 40 AND 110 THEN 6 ELSE 0 END - CASE WHEN length(title) < 22 THEN 10 ELSE 0 END - CASE WHEN regexp_matches(title, '^\\s*v?\\d+\\.\\d+') THEN 20 ELSE 0 END
  + CASE WHEN greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(published_at)) / 3.6e9) < 48 THEN 10 WHEN greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(published_at)) / 3.6e9) > 720 THEN -8 ELSE 0 END"""


def quality(rows):
    return scoring.quality(c("composite"), c("tier"), c("role") == "SUPPLY", c("title"), c("stars"), scoring.hours_ago(c("published_at"), as_of()))


@query("p18_content_quality", f"WITH {views.ITEMS} SELECT id, round({QUALITY}, 4) AS quality FROM v_item")
def p18(spark, d):
    rows = scored(spark, d)
    return rows.select("id", F.round(quality(rows), 4).alias("quality"))


@query("p19_entities", """SELECT p_partkey, regexp_extract(p_name, '([a-z]+) [a-z]+', 1) AS model, nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS version, CASE WHEN p_type LIKE '%STEEL%' THEN 'product-launch' WHEN p_size > 25 THEN 'major-update' ELSE 'model-release' END AS event_type,
  array_to_string(list_filter([CASE WHEN p_size > 10 THEN 'large' END, CASE WHEN p_retailprice > 1200 THEN 'costly' END, CASE WHEN p_name LIKE '%a%' THEN 'a' END], lambda x: x IS NOT NULL), ',') AS capabilities,
  coalesce(list_sort(list_transform(list_filter(['Brand#1', 'Brand#11', 'Brand#2', 'Brand'], lambda k: contains(p_brand, k)), lambda k: struct_pack(n := -length(k), k := k)))[1].k, '') AS product FROM part""")
def p19(spark, d):
    known = F.array(*[F.lit(x) for x in ("Brand#1", "Brand#11", "Brand#2", "Brand")])  # longest known name that is contained
    longest = F.get(F.array_sort(F.transform(F.filter(known, lambda k: F.contains(c("p_brand"), k)), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), F.lit(0))["k"]
    flags = F.array_compact(F.array(F.when(c("p_size") > 10, "large"), F.when(c("p_retailprice") > 1200, "costly"), F.when(F.contains("p_name", F.lit("a")), "a")))
    return views.table(spark, d, "part").select(
        "p_partkey", F.regexp_extract("p_name", "([a-z]+) [a-z]+", 1).alias("model"), F.nullif(F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit("")).alias("version"),
        F.when(F.contains("p_type", F.lit("STEEL")), "product-launch").when(c("p_size") > 25, "major-update").otherwise("model-release").alias("event_type"), F.array_join(flags, ",").alias("capabilities"), F.coalesce(longest, F.lit("")).alias("product"),
    )


@query("p20_launch_scores", f"""WITH {views.RECORDS} SELECT id, least(100, 62 + CASE WHEN model IS NOT NULL THEN 12 ELSE 0 END + CASE WHEN version IS NOT NULL THEN 9 ELSE 0 END + CASE WHEN length(summary) > 100 THEN 8 ELSE 0 END + CASE WHEN authority >= 80 THEN 10 ELSE 0 END) AS qualification,
  CASE WHEN model IS NOT NULL AND version IS NOT NULL THEN 0.9 ELSE 0.76 END::DOUBLE AS confidence FROM v_rec""")
def p20(spark, d):
    from gleanery.operators.launches import launch_scores

    return launch_scores(views.records(spark, d)).select("id", "qualification", "confidence")


@query("p21_stable_ids", f"WITH {views.RECORDS} SELECT id, substring(sha256(concat_ws('|', org, coalesce(product, ''), coalesce(model, ''), coalesce(version, ''))), 1, 16) AS event_key, substring(sha256(CASE WHEN id < url THEN id || '|' || url ELSE url || '|' || id END), 1, 24) AS pair FROM v_rec")
def p21(spark, d):
    return views.records(spark, d).select("id", text.hash_id(16, c("org"), c("product"), c("model"), c("version")).alias("event_key"), text.pair_key(c("id"), c("url")).alias("pair"))


@query("p33_mask_secrets", """SELECT doc_id, md5(substring(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)bearer\\s+[A-Za-z0-9._~+/=-]+', 'Bearer [redacted]', 'g'), '(?i)(api[_-]?key|token|secret|password)(\\s*[=:]\\s*)[^\\s&]+', '\\1\\2[redacted]', 'g'), '[\\s ]+', ' ', 'g')), 1, 300)) AS masked FROM documents""")
def p33(spark, d):
    return docs(spark, d).select("doc_id", F.md5(text.mask_secrets(c("text"))).alias("masked"))


@query("p35_clamp", "SELECT l_orderkey, l_linenumber, sum(CAST(least(100, greatest(0, floor(l_quantity * 3 - 20 + 0.5))) AS INTEGER))::BIGINT AS score, min(substring(trim(regexp_replace(l_returnflag || '  ' || l_linestatus, '\\s+', ' ', 'g')), 1, 2)) AS label FROM lineitem GROUP BY ALL")
def p35(spark, d):
    score = text.clamp_score((c("l_quantity") * 3 - 20).cast("string"))
    label = text.cut(F.concat_ws("  ", "l_returnflag", "l_linestatus"), 2)
    return views.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(score).alias("score"), F.min(label).alias("label"))


@query("p22_finding_sentence", """WITH s AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[\\s ]+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM documents)
  SELECT doc_id, md5(coalesce(list_filter(parts, lambda x: length(x) > 40 AND regexp_matches(x, ' the '))[1], CASE WHEN NOT regexp_matches(parts[1], '^Licensed') THEN parts[1] END, title)) AS finding FROM s""")
def p22(spark, d):
    return docs(spark, d).select("doc_id", F.md5(text.first_sentence(c("text"), " the ", "^Licensed", F.split_part("text", F.lit("\n"), F.lit(1)))).alias("finding"))


@query("p23_template_briefs", f"WITH {views.ITEMS} SELECT id, source || ' reports for ' || CASE role WHEN 'SUPPLY' THEN 'builders' WHEN 'CAPABILITY' THEN 'researchers' ELSE 'readers' END || ': impact ' || CAST(impact AS VARCHAR) AS brief FROM v_item")
def p23(spark, d):
    audience = F.coalesce(F.try_element_at(F.create_map(F.lit("SUPPLY"), F.lit("builders"), F.lit("CAPABILITY"), F.lit("researchers")), c("role")), F.lit("readers"))
    return views.items(spark, d).select("id", F.format_string("%s reports for %s: impact %d", "source", audience, "impact").alias("brief"))


@query("p24_brief_presentation", f"""WITH {views.ITEMS}, n AS (SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(summary), '[^a-z0-9]+', ' ', 'g')) AS b FROM v_item)
  SELECT id, a = b OR (length(a) >= 24 AND contains(b, a)) OR (length(b) >= 24 AND contains(a, b)) AS repeats FROM n""")
def p24(spark, d):
    from gleanery.operators.briefs import repeats

    return views.items(spark, d).select("id", repeats(c("title"), c("summary")).alias("repeats"))


@query("p27_to_feed_item", f"WITH {views.ITEMS} SELECT id, title, source || ' · ' || lang AS byline, array_to_string(list_filter(['live', lower(role), CASE WHEN trend >= 60 THEN 'hot' END], lambda x: x IS NOT NULL), ',') AS tags, impact, relevance, trend FROM v_item")
def p27(spark, d):
    tags = F.array_join(F.array_compact(F.array(F.lit("live"), F.lower("role"), F.when(c("trend") >= 60, "hot"))), ",")
    return views.items(spark, d).select("id", "title", F.concat_ws(" · ", "source", "lang").alias("byline"), tags.alias("tags"), "impact", "relevance", "trend")


@query("p28_role_topic_org", f"WITH {views.ITEMS} SELECT id, CASE WHEN list_contains(tags, 'ai-en') THEN 'SUPPLY' WHEN list_contains(tags, 'ai-fr') THEN 'CAPABILITY' WHEN source = 'src3' THEN 'ADOPTION' ELSE 'BACKGROUND' END AS role, CASE WHEN regexp_matches(lower(title), '\\bthe\\b') THEN 'the' WHEN regexp_matches(lower(title), '\\bof\\b') THEN 'of' ELSE 'paper' END AS topic FROM v_item")
def p28(spark, d):
    from gleanery.operators.ranking import assign_role

    role = assign_role(F.array_contains("tags", "ai-en"), F.array_contains("tags", "ai-fr"), c("source") == "src3")
    return views.items(spark, d).select("id", role.alias("role"), rules.classify_first(c("title"), [Rule("the", r"\bthe\b"), Rule("of", r"\bof\b")], "paper").alias("topic"))


@query("p29_tier_and_attention", f"WITH {views.ITEMS} SELECT id, CASE WHEN role = 'SUPPLY' AND impact >= 80 THEN 'T1' WHEN role = 'SUPPLY' AND impact >= 60 THEN 'T2' END AS business_tier, CASE WHEN role = 'BACKGROUND' THEN 'BACKGROUND' WHEN role = 'ADOPTION' OR (role = 'SUPPLY' AND impact >= 60) OR (role = 'CAPABILITY' AND relevance >= 80) THEN 'HIGH' ELSE 'MEDIUM' END AS attention FROM v_item")
def p29(spark, d):
    from gleanery.operators.ranking import attention_class, business_tier

    tier = business_tier(c("role"), c("impact") >= 80, c("impact") >= 60, F.lit(False))
    return views.items(spark, d).withColumn("business_tier", tier).select("id", "business_tier", attention_class(c("role"), c("business_tier"), c("relevance") >= 80, F.lit(False)).alias("attention"))


@query("p30_org_and_family", "SELECT s_suppkey, lower(replace(split_part(s_name, '#', 1), ' ', '-')) AS organization, regexp_extract(s_name, '([0-9]+)$', 1) AS family FROM supplier")
def p30(spark, d):
    return views.table(spark, d, "supplier").select("s_suppkey", F.lower(F.replace(F.split_part("s_name", F.lit("#"), F.lit(1)), F.lit(" "), F.lit("-"))).alias("organization"), F.regexp_extract("s_name", "([0-9]+)$", 1).alias("family"))


@query("p31_english_list", "WITH s AS (SELECT r_regionkey, list_sort(list(n_name)) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1) SELECT r_regionkey, array_to_string(names[1:len(names) - 1], ', ') || ', and ' || names[len(names)] AS names FROM s WHERE len(names) > 2")
def p31(spark, d):
    nation = views.table(spark, d, "nation").join(views.table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return nation.groupBy("r_regionkey").agg(text.english_list(F.array_sort(F.collect_list("n_name"))).alias("names"))


@query("p32_code_labels", f"WITH {views.ITEMS} SELECT id, CASE role WHEN 'SUPPLY' THEN 'What shipped' WHEN 'CAPABILITY' THEN 'What is possible' WHEN 'ADOPTION' THEN 'What people do' ELSE 'Context' END AS cue FROM v_item")
def p32(spark, d):
    labels = spark.createDataFrame([("SUPPLY", "What shipped"), ("CAPABILITY", "What is possible"), ("ADOPTION", "What people do")], "code string, label string")
    rows = views.items(spark, d)
    return rows.join(F.broadcast(labels), c("role") == c("code"), "left").select("id", F.coalesce("label", F.lit("Context")).alias("cue"))


@query("p34_title_bad_cases", f"WITH {views.ITEMS} SELECT id, CASE WHEN length(trim(title)) < 12 THEN 'too-short' WHEN regexp_matches(title, '^\\s*v?\\d+\\.\\d+') THEN 'version-only' WHEN title = upper(title) THEN 'shouting' WHEN contains(title, '|') THEN 'listing' END AS reason FROM v_item")
def p34(spark, d):
    t = c("title")
    return views.items(spark, d).select("id", rules.cascade((F.length(F.trim(t)) < 12, "too-short"), (t.rlike(r"^\s*v?\d+\.\d+"), "version-only"), (t == F.upper(t), "shouting"), (F.contains(t, F.lit("|")), "listing")).alias("reason"))


@query("p16_headline_rewrite", f"""WITH {views.ITEMS}, a AS (SELECT id, trim(regexp_replace(title, '^(?i)(the|and|of)\\s+', '')) AS t, split_part(regexp_replace(trim(regexp_replace(summary, '[\\s ]+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1), 1) AS s FROM v_item)
  SELECT id, CASE WHEN length(t) < 22 AND length(s) > length(t) THEN substring(s, 1, 110) ELSE substring(trim(regexp_replace(t, '[\\s ]+', ' ', 'g')), 1, 110) END AS headline FROM a""".replace("'^(?i)(the", "'(?i)^(the"))
def p16(spark, d):
    from gleanery.operators.briefs import headline

    return views.items(spark, d).select("id", headline(c("title"), c("summary"), r"(?i)^(the|and|of)\s+").alias("headline"))


# --------------------------------------------------------------------- classifiers

RULES = [Rule("german", r"\b(der|die|und)\b"), Rule("french", r"\b(le|la|les)\b"), Rule("english", r"\b(the|and)\b"), Rule("symbols", r"[#%&*$]{3}")]
RULES_CASE = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){r.pattern}') THEN '{r.label}'" for r in RULES) + " ELSE 'other' END"
RULES_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){r.pattern}') THEN '{r.label}' END" for r in RULES) + "], lambda x: x IS NOT NULL)"
# Unicode letters beside a word are no ASCII word characters for either engine's rules.


@query("c1_first_match", f"SELECT doc_id, {RULES_CASE} AS label FROM documents")
def c1(spark, d):
    return docs(spark, d).select("doc_id", rules.classify_first(c("text"), RULES).alias("label"))


@query("c2_multi_label", f"SELECT doc_id, array_to_string({RULES_LIST}, ',') AS labels FROM documents")
def c2(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(rules.classify_all(c("text"), RULES), ",").alias("labels"))


@query("c3_exclusion_cascade", f"""WITH {views.ITEMS} SELECT id, CASE WHEN regexp_matches(title || chr(10) || summary, '(?i)\\b(idiot|clown)\\b') OR stars >= 20000 THEN 'spam' WHEN source = 'src1' AND regexp_matches(title, '(?i)^the\\b') THEN 'no-adoption'
  WHEN regexp_matches(title || chr(10) || summary, '(?i)\\bthat\\b') AND NOT regexp_matches(title || chr(10) || summary, '(?i)\\bof\\b') THEN 'argument' END AS reason FROM v_item""")
def c3(spark, d):
    t = F.concat_ws("\n", "title", "summary")
    steps = [(rules.found(t, r"\b(idiot|clown)\b") | (c("stars") >= 20000), "spam"), ((c("source") == "src1") & rules.found(c("title"), r"^the\b"), "no-adoption"), (rules.found(t, r"\bthat\b") & ~rules.found(t, r"\bof\b"), "argument")]
    return views.items(spark, d).select("id", rules.cascade(*steps).alias("reason"))


@query("c4_bot_filter", "SELECT c_custkey FROM customer WHERE c_name IS NOT NULL AND NOT regexp_matches(c_name, '(?i)(\\[bot\\]$|7$)') AND c_mktsegment <> 'MACHINERY'")
def c4(spark, d):
    from gleanery.operators.evidence import is_bot

    return views.table(spark, d, "customer").filter(~is_bot(c("c_name"), c("c_mktsegment"), r"(\[bot\]$|7$)", "MACHINERY")).select("c_custkey")


@query("c5_finding_type", f"WITH {views.EVIDENCE} SELECT evidence_id, CASE WHEN finding_type = 'EMERGING_TOOL' THEN 'BACKLASH' WHEN topic LIKE 'P%' THEN 'WORKFLOW_SHIFT' WHEN NOT implication THEN 'MIGRATION' ELSE 'FRICTION' END AS kind FROM v_evid")
def c5(spark, d):
    kind = F.when(c("finding_type") == "EMERGING_TOOL", "BACKLASH").when(F.startswith("topic", F.lit("P")), "WORKFLOW_SHIFT").when(~c("implication"), "MIGRATION").otherwise("FRICTION")
    return views.evidence(spark, d).select("evidence_id", kind.alias("kind"))


@query("c6_taxonomy_capture", "WITH m AS (SELECT doc_id, regexp_matches(text, '(?i)\\b(the|le)\\b') AS facing, regexp_matches(text, '(?i)\\b(und|que)\\b') AS back, regexp_matches(text, '(?i)\\b(of|de)\\b') AS ai, source = 'src2' AS hci FROM documents) SELECT doc_id, (facing AND ai) OR (hci AND ai) AS capture, CASE WHEN (facing AND ai) OR (hci AND ai) THEN NULL WHEN back THEN 'background-only' ELSE 'taxonomy-mismatch' END AS reason FROM m")
def c6(spark, d):
    from gleanery.operators.papers import taxonomy_capture

    t = c("text")
    capture, reason = taxonomy_capture(rules.found(t, r"\b(the|le)\b"), rules.found(t, r"\b(und|que)\b"), rules.found(t, r"\b(of|de)\b"), c("source") == "src2")
    return docs(spark, d).select("doc_id", capture.alias("capture"), reason.alias("reason"))


@query("c7_artifact_flags", "SELECT doc_id, regexp_matches(text, '(?i)\\b(repro|token|the)\\b') OR contains(text, '%%%') AS artifact, NOT regexp_matches(split_part(text, chr(10), 1), '(?i)\\b(typo|of)\\b') AND regexp_matches(text, '(?i)\\b(and|et|und)\\b') AS implication FROM documents")
def c7(spark, d):
    t, title = c("text"), F.split_part("text", F.lit("\n"), F.lit(1))
    return docs(spark, d).select("doc_id", (rules.found(t, r"\b(repro|token|the)\b") | F.contains(t, F.lit("%%%"))).alias("artifact"), (~rules.found(title, r"\b(typo|of)\b") & rules.found(t, r"\b(and|et|und)\b")).alias("implication"))


@query("c8_loose_relevance", f"SELECT doc_id, len(list_filter({KEYS}, lambda k: contains(lower(text), k))) > 0 AS relevant FROM documents")
def c8(spark, d):
    return docs(spark, d).select("doc_id", rules.any_of(c("text"), scoring.KEYWORDS).alias("relevant"))


@query("c9_launch_qualification", f"""WITH {views.RECORDS} SELECT id, CASE WHEN regexp_matches(title, '(?i)\\bidiot\\b') THEN 'excluded' WHEN length(title) < 25 THEN 'minor' WHEN NOT (regexp_matches(title || ' ' || summary, '(?i)\\b(the|la)\\b') OR version IS NOT NULL) THEN 'no-evidence' WHEN product IS NULL THEN 'no-entity' END AS reason FROM v_rec""")
def c9(spark, d):
    from gleanery.operators.launches import qualify

    rows = views.records(spark, d)
    return qualify(rows, excluded=rules.found(c("title"), r"\bidiot\b"), minor=F.length("title") < 25, evidence=rules.found(F.concat_ws(" ", "title", "summary"), r"\b(the|la)\b") | c("version").isNotNull()).select("id", "reason")


PAPER = """WITH f AS (SELECT doc_id, regexp_matches(text, '(?i)\\bidiot\\b') AS theory, regexp_matches(text, '(?i)\\b(they|une)\\b') AS users, regexp_matches(text, '(?i)\\bworthless\\b') AS infra, regexp_matches(split_part(text, chr(10), 1), '(?i)bench|\\bof\\b') AS incremental,
  CASE WHEN regexp_matches(text, '(?i)\\b(the|that)\\b') THEN 'Agents' WHEN regexp_matches(text, '(?i)\\b(le|les)\\b') THEN 'Video' END AS cue, regexp_matches(text, '(?i)\\b(with|avec)\\b') AND NOT regexp_matches(text, '(?i)\\bclown\\b') AS implication FROM documents),
  g AS (SELECT *, CASE WHEN theory AND NOT users THEN 'r1-theory' WHEN infra AND cue IS NULL THEN 'r2-infra' WHEN incremental AND cue IS NULL THEN 'r3-incremental' WHEN cue IS NULL OR NOT implication THEN 'r6-else' END AS reason FROM f)"""


@query("c10_paper_gate", PAPER + " SELECT doc_id, reason IS NULL AS publish, reason IS NULL OR (reason = 'r6-else' AND cue IS NOT NULL) AS pass_candidate, reason, CASE WHEN reason IS NULL OR reason = 'r6-else' THEN cue END AS cue FROM g")
def c10(spark, d):
    return paper_gated(spark, d).select("doc_id", "publish", "pass_candidate", "reason", "cue")


def paper_gated(spark, d):
    return gated_papers(docs(spark, d))


def gated_papers(papers):
    from gleanery.operators.papers import paper_gate

    t, title = c("text"), F.split_part("text", F.lit("\n"), F.lit(1))
    cue = rules.classify_first(t, [Rule("Agents", r"\b(the|that)\b"), Rule("Video", r"\b(le|les)\b")], "")
    return paper_gate(papers, theory=rules.found(t, r"\bidiot\b"), users=rules.found(t, r"\b(they|une)\b"), infra=rules.found(t, r"\bworthless\b"), incremental=rules.found(title, r"bench|\bof\b"), cue=F.nullif(cue, F.lit("")), implication=rules.found(t, r"\b(with|avec)\b") & ~rules.found(t, r"\bclown\b"))


@query("c11_enrichment_eligibility", f"""WITH {views.RECORDS} SELECT id, CASE WHEN authority < 70 THEN 'untrusted-channel' WHEN length(summary) >= 200 THEN 'rich-surface' WHEN regexp_matches(title, '(?i)\\bidiot\\b') THEN 'excluded' WHEN product IS NULL AND version IS NULL THEN 'no-entity' WHEN org <> 'example.com' THEN 'third-party' END AS skip FROM v_rec""")
def c11(spark, d):
    from gleanery.operators.launches import enrichment_skip

    skip = enrichment_skip(trusted=c("authority") >= 70, sparse=F.length("summary") < 200, excluded=rules.found(c("title"), r"\bidiot\b"), entity=c("product").isNotNull() | c("version").isNotNull(), first_party=c("org") == "example.com")
    return views.records(spark, d).select("id", skip.alias("skip"))


@query("c17_disqualifying_tags", f"WITH {views.ITEMS} SELECT id FROM v_item WHERE len(list_filter(tags, lambda t: regexp_matches(t, '(?i)^(x3|tag7)$'))) > 0")
def c17(spark, d):
    return views.items(spark, d).filter(F.exists("tags", lambda t: t.rlike("(?i)^(x3|tag7)$"))).select("id")


@query("c18_text_search", f"WITH {views.ITEMS} SELECT id FROM v_item WHERE contains(lower(title || ' ' || summary || ' ' || source), 'then') AND role = 'SUPPLY'")
def c18(spark, d):
    return views.items(spark, d).filter(F.contains(F.lower(F.concat_ws(" ", "title", "summary", "source")), F.lit("then")) & (c("role") == "SUPPLY")).select("id")


@query("c19_residue", f"WITH {views.ITEMS} SELECT id, regexp_matches(trim(title), '(?i)^(the|announcements?)$') OR regexp_matches(title || ' ' || summary, '(?i)\\b(recap|roundup|worthless)\\b') OR regexp_matches(title, '(?i)\\b(changelog|that)\\b') AS residue FROM v_item")
def c19(spark, d):
    residue = rules.found(F.trim("title"), "^(the|announcements?)$") | rules.found(F.concat_ws(" ", "title", "summary"), r"\b(recap|roundup|worthless)\b") | rules.found(c("title"), r"\b(changelog|that)\b")
    return views.items(spark, d).select("id", residue.alias("residue"))


@query("c22_visible", f"WITH {views.ITEMS} SELECT id FROM v_item WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 21 DAY")
def c22(spark, d):
    return views.items(spark, d).filter(c("published_at") >= as_of() - F.make_dt_interval(days=F.lit(21))).select("id")


# --------------------------------------------------------------------------- joins


@query("j1_dimension_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j1(spark, d):
    t = lambda n: views.table(spark, d, n)
    return t("supplier").join(t("nation"), c("s_nationkey") == c("n_nationkey")).join(t("region"), c("n_regionkey") == c("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("j2_canonical_enrichment", "SELECT doc_id, coalesce(nullif(CASE WHEN quality = 1 THEN 'good' ELSE '' END, ''), lang) AS kind, quality IS NULL AS unmatched FROM documents LEFT JOIN labels USING (doc_id)")
def j2(spark, d):
    labels = views.table(spark, d, "labels").select("doc_id", F.when(c("quality") == 1, "good").otherwise("").alias("kind"), F.lit(True).alias("hit"))
    out = docs(spark, d).join(labels, "doc_id", "left")
    return out.select("doc_id", F.coalesce(F.nullif("kind", F.lit("")), "lang").alias("kind"), c("hit").isNull().alias("unmatched"))


@query("j3_detail_join", "SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def j3(spark, d):
    rich = views.table(spark, d, "customer").filter("c_acctbal > 0")
    return views.table(spark, d, "orders").join(rich, c("o_custkey") == c("c_custkey"), "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


@query("j8_override_join", PAPER + ", o AS (SELECT doc_id, true AS forced FROM labels WHERE toxic = 1) SELECT doc_id, reason IS NULL OR coalesce(forced, false) AS publish FROM g LEFT JOIN o USING (doc_id)")
def j8(spark, d):
    forced = views.table(spark, d, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("forced"))
    return paper_gated(spark, d).join(forced, "doc_id", "left").select("doc_id", (c("publish") | F.coalesce("forced", F.lit(False))).alias("publish"))


@query("j9_apply_enrichment", f"WITH {views.ITEMS}, x AS (SELECT DISTINCT sha256(title) AS h, 'N: ' || title AS new_title FROM v_item WHERE role = 'CAPABILITY') SELECT id, coalesce(new_title, title) AS title, array_to_string(list_sort(list_distinct(list_concat(tags, CASE WHEN new_title IS NULL THEN [] ELSE ['enriched', 'x1'] END))), ',') AS tags FROM v_item LEFT JOIN x ON h = sha256(title)")
def j9(spark, d):
    rows = views.items(spark, d)
    new = rows.filter("role = 'CAPABILITY'").select(F.sha2("title", 256).alias("h"), F.concat(F.lit("N: "), "title").alias("new_title")).distinct()
    out = rows.join(new, F.sha2("title", 256) == c("h"), "left")
    extra = F.when(c("new_title").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("enriched"), F.lit("x1")))
    return out.select("id", F.coalesce("new_title", "title").alias("title"), F.array_join(F.array_sort(F.array_union("tags", extra)), ",").alias("tags"))


@query("j10_needs_work", f"WITH {views.ITEMS} SELECT id, {COMPOSITE} AS composite FROM v_item WHERE role <> 'CAPABILITY' AND id NOT IN (SELECT id FROM v_item WHERE role = 'ADOPTION') ORDER BY composite DESC, id LIMIT 20")
def j10(spark, d):
    rows = scored(spark, d)
    done = rows.filter("role = 'ADOPTION'").select("id")
    return rows.filter("role != 'CAPABILITY'").join(done, "id", "left_anti").select("id", "composite").orderBy(F.desc("composite"), "id").limit(20)


@query("j11_insight_links", f"WITH {views.ITEMS}, ins AS (SELECT doc_id AS insight, 'dc-' || 'i' || lpad(CAST(doc_id * 3 AS VARCHAR), 9, '0') AS ref FROM documents) SELECT id, min(insight) AS insight FROM v_item JOIN ins ON regexp_replace(ref, '^dc-', '') = id GROUP BY id")
def j11(spark, d):
    ref = F.concat(F.lit("dc-i"), F.lpad((c("doc_id") * 3).cast("string"), 9, "0"))
    links = docs(spark, d).select(c("doc_id").alias("insight"), F.regexp_replace(ref, "^dc-", "").alias("of"))
    return views.items(spark, d).join(links, c("id") == c("of")).groupBy("id").agg(F.min("insight").alias("insight"))


@query("j12_live_over_snapshot", "SELECT s.o_custkey, coalesce(CASE WHEN c_acctbal > 1000 THEN c_name END, s.snap) AS name FROM (SELECT o_custkey, 'old-' || CAST(max(o_orderkey) AS VARCHAR) AS snap FROM orders GROUP BY 1) s LEFT JOIN customer ON c_custkey = s.o_custkey")
def j12(spark, d):
    snap = views.table(spark, d, "orders").groupBy("o_custkey").agg(F.concat(F.lit("old-"), F.max("o_orderkey").cast("string")).alias("snap"))
    live = views.table(spark, d, "customer").filter("c_acctbal > 1000").select("c_custkey", "c_name")
    return snap.join(live, c("o_custkey") == c("c_custkey"), "left").select("o_custkey", F.coalesce("c_name", "snap").alias("name"))


@query("j13_budgeted_extracts", f"""WITH {views.RECORDS}, e AS (SELECT * FROM v_rec WHERE authority >= 70 AND product IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY published_at DESC, id) AS n FROM e)
  SELECT id, n <= 8 AS fetched, CASE WHEN n <= 8 THEN length(title) + length(summary) ELSE length(summary) END AS size FROM b""")
def j13(spark, d):
    rows = views.records(spark, d).filter("authority >= 70 and product is not null")
    n = F.row_number().over(Window.partitionBy("org").orderBy(F.col("published_at").desc(), "id"))
    rows = rows.withColumn("fetched", n <= 8)
    return rows.select("id", "fetched", F.when(c("fetched"), F.length("title") + F.length("summary")).otherwise(F.length("summary")).cast("long").alias("size"))


# -------------------------------------------------------------- aggregates and sorts


@query("a7_bad_case_analysis", f"WITH {views.ACTIVITY} SELECT coalesce(event_type, '') AS reason, coalesce(CAST(user_id AS VARCHAR), '') AS source, count(*) AS n, grouping(event_type, user_id) AS level FROM v_ev GROUP BY GROUPING SETS ((event_type), (user_id), ())")
def a7(spark, d):
    return analytics.grouped_counts(views.activity(spark, d), "event_type", "user_id").select(F.coalesce("event_type", F.lit("")).alias("reason"), F.coalesce(c("user_id").cast("string"), F.lit("")).alias("source"), "n", "level")


@query("a8_group_counts", f"WITH {views.ITEMS} SELECT coalesce(role, 'all') AS grp, count(*) AS n FROM v_item GROUP BY ROLLUP (role)")
def a8(spark, d):
    return views.items(spark, d).rollup("role").agg(F.count("*").alias("n")).select(F.coalesce("role", F.lit("all")).alias("grp"), "n")


PREFS = f"""{views.ITEMS}, {views.ACTIVITY}, used AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 14 ELSE 10 END AS w, v_item.* FROM v_ev JOIN v_item ON id = 'i' || lpad(CAST(event_id // 10 AS VARCHAR), 9, '0')),
  prefs AS (SELECT user_id, 'source' AS kind, source AS key, sum(w) * 10 AS weight FROM used GROUP BY ALL UNION ALL SELECT user_id, 'role', role, sum(w) * 10 FROM used GROUP BY ALL
  UNION ALL SELECT user_id, 'tag', lower(tag), sum(w) * 6 FROM (SELECT user_id, w, unnest(tags) AS tag FROM used) WHERE NOT starts_with(lower(tag), 'ai-') GROUP BY ALL)"""


def used(spark, d):
    return views.activity(spark, d).select("user_id", F.when(c("event_type") == "purchase", 14).otherwise(10).alias("w"), F.concat(F.lit("i"), F.lpad(F.floor(c("event_id") / 10).cast("string"), 9, "0")).alias("item"))


def prefs(spark, d):
    rows = used(spark, d).join(views.items(spark, d), c("item") == c("id"))
    return analytics.preferences(rows, "user_id", "w", {"source": c("source"), "role": c("role")}, "tags")


@query("a9_preference_vectors", f"WITH {PREFS} SELECT user_id, kind, key, CAST(weight AS BIGINT) AS weight FROM prefs")
def a9(spark, d):
    return prefs(spark, d)


@query("t6_personal_boost", f"""WITH {PREFS}, keys AS (SELECT id, 'source' AS kind, source AS key, 6 AS f FROM v_item UNION ALL SELECT id, 'role', role, 4 FROM v_item UNION ALL SELECT id, 'tag', lower(tag), 3 FROM (SELECT id, unnest(tags) AS tag FROM v_item))
  SELECT user_id, id, CAST(least(4800, sum(weight * f)) AS BIGINT) AS boost FROM (SELECT DISTINCT user_id, id FROM used) JOIN keys USING (id) JOIN prefs USING (user_id, kind, key) GROUP BY ALL""")
def t6(spark, d):
    """For each user the items that they met."""
    met = used(spark, d).select("user_id", c("item").alias("id")).distinct()
    return analytics.boosts(views.items(spark, d), prefs(spark, d), "id", {"source": (c("source"), 6), "role": (c("role"), 4)}, ("tags", 3), 4800, among=met)


@query("a10_venue_discovery", "SELECT p_type AS venue, count(*) AS n, max(CASE WHEN contains(lower(p_type), seed) OR contains(seed, lower(p_type)) THEN seed END) AS seed FROM part, (VALUES ('brass'), ('steel'), ('promo')) s(seed) GROUP BY p_type".replace("count(*)", "count(DISTINCT p_partkey)"))
def a10(spark, d):
    seeds = [F.lit(s) for s in ("brass", "steel", "promo")]
    low = F.lower("venue")
    match = F.array_max(F.filter(F.array(*seeds), lambda s: F.contains(low, s) | F.contains(s, low)))
    return views.table(spark, d, "part").groupBy(c("p_type").alias("venue")).agg(F.count_distinct("p_partkey").alias("n")).select("venue", "n", match.alias("seed"))


@query("a12_ranking_report", f"""WITH {views.ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, id) AS seat FROM v_item), w AS (SELECT * FROM r WHERE seat <= 10), l AS (SELECT *, lag(topic) OVER (PARTITION BY source ORDER BY seat) = topic AS clash FROM w)
  SELECT source, count(*) FILTER (WHERE role = 'SUPPLY') AS supply, count(*) FILTER (WHERE role = 'CAPABILITY') AS capability, count(*) FILTER (WHERE coalesce(clash, false)) AS clashes FROM l GROUP BY source""")
def a12(spark, d):
    rows = windows.first_n(views.items(spark, d), ["source"], [F.desc("published_at"), c("id")], 10)
    rows = windows.streaks(rows, ["source"], [F.desc("published_at"), c("id")], "topic")
    return rows.groupBy("source").agg(F.count_if(c("role") == "SUPPLY").alias("supply"), F.count_if(c("role") == "CAPABILITY").alias("capability"), F.count_if("same_as_before").alias("clashes"))


@query("t1_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def t1(spark, d):
    return views.table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)


@query("t2_feed_sort", f"WITH {views.ITEMS} SELECT id, {COMPOSITE} AS composite, CAST(row_number() OVER (PARTITION BY source ORDER BY {COMPOSITE} DESC, id) AS INTEGER) AS ranked, CAST(row_number() OVER (PARTITION BY source ORDER BY published_at DESC, id) AS INTEGER) AS newest FROM v_item")
def t2(spark, d):
    w = Window.partitionBy("source")
    return scored(spark, d).select("id", "composite", F.row_number().over(w.orderBy(F.desc("composite"), "id")).alias("ranked"), F.row_number().over(w.orderBy(F.desc("published_at"), "id")).alias("newest"))


@query("t3_board_sort", f"WITH {views.ITEMS}, q AS (SELECT *, floor(({QUALITY}) / 2) AS band FROM v_item) SELECT id, CAST(row_number() OVER (PARTITION BY source ORDER BY role = 'SUPPLY' DESC, band DESC, stars DESC, published_at DESC, id) AS INTEGER) AS seat FROM q")
def t3(spark, d):
    rows = scored(spark, d)
    rows = rows.withColumn("band", F.floor(quality(rows) / 2))
    order = [(c("role") == "SUPPLY").desc(), F.desc("band"), F.desc("stars"), F.desc("published_at"), c("id")]
    return rows.select("id", F.row_number().over(Window.partitionBy("source").orderBy(*order)).alias("seat"))


@query("u_all_bag_union", "SELECT 'event' AS src, event_id AS id, CAST(value AS DOUBLE) AS value FROM events UNION ALL SELECT 'order', o_orderkey, o_totalprice FROM orders")
def u_all(spark, d):
    a = views.table(spark, d, "events").select(F.lit("event").alias("src"), c("event_id").alias("id"), c("value").cast("double").alias("value"))
    return a.unionByName(views.table(spark, d, "orders").select(F.lit("order").alias("src"), c("o_orderkey").alias("id"), c("o_totalprice").alias("value")), allowMissingColumns=True)


@query("u_set_arrays", f"WITH {views.ITEMS} SELECT id, array_to_string(list_sort(list_intersect(tags, ['tag1', 'x2', 'ai-en'])), ',') AS both_, len(list_distinct(list_concat(tags, ['tag1', 'x2', 'ai-en']))) AS n FROM v_item")
def u_set(spark, d):
    other = F.array(F.lit("tag1"), F.lit("x2"), F.lit("ai-en"))
    return views.items(spark, d).select("id", F.array_join(F.array_sort(F.array_intersect("tags", other)), ",").alias("both_"), F.size(F.array_union("tags", other)).cast("long").alias("n"))


@query("s23_library_scan", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def s23(spark, d):
    return views.table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)


@query("s20_story_list", f"WITH {views.ACTIVITY} SELECT event_id, k FROM v_ev WHERE event_type = 'click' AND k >= 15 ORDER BY k DESC, event_id LIMIT 30")
def s20(spark, d):
    return views.activity(spark, d).filter("event_type = 'click' and k >= 15").select("event_id", "k").orderBy(F.desc("k"), "event_id").limit(30)


# --------------------------------------------------------------------------- state


@query("w1_review_merge", """WITH q AS (SELECT o_custkey AS id, max(o_orderkey) AS v, bool_or(o_orderstatus = 'F') AS confirmed FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS id, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1),
  m AS (SELECT coalesce(q.id, n.id) AS id, CASE WHEN q.confirmed OR n.v IS NULL THEN q.v ELSE n.v END AS v, coalesce(q.confirmed, false) AS confirmed FROM q FULL JOIN n ON q.id = n.id) SELECT * FROM m ORDER BY v DESC, id LIMIT 500""")
def w1(spark, d):
    orders = views.table(spark, d, "orders")
    stored = orders.filter("o_orderkey % 2 = 0").groupBy(c("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("v"), F.bool_or(c("o_orderstatus") == "F").alias("confirmed"))
    new = orders.filter("o_orderkey % 2 = 1").groupBy(c("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("v"))
    return state.merge_queue(stored, new, "id", "v", "confirmed", 500)


@query("w2_review_actions", f"WITH {views.ACTIVITY} SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS last_action, max(CASE WHEN event_type = 'purchase' THEN ts END) AS confirmed_at, count(*) AS n_actions FROM v_ev GROUP BY user_id")
def w2(spark, d):
    return state.fold_actions(views.activity(spark, d), "user_id", "event_type", ["ts", "event_id"], "purchase")


@query("w3_community_queue", f"WITH {views.ACTIVITY}, s AS (SELECT user_id, max(k) AS k FROM v_ev WHERE event_type <> 'view' GROUP BY 1) SELECT user_id, k FROM s ORDER BY k DESC, user_id LIMIT 500")
def w3(spark, d):
    return views.activity(spark, d).filter("event_type != 'view'").groupBy("user_id").agg(F.max("k").alias("k")).orderBy(F.desc("k"), "user_id").limit(500)


@query("w4_run_retention", f"WITH {views.ACTIVITY}, r AS (SELECT *, dense_rank() OVER (ORDER BY user_id DESC) AS run FROM v_ev) SELECT event_id FROM r WHERE run <= 40 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def w4(spark, d):
    return state.retain_runs(views.activity(spark, d), "user_id", [F.desc("ts"), F.desc("event_id")], 40, 50).select("event_id")


@query("w5_cache_prune", f"WITH {views.ACTIVITY} SELECT event_id FROM v_ev WHERE coalesce(CASE WHEN k = 0 THEN NULL ELSE ts END, TIMESTAMP '2024-01-20') >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY ORDER BY coalesce(CASE WHEN k = 0 THEN NULL ELSE ts END, TIMESTAMP '2024-01-20') DESC, event_id LIMIT 1000")
def w5(spark, d):
    rows = views.activity(spark, d).withColumn("at", F.when(c("k") != 0, c("ts")))
    return state.prune(rows, "at", F.lit("2024-01-20").cast("timestamp"), 7, 1000, "event_id").select("event_id")


@query("w6_toggle_state", f"WITH {views.ACTIVITY} SELECT user_id, k, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS last_id FROM v_ev GROUP BY ALL HAVING count(*) % 2 = 1")
def w6(spark, d):
    return state.toggled(views.activity(spark, d), ["user_id", "k"], ["ts", "event_id"], "event_id")


@query("w7_bad_case_log", f"WITH {views.ACTIVITY} SELECT event_id, event_type FROM v_ev WHERE k < 30 ORDER BY ts DESC, event_id DESC LIMIT 500")
def w7(spark, d):
    return views.activity(spark, d).filter("k < 30").select("event_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).drop("ts")


@query("w9_capped_reenter", f"WITH {views.ACTIVITY}, last AS (SELECT max(k) AS k FROM v_ev WHERE event_type = 'click') SELECT event_id FROM v_ev JOIN last USING (k) WHERE event_type = 'click'")
def w9(spark, d):
    rows = views.activity(spark, d).filter("event_type = 'click'")
    return rows.join(rows.agg(F.max("k").alias("k")), "k").select("event_id")
