"""Queries over what a feed shows: headlines, briefs and labels by the whole rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.operators import briefs, projections
from gleanery.plans import queries_findings as qf
from gleanery.plans import views
from gleanery.plans.registry import query

c = F.col
SPACE = r"'[\s ]+'"


def squeezed(x):
    return f"trim(regexp_replace({x}, {SPACE}, ' ', 'g'))"


def clause(x, most):
    mark = f"length(regexp_extract({x}, '^[^.!?]*'))"
    cut = rf"rtrim(regexp_replace(substring({x}, 1, {most - 1}), '\s+\S*$', '')) || '…'"
    return f"trim(regexp_replace(CASE WHEN {mark} < length({x}) AND {mark} BETWEEN 24 AND {most} THEN substring({x}, 1, {mark}) WHEN length({x}) > {most} THEN {cut} ELSE {x} END, '[.]+$', ''))"


def capital(x):
    return f"CASE WHEN {squeezed(x)} = '' THEN 'AI update' ELSE upper(substring({squeezed(x)}, 1, 1)) || substring({squeezed(x)}, 2) END"


def hit(x, pattern):
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


NO_SUMMARY, GENERIC = briefs.NO_SUMMARY, briefs.GENERIC_START
RAW = """raws AS (SELECT doc_id, source, substring(split_part(text, chr(10), 1), 1, 60 + doc_id % 90) AS line, text FROM documents),
titled AS (SELECT doc_id, source, CASE doc_id % 8 WHEN 0 THEN 'v' || CAST(doc_id AS VARCHAR) || '.2-rc1' WHEN 1 THEN 'Changelog' WHEN 2 THEN line || ' - Official Blog' WHEN 3 THEN 'Release: ' || line WHEN 4 THEN substring(line, 1, 20) ELSE line END AS title, coalesce(text, '') AS summary,
  CASE doc_id % 5 WHEN 0 THEN source || '/my-API_toolKit' || CAST(doc_id % 10 AS VARCHAR) WHEN 1 THEN '' END AS repo FROM raws)"""
HEADLINES = f"""WITH {RAW}, t AS (SELECT *, {squeezed('title')} AS raw, {squeezed('summary')} AS about FROM titled),
u AS (SELECT *, {clause('about', 110)} AS cl, trim(regexp_replace(regexp_replace(raw, '{briefs.TITLE_ENDS}', ''), '{briefs.TITLE_STARTS}', '')) AS plain, nullif(trim(repo), '') AS name, CASE WHEN about <> '' THEN about WHEN NOT {hit('raw', briefs.VERSION_TAG)} THEN raw ELSE '' END AS said FROM t),
v AS (SELECT *, CASE WHEN source <> 'src1' AND NOT ({hit('plain', '[一-鿿]')} AND length(plain) >= 8) AND (length(plain) < 28 OR {hit('plain', briefs.VAGUE_TITLE)}) AND cl <> '' AND length(cl) > length(plain) AND NOT {hit('cl', NO_SUMMARY)} THEN cl ELSE plain END AS chosen,
  {clause('said', 100)} AS core, string_split(name, '/')[-1] AS slug, array_to_string(list_transform(string_split({squeezed("regexp_replace(regexp_replace(string_split(name, '/')[-1], '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[-_]+', ' ', 'g')")}, ' '),
    lambda w: CASE WHEN lower(w) IN ({', '.join(f"'{w}'" for w in briefs.CAPITALS)}) OR length(w) <= 2 THEN upper(w) ELSE upper(substring(w, 1, 1)) || substring(w, 2) END), ' ') AS project FROM u),
w AS (SELECT *, {clause('chosen', 118)} AS short FROM v)
SELECT doc_id, md5(CASE WHEN name IS NOT NULL THEN
    CASE WHEN said = '' OR {hit('said', briefs.VERSION_TAG)} OR core = '' THEN project || '{briefs.QUIET_PROJECT}' WHEN lower(core) IN (lower(slug), lower(name), lower(project)) THEN project || '{briefs.ACTIVE_PROJECT}'
      WHEN length(core) < 48 AND NOT {hit('core', briefs.NAMES_ITSELF)} THEN {capital("(project || ' — ' || core)")} WHEN {hit('core', GENERIC)} THEN {capital("(project || ': ' || core)")} ELSE {capital('core')} END
  WHEN {hit('raw', briefs.VERSION_TAG)} THEN CASE WHEN cl <> '' AND NOT {hit('cl', briefs.VERSION_TAG)} THEN {capital("(source || ': ' || cl)")} ELSE {capital(f"(source || '{briefs.NEW_MODEL}')")} END
  ELSE {capital("(CASE WHEN short = '' THEN chosen ELSE short END)")} END) AS headline FROM w"""


def titled(spark, d):
    k, line = c("doc_id"), F.split_part("text", F.lit("\n"), F.lit(1)).substr(F.lit(1), (60 + c("doc_id") % 90).cast("int"))
    title = F.when(k % 8 == 0, F.concat(F.lit("v"), k.cast("string"), F.lit(".2-rc1"))).when(k % 8 == 1, "Changelog").when(k % 8 == 2, F.concat(line, F.lit(" - Official Blog"))).when(k % 8 == 3, F.concat(F.lit("Release: "), line)).when(k % 8 == 4, F.substring(line, 1, 20)).otherwise(line)
    repo = F.when(k % 5 == 0, F.concat("source", F.lit("/my-API_toolKit"), (k % 10).cast("string"))).when(k % 5 == 1, "")
    return views.table(spark, d, "documents").select("doc_id", "source", title.alias("title"), F.coalesce("text", F.lit("")).alias("summary"), repo.alias("repo"))


@query("p16_headline_rules", HEADLINES)
def p16(spark, d):
    """Version tags, vague and short titles, boilerplate, repositories."""
    return briefs.with_headlines(titled(spark, d), "src1").select("doc_id", F.md5("headline").alias("headline"))


WHY = {"Agents": "It carries judgment, not only tasks.", "Video": "It changes how people edit."}
IMPACT = {"Agents": "Skills can be reused.", "Video": "Editors can steer while they watch."}
NEITHER = ("It may need a response.", "Review whether it changes what is shipped.")


def case_of(table, default):
    return "CASE cue " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


PAPER_BRIEFS = f"""WITH p AS (SELECT doc_id, split_part(text, chr(10), 1) AS finding, CASE lang WHEN 'en' THEN 'Agents' WHEN 'fr' THEN 'Video' END AS cue, CASE WHEN n_chars > 2000 THEN 'code available' ELSE 'preprint; maturity unproven' END AS maturity FROM documents),
b AS (SELECT doc_id, finding AS what_happened, {case_of(WHY, NEITHER[0])} AS why_it_matters, {case_of(IMPACT, NEITHER[1])} AS potential_impact, CASE WHEN cue IS NOT NULL THEN cue || ': ' || substring(finding, 1, 140) ELSE substring(finding, 1, 160) END || ' (' || maturity || ').' AS key_takeaway FROM p)"""


def paper_briefs(spark, d):
    docs = views.table(spark, d, "documents")
    cue = F.when(c("lang") == "en", "Agents").when(c("lang") == "fr", "Video")
    finding = F.split_part("text", F.lit("\n"), F.lit(1))
    maturity = F.when(c("n_chars") > 2000, "code available").otherwise("preprint; maturity unproven")
    return docs.select("doc_id", *[v.alias(k) for k, v in briefs.paper_brief(finding, cue, maturity, WHY, IMPACT, NEITHER).items()])


@query("p23_paper_briefs", PAPER_BRIEFS + " SELECT doc_id, md5(what_happened) AS what, why_it_matters, potential_impact, md5(key_takeaway) AS take FROM b")
def p23_paper(spark, d):
    return paper_briefs(spark, d).select("doc_id", F.md5("what_happened").alias("what"), "why_it_matters", "potential_impact", F.md5("key_takeaway").alias("take"))


COMMUNITY_BRIEFS = f"""WITH {views.EVIDENCE}, {qf.GATED}, urls AS (SELECT product, topic, window_start, list_sort(list(evidence_id))[1:3] AS ids FROM placed GROUP BY ALL),
g AS (SELECT gated.*, ids, greatest(1, CAST(floor((epoch_us(last_seen_at) - epoch_us(first_seen_at)) / 86400000000.0 + 0.5) AS INTEGER)) AS days FROM gated JOIN urls USING (product, topic, window_start) WHERE status = 'PUBLISH'),
b AS (SELECT product, topic, window_start, topic || '. ' || CAST(n_authors AS VARCHAR) || ' independent authors across ' || CAST(n_evidence AS VARCHAR) || ' evidence records.' AS what_happened,
  'This is a recurring ' || lower(replace(finding_type, '_', ' ')) || ' pattern over ' || CAST(days AS VARCHAR) || ' day(s), not a single complaint.' AS why_it_matters, 'Workflows may change.' AS potential_impact,
  substring('Test or watch ' || product || ' against the retained evidence: ' || array_to_string(list_transform(ids, lambda x: 'https://e.org/' || x), ' '), 1, 320) AS key_takeaway FROM g)"""


def community_briefs(spark, d):
    placed = qf.placed(qf.evidence(spark, d))
    keys = ["product", "topic", "window_start"]
    # the first three ids by a windowed rank, not a list of all
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("evidence_id"))
    urls = placed.select(*keys, "evidence_id").withColumn("n", first).filter("n <= 3").groupBy(*keys).agg(F.array_sort(F.collect_list(F.concat(F.lit("https://e.org/"), F.lower(F.hex("evidence_id"))))).alias("urls"))
    rows = qf.findings.gate(qf.findings.roll_up(placed, keys), lone_family="R").filter("status = 'PUBLISH'").join(urls, keys)
    days = projections.span_days(c("first_seen_at"), c("last_seen_at"))
    brief = briefs.community_brief(F.concat("topic", F.lit(".")), c("n_authors"), c("n_evidence"), c("finding_type"), days, c("product"), c("urls"), "Workflows may change.")
    return rows.select(*keys, *[v.alias(k) for k, v in brief.items()])


@query("p23_community_briefs", COMMUNITY_BRIEFS + " SELECT * FROM b")
def p23_community(spark, d):
    return community_briefs(spark, d)


def sql_shown(x):
    return squeezed(rf"regexp_replace({x}, '(?i)https?://\S+', ' ', 'g')")


def sql_same(a, b):
    x, y = (rf"trim(regexp_replace(lower({v}), '[^a-z0-9一-鿿]+', ' ', 'g'))" for v in (a, b))
    return f"({x} <> '' AND {y} <> '' AND ({x} = {y} OR (length({x}) >= 24 AND contains({y}, {x})) OR (length({y}) >= 24 AND contains({x}, {y}))))"


PRESENTED = f"""{COMMUNITY_BRIEFS}, s1 AS (SELECT * EXCLUDE (potential_impact), CASE WHEN length(topic) % 2 = 0 THEN topic || ' is seen again and again https://x.org' ELSE 'skim the source, then decide' END AS potential_impact FROM b),
s2 AS (SELECT product, topic, window_start, {sql_shown(f"regexp_replace(what_happened, '{briefs.EVIDENCE_PHRASE}', ' ', 'g')")} AS what, {sql_shown('why_it_matters')} AS why, {sql_shown('potential_impact')} AS impact, {sql_shown('potential_impact')} AS take FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN {hit('take', briefs.EMPTY_TAKE)} THEN '' ELSE take END AS take, CASE WHEN {hit('why', briefs.EMPTY_WHY)} OR {sql_same('why', 'what')} THEN '' ELSE why END AS why) FROM s2),
s4 AS (SELECT * REPLACE (CASE WHEN {sql_same('impact', 'what')} OR {sql_same('impact', 'why')} THEN '' ELSE impact END AS impact) FROM s3)
SELECT * REPLACE (CASE WHEN {sql_same('take', 'what')} OR {sql_same('take', 'why')} OR {sql_same('take', 'impact')} THEN '' ELSE take END AS take) FROM s4"""


@query("p24_presented_briefs", PRESENTED)
def p24(spark, d):
    said = F.when(F.length("topic") % 2 == 0, F.concat("topic", F.lit(" is seen again and again https://x.org"))).otherwise("skim the source, then decide")
    rows = briefs.presented(community_briefs(spark, d).withColumns({"potential_impact": said, "key_takeaway": said}))
    return rows.select("product", "topic", "window_start", c("what_happened").alias("what"), c("why_it_matters").alias("why"), c("potential_impact").alias("impact"), c("key_takeaway").alias("take"))


@query("p32_source_groups", "SELECT source, CASE WHEN source IN ('src0', 'src1') THEN 'labs' WHEN source = 'src2' THEN 'research' ELSE 'community' END AS grp, count(*) AS n FROM documents GROUP BY ALL")
def p32_groups(spark, d):
    """The group of a source by a table of groups; what no group names is community."""
    groups = spark.createDataFrame([("src0", "labs"), ("src1", "labs"), ("src2", "research")], "named string, grp string")
    rows = views.table(spark, d, "documents").join(F.broadcast(groups), c("source") == c("named"), "left")  # a fixed table
    return rows.groupBy("source", F.coalesce("grp", F.lit("community")).alias("grp")).agg(F.count("*").alias("n"))


@query("p32_queue_states", f"WITH {views.EVIDENCE}, {qf.CAPPED} SELECT CASE status WHEN 'PUBLISH' THEN 'publish' WHEN 'WATCH' THEN 'watch' ELSE 'review-queue' END AS state, count(*) AS n FROM capped GROUP BY ALL")
def p32_states(spark, d):
    state = F.when(c("status") == "PUBLISH", "publish").when(c("status") == "WATCH", "watch").otherwise("review-queue")
    return qf.capped(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n"))
