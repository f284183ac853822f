"""Organisations, topics, families and labels by the default rules, and release notes as a table function."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import lexicons as lex
from gleanery.operators import identity
from gleanery.plans import views
from gleanery.plans.queries_defaults import first_of
from gleanery.plans.queries_sources import NOTES_SQL, note_pages
from gleanery.plans.registry import query
from gleanery.sources import notes

c = F.col
#: Words that topics go by; each item's title gets one, by its stars.
SAID = ["a memory of its own", "Skill transfer", "harassment online", "video in, voice out", "the agent", "MCP session", "a tool call fails", "install it", "GPT-5 is here", "Kimi", ""]

ROWS = f"""{views.ITEMS}, r AS (SELECT id, source, role, split_part(title, ' ', 1) || ': ' || {SAID}[CAST(stars % {len(SAID)} AS INTEGER) + 1] AS title, summary,
  CASE stars % 3 WHEN 0 THEN title || ', ' || lang WHEN 1 THEN ' , x' END AS author, CASE WHEN stars % 4 = 0 THEN 'P' || id END AS paper, CASE WHEN stars % 5 = 0 THEN 'Model ' || topic || '.1' END AS model,
  CASE WHEN stars % 7 = 0 THEN 'Agent UX' END AS cue, ['live', CASE stars % 8 WHEN 0 THEN 'evidence:3' WHEN 1 THEN 'tool-calling' WHEN 2 THEN 'MyTool' ELSE 'friction' END] AS tags,
  CASE stars % 5 WHEN 0 THEN ['unknown', 'Tool A'] WHEN 1 THEN ['unknown'] ELSE CAST([] AS VARCHAR[]) END AS products FROM v_item)"""


def rows(spark, d):
    """Items with the fields that the rules ask for."""
    n = c("stars")
    tag = F.when(n % 8 == 0, "evidence:3").when(n % 8 == 1, "tool-calling").when(n % 8 == 2, "MyTool").otherwise("friction")
    products = F.when(n % 5 == 0, F.array(F.lit("unknown"), F.lit("Tool A"))).when(n % 5 == 1, F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>"))
    return views.items(spark, d).select(
        "id", "source", "role", F.concat(F.split_part("title", F.lit(" "), F.lit(1)), F.lit(": "), F.get(F.array(*[F.lit(s) for s in SAID]), (n % len(SAID)).cast("int"))).alias("title"), "summary",
        F.when(n % 3 == 0, F.concat("title", F.lit(", "), "lang")).when(n % 3 == 1, " , x").alias("author"), F.when(n % 4 == 0, F.concat(F.lit("P"), "id")).alias("paper"), F.when(n % 5 == 0, F.concat(F.lit("Model "), "topic", F.lit(".1"))).alias("model"),
        F.when(n % 7 == 0, "Agent UX").alias("cue"), F.array(F.lit("live"), tag).alias("tags"), products.alias("products"),
    )


HEAD = "nullif(trim(split_part(author, ',', 1)), '')"
WHOLE = "lower(title || ' ' || summary || ' ' || coalesce(author, ''))"


@query("p28_organization_topic", f"""WITH {ROWS} SELECT id,
  CASE role WHEN 'ADOPTION' THEN lower(coalesce({HEAD}, list_filter(tags, lambda t: t NOT IN ('{"', '".join(lex.PLAIN_TAGS)}') AND NOT starts_with(t, '{lex.PLAIN_TAG_PREFIX}'))[1], 'community')) WHEN 'CAPABILITY' THEN lower(coalesce(paper, {HEAD}, id)) ELSE source END AS organization,
  CASE role WHEN 'SUPPLY' THEN coalesce(regexp_replace(lower(model), '[^a-z0-9]+', '-', 'g'), nullif(regexp_extract({WHOLE}, '{lex.LAUNCH_MODELS}', 1), ''), 'launch')
    WHEN 'ADOPTION' THEN coalesce(list_filter({lex.TAGGED_TOPICS}, lambda t: list_contains(tags, t))[1], {first_of(WHOLE, lex.ADOPTION_TOPICS, "'adoption'")}) ELSE {first_of(WHOLE, lex.PAPER_TOPICS, "coalesce(lower(cue), 'paper')")} END AS topic FROM r""")
def p28(spark, d):
    """Organisation and topic of each item by the rules of its role."""
    who = identity.organization(c("role"), c("id"), c("source"), c("author"), c("tags"), c("paper"))
    what = identity.topic(c("role"), c("title"), c("summary"), c("author"), c("tags"), c("model"), F.lit(None).cast("string"), c("cue"))
    return rows(spark, d).select("id", who.alias("organization"), what.alias("topic"))


KEY = "regexp_replace(regexp_replace(lower(coalesce(nullif(author, ''), nullif(source, ''), 'unknown')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query("p30_key_and_family", f"""WITH {ROWS}, k AS (SELECT *, {KEY} AS key FROM r) SELECT id, key, CASE WHEN role = 'ADOPTION' THEN coalesce(lower(list_filter(products, lambda p: p <> '' AND p <> 'unknown')[1]), lower(nullif(regexp_extract(title, '^([A-Za-z0-9-]+):', 1), '')), key) ELSE key END AS family FROM k""")
def p30(spark, d):
    """Organisation keys, and product families of community items."""
    key = identity.organization_key(F.lit(None).cast("string"), c("author"), c("source"))
    return rows(spark, d).withColumn("key", key).select("id", "key", identity.product_family(c("role"), c("products"), c("title"), c("key")).alias("family"))


def cases(code, labels, default):
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE {default} END"


@query("p32_role_labels", f"WITH {views.ITEMS} SELECT source, role, {cases('role', lex.VALUE_CUES, 'NULL')} AS cue, {cases('role', lex.EVIDENCE_ROLES, repr(lex.OTHER_EVIDENCE_ROLE))} AS evidence, '{lex.OTHER_SOURCE_GROUP}' AS source_group, count(*) AS n FROM v_item GROUP BY ALL")
def p32_roles(spark, d):
    """Value cue, evidence label and source group of items, counted."""
    return views.items(spark, d).groupBy("source", "role").agg(F.count("*").alias("n")).select("source", "role", identity.value_cue(c("role")).alias("cue"), identity.evidence_role(c("role")).alias("evidence"), identity.source_group(c("source")).alias("source_group"), "n")


REASON = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'duplicate' WHEN o_orderpriority = '2-HIGH' THEN 'capped' WHEN o_orderstatus = 'P' THEN 'outside-window' WHEN o_orderpriority = '3-MEDIUM' THEN 'r6-else' END"


@query("p32_reason_status", f"SELECT {REASON} AS reason, {cases(REASON, lex.REASON_STATUSES, repr(lex.OTHER_REASON_STATUS))} AS status, count(*) AS n FROM orders GROUP BY ALL")
def p32_reasons(spark, d):
    """The status that each reason stands for."""
    return views.table(spark, d, "orders").groupBy(F.expr(REASON).alias("reason")).agg(F.count("*").alias("n")).select("reason", identity.reason_status(c("reason")).alias("status"), "n")


def lateral(spark, d, kind, form):
    """Release notes by SQL: a row of pages to many rows of entries."""
    notes.register(spark)
    pages = note_pages(spark, d, kind)
    return spark.sql("SELECT page, day, title FROM {pages}, LATERAL release_notes(body, {form})", pages=pages, form=form)


@query("s5_notes_lateral", NOTES_SQL.format(""))
def s5_lateral(spark, d):
    return lateral(spark, d, "html", "html")


@query("s6_notes_lateral", NOTES_SQL.format(" of the day"))
def s6_lateral(spark, d):
    return lateral(spark, d, "md", "bullets")
