"""The classifiers and gates with their default rule tables, over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import lexicons as lex
from gleanery.operators import defaults
from gleanery.plans import views
from gleanery.plans.registry import query

c = F.col
#: Each document as a title (its first line), a body, and the fields that the rules ask for.
TEXTS = """t AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS body, split_part(text, chr(10), 1) || chr(10) || text AS whole, source, CASE lang WHEN 'en' THEN 'hn' WHEN 'fr' THEN 'github-issues' ELSE 'x' END AS family, n_chars % 250 AS comments, n_chars * 20 AS stars FROM documents)"""


def texts(spark, d):
    family = F.when(c("lang") == "en", "hn").when(c("lang") == "fr", "github-issues").otherwise("x")
    return views.table(spark, d, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), c("text").alias("body"), "source", family.alias("family"), (c("n_chars") % 250).alias("comments"), (c("n_chars") * 20).alias("stars"))


def has(column, pattern):
    return "regexp_matches({}, '(?i){}')".format(column, pattern.replace("'", "''"))


def first_of(column, table, default):
    return "CASE " + " ".join(f"WHEN {has(column, r.pattern)} THEN '{r.label}'" for r in table) + f" ELSE {default} END"


def all_of(column, table):
    return "list_filter([" + ", ".join(f"CASE WHEN {has(column, r.pattern)} THEN '{r.label}' END" for r in table) + "], lambda x: x IS NOT NULL)"


def any_pattern(column, patterns):
    return "(" + " OR ".join(has(column, p) for p in patterns) + ")"


@query("c1_default_topics", f"WITH {TEXTS} SELECT doc_id, {first_of('whole', lex.TOPICS, chr(39) + 'other' + chr(39))} AS topic, {first_of('whole', lex.PRODUCTS, chr(39) + 'unknown' + chr(39))} AS product FROM t")
def c1(spark, d):
    return texts(spark, d).select("doc_id", defaults.topic(c("title"), c("body")).alias("topic"), defaults.product(c("source"), c("title"), c("body")).alias("product"))


@query("c2_default_capabilities", f"WITH {TEXTS} SELECT doc_id, array_to_string({all_of('trim(body)', lex.CAPABILITIES)}, ',') AS keys FROM t")
def c2(spark, d):
    return texts(spark, d).select("doc_id", F.array_join(defaults.capability_keys(c("body")), ",").alias("keys"))


X = {k: lambda column, p=p: has(column, p) for k, p in lex.EXCLUSIONS.items()}
REPRO = f"(NOT {X['no_repro']('whole')} AND {X['repro']('whole')})"
EXCLUSION = f"""CASE WHEN {X['spam']('whole')} OR comments >= 200 THEN 'agent-spam' WHEN family = 'hn' AND {X['show']('trim(title)')} THEN 'show-hn-no-adoption' WHEN {X['job']('title')} THEN 'job-post' WHEN {X['benchmark']('whole')} AND NOT {REPRO} THEN 'benchmark-argument'
  WHEN {X['repost']('whole')} AND NOT {REPRO} THEN 'official-launch-repost' WHEN {X['media']('whole')} AND family = 'hn' THEN 'media-repost' WHEN {X['beginner']('whole')} AND NOT {REPRO} THEN 'beginner-support'
  WHEN {X['one_install']('whole')} OR ({X['install']('whole')} AND NOT {X['install_context']('whole')} AND family = 'github-issues') THEN 'one-user-install' WHEN family = 'hn' AND {X['opinion']('title')} AND NOT {REPRO} THEN 'generic-opinion'
  WHEN {X['banned']('title')} OR {X['claim']('title')} THEN 'unsupported-claim' WHEN (stars >= 100000 OR {X['stars']('whole')}) AND NOT {REPRO} THEN 'star-inflation' END"""


@query("c3_default_exclusions", f"WITH {TEXTS} SELECT doc_id, {EXCLUSION} AS reason FROM t")
def c3(spark, d):
    return texts(spark, d).select("doc_id", defaults.exclusion(c("title"), c("body"), c("family"), c("comments"), c("stars")).alias("reason"))


@query("c4_default_requests_and_artifacts", f"WITH {TEXTS} SELECT doc_id, {has('title', lex.FEATURE_REQUEST_TITLE)} OR {has('whole', lex.FEATURE_REQUEST)} AS request, {any_pattern('whole', lex.ARTIFACTS)} AS artifact FROM t")
def c4(spark, d):
    return texts(spark, d).select("doc_id", defaults.is_feature_request(c("title"), c("body")).alias("request"), defaults.has_artifact(c("title"), c("body")).alias("artifact"))


TOPIC = first_of("whole", lex.TOPICS, "'other'")


@query("c5_default_finding_types", f"WITH {TEXTS} SELECT doc_id, CASE WHEN {has('whole', lex.FINDING_TYPES['BACKLASH'])} THEN 'BACKLASH' WHEN {TOPIC} = 'workflow-skills' THEN 'WORKFLOW_SHIFT' WHEN {has('whole', lex.FINDING_TYPES['MIGRATION'])} THEN 'MIGRATION' WHEN {has('whole', lex.FINDING_TYPES['UNEXPECTED_USE'])} THEN 'UNEXPECTED_USE' ELSE 'FRICTION' END AS finding_type FROM t")
def c5(spark, d):
    rows = texts(spark, d).withColumn("topic", defaults.topic(c("title"), c("body")))
    return rows.select("doc_id", defaults.finding_type(c("topic"), c("title"), c("body")).alias("finding_type"))


P = lex.PAPERS
CAPTURE = f"({has('whole', P['ai_context'])} AND (len({all_of('whole', lex.TAXONOMY)}) > 0 OR (family = 'hn' AND {has('whole', P['hci_words'])})))"


@query("c6_default_capture", f"WITH {TEXTS} SELECT doc_id, {CAPTURE} AS captured, CASE WHEN {CAPTURE} THEN NULL WHEN len({all_of('whole', lex.BACKGROUND)}) > 0 THEN 'background-only' ELSE 'taxonomy-mismatch' END AS reason FROM t")
def c6(spark, d):
    captured, reason = defaults.capture(c("title"), c("body"), c("family") == "hn")
    return texts(spark, d).select("doc_id", captured.alias("captured"), reason.alias("reason"))


L = lex.LAUNCH_CUES
SAID = "(title || ' ' || body)"


@query("c9_default_launches", f"WITH {TEXTS} SELECT doc_id, CASE WHEN {has(SAID, L['excluded'])} THEN 'excluded' WHEN {has(SAID, L['minor'])} THEN 'minor' WHEN NOT {has(SAID, L['release'])} THEN 'no-release' WHEN family <> 'hn' AND NOT {has(SAID, L['availability'])} THEN 'no-evidence' END AS reason, {first_of('body', lex.EVENT_TYPES, chr(39) + 'product-launch' + chr(39))} AS event_type FROM t")
def c9(spark, d):
    product = F.when(c("family") == "hn", "known")
    return texts(spark, d).select("doc_id", defaults.launch_reason(c("title"), c("body"), product, F.lit(None).cast("string")).alias("reason"), defaults.event_type(c("body")).alias("event_type"))


PAPER_FLAGS = f"""f AS (SELECT doc_id, {has('whole', P['theory'])} AND NOT {has('whole', P['users'])} AS theory, {has('whole', P['infra'])} AS infra, {has('title', P['benchmark_title'])} OR {has('body', P['benchmark'])} OR {has('whole', P['small_model'])} AS incremental,
  {first_of('whole', lex.EXPERIENCE_CUES, 'NULL')} AS cue, {has('whole', P['implication'])} AND NOT {has('whole', P['researchers_only'])} AS implication FROM t),
g AS (SELECT *, CASE WHEN theory THEN 'r1-theory' WHEN infra AND cue IS NULL THEN 'r2-infra' WHEN incremental AND cue IS NULL THEN 'r3-incremental' WHEN cue IS NULL OR NOT implication THEN 'r6-else' END AS reason FROM f)"""


@query("c10_default_papers", f"WITH {TEXTS}, {PAPER_FLAGS} SELECT doc_id, reason IS NULL AS publish, reason, CASE WHEN reason IS NULL OR reason = 'r6-else' THEN cue END AS cue FROM g")
def c10(spark, d):
    return defaults.gate_papers(texts(spark, d), "title", "body").select("doc_id", "publish", "reason", "cue")


@query("p12_default_source_weights", "SELECT source, CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lex.SOURCE_WEIGHTS.items()) + " ELSE 5.0 END::DOUBLE AS weight, count(*) AS n FROM documents GROUP BY source")
def p12(spark, d):
    return views.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", defaults.source_weight(c("source")).alias("weight"), "n")
