"""The classifiers and gates with their default rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import lexicons as lex
from gleanery.functions.rules import cascade, classify_all, classify_first, found
from gleanery.functions.scoring import lookup
from gleanery.operators.papers import paper_gate, taxonomy_capture


def body_of(title: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))


def topic(title: Column, body: Column) -> Column:
    """The topic of an issue or story."""
    return classify_first(body_of(title, body), lex.TOPICS)


def product(repository: Column, title: Column, body: Column) -> Column:
    """The product of a known repository, else the one that the text names."""
    pairs = F.create_map(*[F.lit(x) for kv in lex.REPOSITORY_PRODUCTS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(repository, F.lit(""))), classify_first(body_of(title, body), lex.PRODUCTS, "unknown"))


def finding_type(topic: Column, title: Column, body: Column) -> Column:
    """Backlash, workflow shift, migration or unexpected use, in this order; friction otherwise."""
    text, p = body_of(title, body), lex.FINDING_TYPES
    return F.when(found(text, p["BACKLASH"]), "BACKLASH").when(topic == "workflow-skills", "WORKFLOW_SHIFT").when(found(text, p["MIGRATION"]), "MIGRATION").when(found(text, p["UNEXPECTED_USE"]), "UNEXPECTED_USE").otherwise("FRICTION")


def exclusion(title: Column, body: Column, family: Column, comments: Column, stars: Column) -> Column:
    """Why a piece of evidence is left out, null if it is not; a concrete repro overrides most reasons."""
    text, p = body_of(title, body), lex.EXCLUSIONS
    none = lambda n: F.coalesce(n, F.lit(0))
    repro = ~found(text, p["no_repro"]) & found(text, p["repro"])
    story, issue = F.coalesce(family == "hn", F.lit(False)), F.coalesce(family == "github-issues", F.lit(False))
    return cascade(
        (found(text, p["spam"]) | (none(comments) >= 200), "agent-spam"),
        (story & found(F.trim(title), p["show"]), "show-hn-no-adoption"),
        (found(title, p["job"]), "job-post"),
        (found(text, p["benchmark"]) & ~repro, "benchmark-argument"),
        (found(text, p["repost"]) & ~repro, "official-launch-repost"),
        (found(text, p["media"]) & story, "media-repost"),
        (found(text, p["beginner"]) & ~repro, "beginner-support"),
        (found(text, p["one_install"]) | (found(text, p["install"]) & ~found(text, p["install_context"]) & issue), "one-user-install"),
        (story & found(title, p["opinion"]) & ~repro, "generic-opinion"),
        (found(title, p["banned"]) | found(title, p["claim"]), "unsupported-claim"),
        (((none(stars) >= 100_000) | found(text, p["stars"])) & ~repro, "star-inflation"),
    )


def has_artifact(title: Column, body: Column) -> Column:
    """Whether a text shows something concrete."""
    text = body_of(title, body)
    out = F.lit(False)
    for pattern in lex.ARTIFACTS:
        out = out | found(text, pattern)
    return out


def is_feature_request(title: Column, body: Column) -> Column:
    """C4: whether a text asks for something new."""
    return found(title, lex.FEATURE_REQUEST_TITLE) | found(body_of(title, body), lex.FEATURE_REQUEST)


def capability_keys(text: Column) -> Column:
    """The capability keys of a text."""
    return classify_all(F.trim(text), lex.CAPABILITIES)


def gate_papers(papers: DataFrame, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """The paper gate with its default cues."""
    t, a, p = F.col(title), F.col(abstract), lex.PAPERS
    text = body_of(t, a)
    cue = F.nullif(classify_first(text, lex.EXPERIENCE_CUES, ""), F.lit(""))
    incremental = found(t, p["benchmark_title"]) | found(a, p["benchmark"]) | found(text, p["small_model"])
    return paper_gate(papers, found(text, p["theory"]), found(text, p["users"]), found(text, p["infra"]), incremental, cue, found(text, p["implication"]) & ~found(text, p["researchers_only"]))


def capture(title: Column, abstract: Column, hci_venue: Column) -> tuple[Column, Column]:
    """Whether a venue's paper is captured, and if not, why."""
    text, p = body_of(title, abstract), lex.PAPERS
    facing, background = (F.size(classify_all(text, rules)) > 0 for rules in (lex.TAXONOMY, lex.BACKGROUND))
    return taxonomy_capture(facing, background, found(text, p["ai_context"]), hci_venue & found(text, p["hci_words"]))


def launch_reason(title: Column, summary: Column, product: Column, model: Column) -> Column:
    """Why a record is no launch, null if it is one."""
    text, p = F.concat_ws(" ", title, summary), lex.LAUNCH_CUES
    known = product.isNotNull() | model.isNotNull()
    return cascade((found(text, p["excluded"]), "excluded"), (found(text, p["minor"]), "minor"), (~found(text, p["release"]), "no-release"), (~known & ~found(text, p["availability"]), "no-evidence"))


def event_type(text: Column) -> Column:
    """The kind of event that a text tells of."""
    return classify_first(text, lex.EVENT_TYPES, "product-launch")


def source_weight(source: Column) -> Column:
    """The weight of a source, 5 if it is not listed."""
    return lookup(source, lex.SOURCE_WEIGHTS, 5.0)
