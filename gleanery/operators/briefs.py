"""Headlines and briefs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.rules import ascii_edges
from gleanery.functions.text import spaced, squeeze, upper_letter, upper_word


def repeats(earlier: Column, field: Column, least: int = 24) -> Column:
    """Whether a field says what an earlier one says: equal, or one holds the other and that is long enough."""
    a, b = spaced(earlier), spaced(field)
    return (a == b) | ((F.length(a) >= least) & F.contains(b, a)) | ((F.length(b) >= least) & F.contains(a, b))


def headline(title: Column, summary: Column, boilerplate: str, short: int = 22, most: int = 110) -> Column:
    """The title without boilerplate; one that is too short gives way to the summary's first sentence."""
    t = F.trim(F.regexp_replace(title, boilerplate, ""))
    first = F.get(F.split(squeeze(summary), r"(?<=[.!?]) "), F.lit(0))
    return F.when((F.length(t) < short) & (F.length(first) > F.length(t)), F.substring(first, 1, most)).otherwise(F.substring(squeeze(t), 1, most))


# What marks a title as a version, as vague, or as framed by boilerplate; words that are written in capitals; set phrases.
VERSION_TAG = r"(?i)^v?\d+(\.\d+){1,3}([-._a-z0-9]*)?$"
VAGUE_TITLE = r"(?i)^(release notes?|changelog|update|news|blog|readme)$"
TITLE_ENDS = r"(?i)\s*[|–—-]\s*(Official Blog|Blog|Newsroom|News)\s*$"
TITLE_STARTS = r"(?i)^(Release notes from|Release:)\s+"
NO_SUMMARY = r"(?i)^(discussion\s*\|\s*link|read more|comments?|share)\b"
CAPITALS = ("ai", "llm", "gpt", "ml", "nlp", "rag", "ui", "api", "sdk", "vl")
NEW_MODEL = " ships a new model release"
QUIET_PROJECT = ": notable open-source AI project trending on GitHub"
ACTIVE_PROJECT = " sees fresh activity on GitHub"
NAMES_ITSELF = r"(?i)^(the|a|an|building|open|new)"
GENERIC_START = r"(?i)^(a|an|the)\s+(library|toolkit|framework|tool)\b"
HAN = "[\u4e00-\u9fff]"


def first_clause(text: Column, most: int) -> Column:
    """The text up to its first end mark if that lies 24 to ``most`` characters in; a longer text cut at a word, with an ellipsis; no dots at the end."""
    mark = F.length(F.regexp_extract(text, r"^[^.!?]*", 0))
    cut = F.concat(F.rtrim(F.regexp_replace(F.substring(text, 1, most - 1), r"\s+\S*$", "")), F.lit("…"))
    core = F.when((mark < F.length(text)) & mark.between(24, most), text.substr(F.lit(1), mark)).when(F.length(text) > most, cut).otherwise(text)
    return F.trim(F.regexp_replace(core, r"[.]+$", ""))


def capitalised(text: Column) -> Column:
    t = squeeze(text)
    return F.when(t == "", "AI update").otherwise(F.concat(upper_letter(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t))))


def humanised(slug: Column) -> Column:
    """A repository's name in words."""
    spaced_out = squeeze(F.regexp_replace(F.regexp_replace(slug, "([a-z0-9])([A-Z])", "$1 $2"), "[-_]+", " "))
    word = lambda w: F.when(F.lower(w).isin(*CAPITALS) | (F.length(w) <= 2), upper_word(w)).otherwise(F.concat(upper_letter(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.array_join(F.transform(F.split(spaced_out, " "), word), " ")


def with_headlines(rows: DataFrame, exempt: str, name: str = "headline") -> DataFrame:
    """Rows with title, summary, source and repo get a headline that can be read alone.

    Repositories are described, led by their name in words where the
    description does not say it.  A bare version gives way to the summary.
    Boilerplate goes; a short or vague title gives way to the summary's first
    clause if that says more, except of the source ``exempt``, and in Chinese from eight characters on.
    Each step is a projection, so that no text is worked on twice.
    """
    c = F.col
    steps = rows.withColumns({"_raw": squeeze(c("title")), "_about": squeeze(F.coalesce("summary", F.lit(""))), "_repo": F.nullif(F.trim("repo"), F.lit(""))})
    slug = F.element_at(F.split("_repo", "/"), -1)
    plain = F.trim(F.regexp_replace(F.regexp_replace("_raw", TITLE_ENDS, ""), TITLE_STARTS, ""))
    tag = c("_raw").rlike(VERSION_TAG)
    said = F.when(c("_about") != "", c("_about")).when(~tag, c("_raw")).otherwise("")
    steps = steps.withColumns({"_clause": first_clause(c("_about"), 110), "_plain": plain, "_tag": tag, "_said": said, "_slug": slug, "_project": humanised(slug)})
    dense = c("_plain").rlike(HAN) & (F.length("_plain") >= 8)
    weak = (c("source") != exempt) & ~dense & ((F.length("_plain") < 28) | c("_plain").rlike(VAGUE_TITLE))
    better = weak & (c("_clause") != "") & (F.length("_clause") > F.length("_plain")) & ~c("_clause").rlike(ascii_edges(NO_SUMMARY))
    steps = steps.withColumns({"_chosen": F.when(better, c("_clause")).otherwise(c("_plain")), "_core": first_clause(c("_said"), 100)})
    low = F.lower("_core")
    steps = steps.withColumns({"_short": first_clause(c("_chosen"), 118), "_same": low.isin(F.lower("_slug"), F.lower("_repo"), F.lower("_project"))})
    of_repo = (
        F.when((c("_core") == "") | c("_said").rlike(VERSION_TAG), F.concat("_project", F.lit(QUIET_PROJECT)))
        .when(c("_same"), F.concat("_project", F.lit(ACTIVE_PROJECT)))
        .when((F.length("_core") < 48) & ~c("_core").rlike(NAMES_ITSELF), F.concat("_project", F.lit(" — "), "_core"))
        .when(c("_core").rlike(ascii_edges(GENERIC_START)), F.concat("_project", F.lit(": "), "_core"))
        .otherwise(c("_core"))
    )
    of_version = F.when((c("_clause") != "") & ~c("_clause").rlike(VERSION_TAG), F.concat("source", F.lit(": "), "_clause")).otherwise(F.concat("source", F.lit(NEW_MODEL)))
    of_title = F.when(c("_short") == "", c("_chosen")).otherwise(c("_short"))
    steps = steps.withColumn(name, F.when(c("_repo").isNotNull(), of_repo).when(c("_tag"), of_version).otherwise(of_title))
    fixed = c("_repo").isNotNull() & (c(name).endswith(QUIET_PROJECT) | c(name).endswith(ACTIVE_PROJECT))
    steps = steps.withColumn(name, F.when(fixed, c(name)).otherwise(capitalised(c(name))))
    return steps.drop("_raw", "_about", "_repo", "_clause", "_plain", "_tag", "_said", "_slug", "_project", "_chosen", "_core", "_short", "_same")


# Set phrases that say nothing on a page.
EVIDENCE_PHRASE = r"(?i)\s*[0-9]+\s+independent authors across\s+[0-9]+\s+evidence records[.]?"
EMPTY_WHY = r"(?i)ingested from a trusted source feed|structured triage template"
EMPTY_TAKE = r"(?i)skim the source, then decide"


def shown(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, r"(?i)https?://\S+", " "))


def presented(briefs: DataFrame) -> DataFrame:
    """The four fields of a brief as shown: without URLs and set phrases; a field that repeats one before it is blank."""
    c = F.col
    key = lambda t: F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9\u4e00-\u9fff]+", " "))

    def same(a: Column, b: Column) -> Column:
        x, y = key(a), key(b)
        return (x != "") & (y != "") & ((x == y) | ((F.length(x) >= 24) & F.contains(y, x)) | ((F.length(y) >= 24) & F.contains(x, y)))

    fields = ("what_happened", "why_it_matters", "potential_impact", "key_takeaway")
    rows = briefs.withColumns({"_what": c(fields[0]), **{f: shown(c(f)) for f in fields[1:]}, fields[0]: shown(F.regexp_replace(c(fields[0]), EVIDENCE_PHRASE, " "))})
    rows = rows.withColumns({fields[1]: F.when(c(fields[1]).rlike(EMPTY_WHY), "").otherwise(c(fields[1])), fields[3]: F.when(c(fields[3]).rlike(EMPTY_TAKE), "").otherwise(c(fields[3]))})
    for k in (1, 2, 3):
        repeated = reduce(lambda a, b: a | b, [same(c(fields[k]), c(f)) for f in fields[:k]])
        rows = rows.withColumn(fields[k], F.when(repeated, "").otherwise(c(fields[k])))
    return rows.withColumn(fields[0], F.when(c(fields[0]) == "", shown(c("_what"))).otherwise(c(fields[0]))).drop("_what")


def paper_brief(finding: Column, cue: Column, maturity: Column, why: dict[str, str], impact: dict[str, str], otherwise: tuple[str, str]) -> dict[str, Column]:
    """The brief of a paper by its cue; ``why`` and ``impact`` name a sentence for each cue."""
    look = lambda table, default: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), cue), F.lit(default))
    end = F.concat(F.lit(" ("), maturity, F.lit(")."))
    take = F.when(cue.isNotNull(), F.concat(cue, F.lit(": "), F.substring(finding, 1, 140), end)).otherwise(F.concat(F.substring(finding, 1, 160), end))
    return {"what_happened": finding, "why_it_matters": look(why, otherwise[0]), "potential_impact": look(impact, otherwise[1]), "key_takeaway": take}


def community_brief(title: Column, n_authors: Column, n_evidence: Column, kind: Column, days: Column, product: Column, urls: Column, impact: str) -> dict[str, Column]:
    """The brief of a community finding with its counts and up to three of its sources."""
    text = lambda v: v.cast("string")
    take = F.concat(F.lit("Test or watch "), F.coalesce(F.nullif(product, F.lit("")), F.lit("this stack")), F.lit(" against the retained evidence: "), F.array_join(F.slice(urls, 1, 3), " "))
    return {
        "what_happened": F.concat(title, F.lit(" "), text(n_authors), F.lit(" independent authors across "), text(n_evidence), F.lit(" evidence records.")),
        "why_it_matters": F.concat(F.lit("This is a recurring "), F.lower(F.replace(kind, F.lit("_"), F.lit(" "))), F.lit(" pattern over "), text(days), F.lit(" day(s), not a single complaint.")),
        "potential_impact": F.lit(impact),
        "key_takeaway": F.substring(take, 1, 320),
    }
