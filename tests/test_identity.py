"""Organisations, topics, families and labels by role; release notes from SQL."""

import pytest
from pyspark.sql import functions as F

from gleanery.operators import identity
from gleanery.sources import notes

FIELDS = "role string, id string, source string, author string, tags array<string>, paper string, title string, summary string, model string, product string, cue string"


def one(spark, column, **given):
    row = dict.fromkeys(["role", "id", "source", "author", "tags", "paper", "title", "summary", "model", "product", "cue"]) | {"id": "I1", "source": "Src"} | given
    return spark.createDataFrame([row], FIELDS).select(column.alias("x")).first()["x"]


def who():
    return identity.organization(*map(F.col, ("role", "id", "source", "author", "tags", "paper")))


def what():
    return identity.topic(*map(F.col, ("role", "title", "summary", "author", "tags", "model", "product", "cue")))


@pytest.mark.parametrize(
    "given, want",
    [
        ({"role": "SUPPLY", "author": "Ann"}, "Src"),
        ({"role": "BACKGROUND"}, "Src"),
        ({"role": "ADOPTION", "author": "Cline, Roo"}, "cline"),
        ({"role": "ADOPTION", "author": " , Roo", "tags": ["live", "evidence:4", "friction", "OpenThing"]}, "openthing"),
        ({"role": "ADOPTION", "tags": ["live"]}, "community"),
        ({"role": "ADOPTION"}, "community"),
        ({"role": "CAPABILITY", "paper": "2401.1v1", "author": "Bo"}, "2401.1v1"),
        ({"role": "CAPABILITY", "paper": "", "author": "Bo B., C"}, "bo b."),
        ({"role": "CAPABILITY"}, "i1"),
    ],
)
def test_organizations(spark, given, want):
    assert one(spark, who(), **given) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ({"role": "SUPPLY", "model": "Big Model 4.5", "title": "Kimi"}, "big-model-4-5"),
        ({"role": "SUPPLY", "model": "", "product": "Tool+"}, "tool-"),
        ({"role": "SUPPLY", "title": "GPT-5 and Gemini"}, "gpt-5"),
        ({"role": "SUPPLY", "title": "A geminid shower"}, "launch"),
        ({"role": "ADOPTION", "tags": ["install-platform", "tool-calling"], "title": "MCP"}, "tool-calling"),
        ({"role": "ADOPTION", "title": "MCP session"}, "mcp"),
        ({"role": "ADOPTION", "title": "Tool calls fail"}, "tool-calling"),
        ({"role": "ADOPTION", "title": "reinstall it"}, "adoption"),
        ({"role": "CAPABILITY", "title": "Voice", "summary": "with a video"}, "video"),
        ({"role": "CAPABILITY", "title": "agents", "cue": "Agent UX"}, "agent ux"),
        ({"role": "BACKGROUND"}, "paper"),
    ],
)
def test_topics_by_role(spark, given, want):
    assert one(spark, what(), **given) == want


def test_keys_and_families(spark):
    text = F.lit(None).cast("string")
    key = lambda *v: spark.range(1).select(identity.organization_key(*[text if x is None else F.lit(x) for x in v]).alias("x")).first()["x"]
    assert key(None, "", "Foo & Bar!") == "foo-bar"
    assert key("A.B", "C", "D") == "a-b"
    assert key(None, None, None) == "unknown"
    family = lambda role, products, title: spark.range(1).select(identity.product_family(F.lit(role), products, F.lit(title), F.lit("org")).alias("x")).first()["x"]
    some = F.array(F.lit("unknown"), F.lit(None).cast("string"), F.lit("Tool"))
    none = F.lit(None).cast("array<string>")
    assert family("ADOPTION", some, "x: y") == "tool"
    assert family("ADOPTION", none, "Cline-2: it fails") == "cline-2"
    assert family("ADOPTION", none, "no prefix: here") == "org"
    assert family("SUPPLY", some, "x: y") == "org"


def test_labels(spark):
    codes = spark.createDataFrame([("SUPPLY", "capped", "xAI"), ("CAPABILITY", "duplicate", "arXiv"), ("ADOPTION", "r1-theory", "YouTube"), (None, None, None)], "role string, reason string, source string")
    got = codes.select(identity.value_cue(F.col("role")), identity.evidence_role(F.col("role")), identity.reason_status(F.col("reason")), identity.source_group(F.col("source"))).collect()
    assert [tuple(r) for r in got] == [
        ("High Impact", "Launch", "capped", "labs"), ("New Capability", "Research", "duplicate", "research"),
        ("Developer Signal", "In the wild", "rejected", "community"), (None, "In the wild", "rejected", "community"),
    ]


def test_release_notes_from_sql(spark):
    notes.register(spark)
    page = "<h2>2024-01-05</h2><h3>First entry</h3><p>a</p><h3>Tiny</h3><h3>Second entry</h3>"
    many = "## March 2, 2024\n" + "\n".join(f"- Entry number {k} here" for k in range(14))
    pages = spark.createDataFrame([(1, page, "html"), (2, None, "html"), (3, "", "bullets"), (4, many, "bullets"), (5, "<h3>No date</h3>", "html")], "n int, body string, kind string")
    got = spark.sql("SELECT n, e.pos, e.day, e.title FROM {p}, LATERAL release_notes(body, kind) e ORDER BY n, pos", p=pages).collect()
    assert [tuple(r) for r in got if r["n"] < 4] == [(1, 0, "2024-01-05", "First entry"), (1, 1, "2024-01-05", "Second entry")]
    assert [r["pos"] for r in got if r["n"] == 4] == list(range(10))
    assert not [r for r in got if r["n"] == 5]
    first = spark.sql("SELECT n, e.title FROM {p}, LATERAL release_notes(body, kind, 1) e", p=pages).collect()
    assert sorted(r["n"] for r in first) == [1, 4]
