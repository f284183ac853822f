"""The default rule tables on texts with known outcomes."""

import pytest
from pyspark.sql import functions as F

from gleanery.operators import defaults


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "title, body, want",
    [
        ("MCP-server fails to start on boot", "", "mcp-runtime"),
        ("Streamable HTTP reconnect loop", "", "reliability-transport"),
        ("Session lost after resume", "", "session-failure"),
        ("Nothing in particular", None, "other"),
    ],
)
def test_topics(spark, title, body, want):
    assert value(spark, defaults.topic(F.lit(title), F.lit(body).cast("string"))) == want


def test_products(spark):
    assert value(spark, defaults.product(F.lit("cline/cline"), F.lit("MCP"), F.lit(""))) == "cline"
    assert value(spark, defaults.product(F.lit(None).cast("string"), F.lit("the model context protocol"), F.lit(""))) == "mcp"
    assert value(spark, defaults.product(F.lit("x/y"), F.lit("z"), F.lit(""))) == "unknown"


@pytest.mark.parametrize(
    "title, family, comments, want",
    [
        ("Show HN: my tool", "hn", 0, "show-hn-no-adoption"),
        ("We're hiring", "hn", 0, "job-post"),
        ("A new benchmark", "hn", 0, "benchmark-argument"),
        ("A new benchmark with steps to reproduce", "hn", 0, None),
        ("Quiet title", "hn", 250, "agent-spam"),
        ("Cannot install it", "github-issues", 0, "one-user-install"),
        ("Cannot install the mcp server", "github-issues", 0, None),
    ],
)
def test_exclusions(spark, title, family, comments, want):
    assert value(spark, defaults.exclusion(F.lit(title), F.lit(""), F.lit(family), F.lit(comments), F.lit(None).cast("int"))) == want


def test_paper_gate(spark):
    rows = [
        (1, "Rademacher bounds", "learning theory"), (2, "Fast speculative decoding", "draft tokens"), (3, "XBench", "we propose a benchmark"), (4, "Long-term memory for agents", "multi-session use"),
        (5, "Long-term memory", "for ai scientists, multi-session"), (6, "Something else", None),
    ]
    got = {r["id"]: (r["publish"], r["reason"], r["cue"]) for r in defaults.gate_papers(spark.createDataFrame(rows, "id int, title string, abstract string")).collect()}
    assert got == {1: (False, "r1-theory", None), 2: (False, "r2-infra", None), 3: (False, "r3-incremental", None), 4: (True, None, "Agent memory"), 5: (False, "r6-else", "Agent memory"), 6: (False, "r6-else", None)}


def test_launch_reasons(spark):
    none = F.lit(None).cast("string")
    assert value(spark, defaults.launch_reason(F.lit("Join our team"), F.lit(""), none, none)) == "excluded"
    assert value(spark, defaults.launch_reason(F.lit("Introducing X"), F.lit("now available to all"), none, none)) is None
    assert value(spark, defaults.event_type(F.lit("open weights today"))) == "open-source-release"


def test_capability_keys(spark):
    assert value(spark, defaults.capability_keys(F.lit("MCP tool calling in coding agents"))) == ["tool-calling", "mcp", "coding-agent"]
    assert value(spark, defaults.source_weight(F.lit("OpenAI"))) == 14.0
