"""Expressions on literals, edge cases included."""

from pyspark.sql import functions as F

from gleanery.functions import rules, scoring, text, urls
from gleanery.functions.rules import Rule
from gleanery.sources import html


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_urls(spark):
    url = F.lit("https://WWW.Example.com//a//b/?utm_source=x&b=2&a=1&ref=q#Frag")
    assert one(spark, urls.canonical_url(url)) == "https://example.com/a/b?a=1&b=2"
    assert one(spark, urls.identity_url(url)) == "https://example.com/a/b?a=1&b=2#frag"
    assert one(spark, urls.canonical_url(F.lit(" not a url "))) == "not a url"
    assert one(spark, urls.registrable_host(F.lit("https://m.blog.example.org/x"))) == "example.org"
    assert one(spark, urls.arxiv_id(F.lit("https://arxiv.org/abs/2504.19413v2"))) == "2504.19413"
    assert one(spark, urls.canonical_url(F.lit(None).cast("string"))) is None


def test_text(spark):
    assert one(spark, text.strip_html(F.lit("<p>a&amp;lt;  b</p>"))) == "a< b"
    assert one(spark, text.slug_id("x", F.lit("Hello, World!"))) == "x-hello-world"
    assert one(spark, text.slug_id("x", F.lit("发布"))).startswith("x-")
    assert one(spark, text.launch_title(F.lit("Introducing GPT-5's launch"))) == "gpt 5s launch"
    assert one(spark, text.reading_time(F.lit(""))) == 2
    assert one(spark, text.english_list(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b, and c"
    assert one(spark, text.clamp_score(F.lit("abc"))) is None
    assert one(spark, text.pair_key(F.lit("a"), F.lit("b"))) == one(spark, text.pair_key(F.lit("b"), F.lit("a")))


def test_word_edges_are_ascii(spark):
    assert one(spark, rules.found(F.lit("发布GPT发布"), r"\bGPT\b"))
    assert not one(spark, rules.found(F.lit("aGPT"), r"\bGPT\b"))
    assert not one(spark, rules.found(F.lit(None).cast("string"), "x"))


def test_rule_tables(spark):
    table = [Rule("a", "one"), Rule("b", "two")]
    assert one(spark, rules.classify_first(F.lit("two one"), table)) == "a"
    assert one(spark, rules.classify_first(F.lit("three"), table)) == "other"
    assert one(spark, rules.classify_all(F.lit("TWO one"), table)) == ["a", "b"]
    assert one(spark, rules.classify_first(F.lit("x"), [])) == "other"


def test_scores(spark):
    assert one(spark, scoring.composite(F.lit(80), F.lit(70), F.lit(60))) == 72
    assert one(spark, scoring.tier(F.lit(82), F.lit(0), F.lit(0))) == "High Impact"
    assert one(spark, scoring.duration_label(F.lit("PT1H2M3S"))) == "1:02:03"
    assert one(spark, scoring.duration_label(F.lit("x"))) is None
    assert one(spark, scoring.short_count(F.lit(1250))) == "1.2k"


def test_release_notes():
    notes = "## August 2026\n### Aug 3\n- First thing here.\n- Second thing here.\n## 2026-02-30\n- never\n"
    assert [e[:2] for e in html.note_entries(notes, "bullets")] == [("2026-08-03", "First thing here."), ("2026-08-03", "Second thing here.")]
    page = "<h2>March 5, 2026</h2><h3>New model</h3><p>It is <b>fast</b>.</p><h3>Other entry</h3><p>x</p>"
    assert list(html.note_entries(page, "html")) == [("2026-03-05", "New model", "It is fast ."), ("2026-03-05", "Other entry", "x")]


def test_page_parsers_survive_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "https://a.com/x", "")], "page_id long, url string, html string")
    assert html.release_notes(pages, "page_id", "html", "html").count() == 0
    assert html.listed_links(pages, "page_id", "url", "html", "/", 3).count() == 0


def test_ascii_edges_say_what_word_edges_say():
    import random
    import re

    from gleanery.functions import lexicons as lex
    from gleanery.functions.rules import Rule, ascii_edges

    patterns = [r"\bidiot\b", r"\b(they|une)\b", r"bench|\bof\b", r"\ba?b", r"x\d\b", r"\b(a|-b)\b", r"\b(?:ab |c)\b", r"(ab|c)?\b"]
    for value in vars(lex).values():
        rows = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
        patterns += [r.pattern if isinstance(r, Rule) else r for r in rows if isinstance(r, Rule) or (isinstance(r, str) and "\\b" in r)]
    rng = random.Random(41)
    words = sorted({w for p in patterns for w in re.findall(r"[A-Za-z]+", p)}) + ["é", "1", "_", "-", ".", " ", "ab", "of", "x"]
    assert len(patterns) > 60
    for p in patterns:
        own, plain = re.compile("(?i)" + ascii_edges(p), re.ASCII), re.compile("(?i)" + p, re.ASCII)
        for _ in range(60):
            t = "".join(rng.choice(words) + rng.choice(["", " ", "é", "-"]) for _ in range(8))
            assert bool(own.search(t)) == bool(plain.search(t)), (p, t)


def test_references_end_in_a_semicolon(spark):
    from gleanery.functions.entities import decode

    cases = {"Ly &amp;&amp;&amp": "Ly &&&amp", "&amp;lt;": "&lt;", "&lt &gt;": "&lt >", "&notit; &nosuch;": "&notit; &nosuch;", "&#39;&#x41;&eacute;&#65": "'Aé&#65", "a & b": "a & b"}
    rows = spark.createDataFrame(list(cases.items()), "raw string, want string").select("want", decode(F.col("raw")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_quick_patterns_find_the_same(spark):
    import random
    import re

    from gleanery.functions import lexicons as lex

    rng = random.Random(3)
    patterns = [r.pattern for r in [*lex.TOPICS, *lex.PRODUCTS]] + list(lex.FINDING_TYPES.values()) + list(lex.EXCLUSIONS.values()) + [r"(a|bc)?d", r"^x", r"a?b", r"(?=q)q", r"[ab]c", r"x|\b(y|(z|w)v)", r"a|"]
    words = [w for p in patterns for w in re.findall(r"[A-Za-z]+|[^A-Za-z]", p)] + ["the", " "]
    for p in patterns:
        own, plain = re.compile("(?i)" + rules.quick(p), re.ASCII), re.compile("(?i)" + rules.ascii_edges(p), re.ASCII)
        for _ in range(80):
            t = "".join(rng.choice(words) + rng.choice(["", " ", "é", "-"]) for _ in range(6))
            assert bool(own.search(t)) == bool(plain.search(t)), (p, t)
    assert rules.first_letters(r"x|\b(y|(z|w)v)") == {"x", "y", "z", "w"}
    assert all(rules.quick(r.pattern).startswith("(?=[") for r in lex.TOPICS)


def test_rebuilt_texts_are_not_shuffled(spark):
    from gleanery.plans import catalog

    for name in ("p15_rebuild_text", "s11_works_with_abstract"):
        assert "Exchange" not in catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    words = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,)], "w array<string>").select(text.inverted(F.col("w")).alias("m")).collect()
    assert [r["m"] for r in words] == [{"b": [0, 2], "a": [1]}, {}, None]
