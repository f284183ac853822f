"""Scores of feed items, from keyword, source, engagement and freshness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.rules import found, hits
from gleanery.functions.text import rounded

# Words that make a text relevant.
KEYWORDS = (
    "ai", "llm", "gpt", "claude", "gemini", "openai", "anthropic", "deepmind", "deepseek", "kimi", "moonshot", "bytedance", "doubao", "seed", "qwen", "flux", "embodied", "robotics", "humanoid", "agent", "model",
    "neural", "transformer", "diffusion", "machine learning", "deep learning", "generative", "chatbot", "copilot", "multimodal", "foundation model", "reasoning",
)


def hours_ago(ts: Column, as_of: Column) -> Column:
    """P10: hours before ``as_of``, 0 for later times."""
    return F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(ts)) / 3.6e9)


def freshness(age: Column) -> Column:
    """P10: points by age in hours."""
    return F.when(age < 12, 18).when(age < 48, 12).when(age < 168, 6).otherwise(2)


def lookup(key: Column, table: Mapping[str, float], default: float) -> Column:
    """A small table as a map literal."""
    if not table:
        return F.lit(default)
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def live_scores(text: Column, source: Column, ts: Column, as_of: Column, weights: Mapping[str, float], keywords: Sequence[str] = KEYWORDS, extra_trend: Column | None = None, default_weight: float = 5.0) -> Column:
    """Struct impact, relevance, trend: capped sums, halves rounded up."""
    n, weight, fresh = hits(text, keywords), lookup(source, weights, default_weight), freshness(hours_ago(ts, as_of))
    relevance = F.least(F.lit(98.0), 55 + n * 6 + weight)
    impact = F.least(F.lit(97.0), 48 + weight + F.least(F.lit(20), n * 4) + fresh / 2)
    trend = F.least(F.lit(98.0), 40 + fresh * 2 + (extra_trend if extra_trend is not None else F.lit(0)) + F.least(F.lit(15), n * 3))
    return F.struct(rounded(impact).cast("int").alias("impact"), rounded(relevance).cast("int").alias("relevance"), rounded(trend).cast("int").alias("trend"))


def hundredths(impact: Column, relevance: Column, trend: Column) -> Column:
    """The composite times 100, as a whole number: 45, 30 and 25 parts."""
    return (impact * 45 + relevance * 30 + trend * 25).cast("long")


def composite(impact: Column, relevance: Column, trend: Column) -> Column:
    """The weighted mean, halves up."""
    return F.floor((hundredths(impact, relevance, trend) + 50) / 100).cast("int")


def tier(impact: Column, relevance: Column, trend: Column) -> Column:
    """High Impact, Trending or Emerging."""
    c = hundredths(impact, relevance, trend)
    return F.when((c >= 7800) | (impact >= 82), "High Impact").when((c >= 6800) | (trend >= 75), "Trending").otherwise("Emerging")


def star_boost(stars: Column) -> Column:
    """Logarithm of stars, 45 at most."""
    return F.least(F.lit(45.0), F.log10(stars + 1) * 12)


def view_boost(views: Column) -> Column:
    """Logarithm of views, 20 at most, 8 if there are none."""
    return F.when(F.coalesce(views, F.lit(0)) > 0, F.least(F.lit(20.0), F.log10(views) * 3)).otherwise(8.0)


def short_count(n: Column) -> Column:
    """950, 1.2k."""
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", F.floor(n / 100) / 10), F.lit("k"))).otherwise(n.cast("string"))


def duration_label(iso: Column) -> Column:
    """``PT1H2M3S`` as 1:02:03, ``PT4M5S`` as 4:05; null if it is no duration."""
    part = lambda u: F.coalesce(F.nullif(F.regexp_extract(iso, rf"(\d+){u}", 1), F.lit("")).cast("int"), F.lit(0))
    h, m, s = part("H"), part("M"), part("S")
    label = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))
    return F.when(iso.rlike(r"^PT(\d+H)?(\d+M)?(\d+S)?$") & (iso != "PT"), label)


def release_priority(title: Column, text: Column, is_release: Column, is_lab: Column, release: str, model: str, brands: str, opening: str) -> Column:
    """Additive weights of release and model wording; the patterns are parameters."""
    r, m = found(text, release), found(text, model)
    wording = F.when(r & m, 90).when(r & is_lab, 55).when(m & is_lab, 25).when(r, 15).otherwise(0)
    return F.when(is_release, 100).otherwise(0) + F.when(is_lab, 50).otherwise(0) + wording + F.when(found(title, opening), 35).otherwise(0) + F.when(found(title, brands) & r, 25).otherwise(0)


def quality(base: Column, tier_: Column, is_release: Column, title: Column, stars: Column, age: Column) -> Column:
    """Composite with bonuses for tier, release, engagement and headline, and penalties."""
    q = base + F.when(tier_ == "High Impact", 28).when(tier_ == "Trending", 14).otherwise(0) + F.when(is_release, 22).otherwise(0)
    q = q + F.when(stars > 0, F.least(F.lit(35.0), F.log10(stars + 1) * 12)).otherwise(0.0)
    n = F.length(title)
    q = q + F.when((n >= 40) & (n <= 110), 6).otherwise(0) - F.when(n < 22, 10).otherwise(0) - F.when(title.rlike(r"^\s*v?\d+\.\d+"), 20).otherwise(0)
    return q + F.when(age < 48, 10).when(age > 720, -8).otherwise(0)
