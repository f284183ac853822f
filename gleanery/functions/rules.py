"""Rule tables: ordered patterns that label a text, and cascades that give a reason."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \b is Unicode-aware; the rules mean ASCII words.
WORD_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


@dataclass(frozen=True)
class Rule:
    """``label`` applies where ``pattern`` is found, in any case."""

    label: str
    pattern: str


def _words(part: str, last: bool) -> bool:
    """Whether all alternatives of a plain group start (or end) with an ASCII word character."""
    return all(re.fullmatch(r"[A-Za-z0-9_]", a[-1 if last else 0] if a else "") for a in part.split("|"))


def ascii_edges(pattern: str) -> str:
    """The pattern with each word edge as one look-around, where what stands beside it tells the side of the word."""
    pattern = re.sub(r"\\b(?=[A-Za-z0-9_](?![?*{]))", "(?<![A-Za-z0-9_])", pattern)
    pattern = re.sub(r"\\b(?=\((?:\?:)?([\w |'-]+)\))", lambda m: "(?<![A-Za-z0-9_])" if _words(m[1], False) else m[0], pattern)
    pattern = re.sub(r"(?<=[A-Za-z0-9_])(?<!\\[A-Za-z])\\b", "(?![A-Za-z0-9_])", pattern)
    pattern = re.sub(r"(\((?:\?:)?([\w |'-]+)\))\\b", lambda m: m[1] + "(?![A-Za-z0-9_])" if _words(m[2], True) else m[0], pattern)
    return pattern.replace(r"\b", WORD_EDGE)


def branches(pattern: str) -> list[str]:
    """The alternatives of a pattern at its top."""
    out, depth = [""], 0
    for token in re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|.", pattern, re.S):
        depth += (token == "(") - (token == ")")
        if token == "|" and not depth:
            out.append("")
        else:
            out[-1] += token
    return out


def first_letters(pattern: str) -> set[str] | None:
    """The letters of which one begins each match, lower-cased; None if a match may begin otherwise."""
    out: set[str] = set()
    for branch in branches(pattern):
        branch = branch.removeprefix(r"\b")
        if group := re.match(r"\((?:\?:)?(?!\?)", branch):
            ends = (n for n in range(group.end(), len(branch)) if branch[n] == ")" and len(branches(branch[: n + 1] + "|")) == 2)
            end = next(ends)
            inner = None if branch[end + 1 : end + 2] in ("?", "*", "{") else first_letters(branch[group.end() : end])
            if inner is None:
                return None
            out |= inner
        elif re.match(r"[A-Za-z](?![?*{])", branch):
            out.add(branch[0].lower())
        else:
            return None
    return out


def quick(pattern: str) -> str:
    """The pattern with ASCII word edges, tried only where a letter stands that may begin a match."""
    letters = first_letters(pattern)
    edged = ascii_edges(pattern)
    return f"(?=[{''.join(sorted(letters))}])(?:{edged})" if letters else edged


def found(text: Column, pattern: str) -> Column:
    """Whether a pattern with ASCII word edges occurs in a text, in any case; null is false."""
    return F.coalesce(text.rlike("(?i)" + quick(pattern)), F.lit(False))


def classify_first(text: Column, rules: Sequence[Rule], default: str = "other") -> Column:
    """The label of the first rule that applies."""
    out = F
    for rule in rules:
        out = out.when(found(text, rule.pattern), rule.label)
    return out.otherwise(default) if rules else F.lit(default)


def classify_all(text: Column, rules: Sequence[Rule]) -> Column:
    """The labels of all rules that apply, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(found(text, r.pattern), r.label) for r in rules]))


def cascade(*steps: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds, else null."""
    return F.coalesce(*[F.when(condition, reason) for condition, reason in steps])


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether any word is a substring of the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words are substrings of the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)))
