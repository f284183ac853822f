"""Hostile and odd inputs end in useful time."""

import json
import random
import re
import time

import pytest

from gleanery.llm import chat, pii


def quick(run, seconds=1.0):
    began = time.perf_counter()
    out = run()
    assert time.perf_counter() - began < seconds
    return out


@pytest.mark.parametrize("n", [10, 24, 40, 300, 10_000])
def test_digit_runs_with_a_letter_after_end(n):
    for text in ("x dot y " + "1" * n + "x", "la cosa punto final: ref " + "20240115103045" + "1" * n + "EUR", "a dot b " + "1 " * n + "one2x", "a dot b" + " " * n * 3 + "c [at]" + " " * n, "five  " + "1  " * n + "_", "a dot b " + "1-" * n + "x", "x dot y " + "one" * n + "_"):
        quick(lambda: pii.all_spans(text))


def test_fuzz_of_digits_separators_and_letters():
    rng = random.Random(8)
    pieces = ["1", "22", "333333", "one", "uno", "un", "acht", "oh", " ", "  ", "\t", ",", ".", "-", "x", "_", "plus ", "+", "@", " at ", " dot ", "[at]", "(", ")", "é"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) * rng.choice([1, 1, 2, 30]) for _ in range(rng.randrange(1, 60)))
        quick(lambda: pii.all_spans(text + " dot z"))


def test_spelled_runs_are_found_as_before():
    """The earlier pattern, which may read several digits as one step, on inputs short enough for it."""
    between, digit = r"(?:[ \t]*[,.-]?[ \t]*)", pii._DIGIT
    old = re.compile(rf"(?<!\w)(?:plus[ \t]+)?(?:{digit}|[0-9]){between}(?:(?:{digit}|[0-9]+){between}){{5,}}(?!\w)", re.I)
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["1", "23", "one", "two", "uno", "sept", " ", " ", "-", ". ", ", ", "x", "plus "]) for _ in range(rng.randrange(4, 16)))
        assert [m.span() for m in pii.SPELLED.finditer(text)] == [m.span() for m in old.finditer(text)], text


def test_brackets_after_brackets_and_blanks_are_found():
    for text in ("a [at] b [dot] com", "a[at] [at]b", "a  (at)  b {dot}  (dot) c", "[dot] [dot]"):
        for new, word in ((pii.BRACKET_AT, pii._AT + "|@"), (pii.BRACKET_DOT, pii._DOT + r"|\.")):
            old = re.compile(rf"[ \t]*[\[({{<][ \t]*(?:{word})[ \t]*[\])}}>][ \t]*", re.I)
            assert [m.span() for m in new.finditer(text)] == [m.span() for m in old.finditer(text)]


def test_schemas_cannot_make_a_call_run_on():
    assert "does not match" in quick(lambda: chat.problem("a" * 5000 + "!", {"pattern": "^(a+)+$"}))
    assert quick(lambda: chat.problem("a" * 5000, {"pattern": "(a+)+$"})) is None
    assert "unchecked" in chat.problem("aa", {"pattern": r"(a)\1"}) and "unchecked" in chat.problem("aa", {"pattern": "("})
    assert quick(lambda: chat.problem(list(range(20_000)), {"uniqueItems": True})) is None
    assert "repeat" in quick(lambda: chat.problem([*range(20_000), 7.0], {"uniqueItems": True}))
    chain = {f"d{k}": {"anyOf": [{"$ref": f"#/$defs/d{k + 1}"}, {"$ref": f"#/$defs/d{k + 1}", "title": "again"}]} for k in range(30)} | {"d30": {"type": "string"}}
    assert "fits none" in quick(lambda: chat.problem(5, {"$ref": "#/$defs/d0", "$defs": chain}))
    wide = {"anyOf": [{"allOf": [{"not": {"const": k * 1000 + i}} for i in range(300)] + [{"type": "null"}]} for k in range(300)]}
    assert "too much work" in quick(lambda: chat.problem(5, wide))
    long = [{"a": k, "b": [k]} for k in range(20_000)]
    assert quick(lambda: chat.problem(long, {"items": {"properties": {"a": {"type": "integer"}}, "required": ["b"]}}), 3) is None
    assert len(json.dumps(long)) > 100_000


def test_marks_are_equal_where_values_are():
    values = [1, 1.0, True, False, 0, None, "1", "", [], [1], [1.0], [True], {}, {"a": 1}, {"a": 1.0}, {"a": True}, [[]], {"a": []}]
    for a in values:
        for b in values:
            assert (chat.mark(a) == chat.mark(b)) == chat.same(a, b), (a, b)
