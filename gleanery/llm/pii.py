"""Personal data in texts, plain or disguised, with spans of the source characters."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_rows, text_or_empty

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can only start where a run of digits does
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("АВЕЅZІЈКМНОРСТУХаеорсухіјѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορτυικ", "ABESZIJKMHOPCTYXaeopcyxijsdhABEZHIKMNOPTYXavoptuik", strict=True))
MARKS = {"∂": "@", "ⓐ": "@", "。": ".", "．": ".", "․": ".", "‧": ".", "·": ".", "•": ".", "∙": "."} | dict.fromkeys("‐‑‒–—―−", "-")
INVISIBLE = frozenset("­​‌‍⁠﻿᠎‎‏")
# Names of the digits 0 to 9 in four languages.
DIGIT_NAMES = ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
DIGITS = {w: str(k) for names in DIGIT_NAMES for k, w in enumerate(names.split())} | {"oh": "0", "zwo": "2"}

UNUSUAL = re.compile(r"[^\x00-ɏ]|[­²³·¹ ]")
_DIGIT = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
# One digit a step and one way to read each run of blanks: a run that fails costs what it is long.
_BETWEEN = r"(?:[ \t]*(?:[,.-][ \t]*)?)"
SPELLED = re.compile(rf"(?<!\w)(?:plus[ \t]+)?(?:{_DIGIT}|[0-9]){_BETWEEN}(?:(?:{_DIGIT}|[0-9]){_BETWEEN}){{5,}}(?!\w)", re.I)
SPELLED_WORD = re.compile(rf"(?<!\w){_DIGIT}(?!\w)", re.I)
DIGIT_TOKEN = re.compile(rf"plus|{_DIGIT}|[0-9]+", re.I)
_AT = r"(?:at|arroba|arobase|klammeraffe)"
_DOT = r"(?:dot|punto|point|punkt)"
_LEAD = r"(?:(?<![ \t])[ \t]+)?"  # blanks before, from where they begin
BRACKET_AT = re.compile(rf"{_LEAD}[\[({{<][ \t]*(?:{_AT}|@)[ \t]*[\])}}>][ \t]*", re.I)
BRACKET_DOT = re.compile(rf"{_LEAD}[\[({{<][ \t]*(?:{_DOT}|\.)[ \t]*[\])}}>][ \t]*", re.I)
WORD_DOT = re.compile(rf"(?<=[A-Za-z0-9])[ \t]+{_DOT}[ \t]+(?=[A-Za-z0-9])", re.I)
WORD_AT = re.compile(rf"(?<=[A-Za-z0-9])[ \t]+{_AT}[ \t]+(?=[A-Za-z0-9])", re.I)
ESCAPED = re.compile(r"&(?:#0*64|#[xX]0*40|commat|#0*46|#[xX]0*2[eE]|period);|%40")
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])[ \t]+@[ \t]*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[ \t]*@[ \t]+(?=[A-Za-z0-9])")
# Endings that make plain words ("name at host dot com") an address.
ENDINGS = frozenset("com org net edu gov mil int info biz name io co ai app dev me tv us uk de fr es it nl be ch at eu ca au jp cn in br mx ru pl se no dk fi pt example test invalid local".split())
# Country codes and common generic endings, for addresses whose at and dot are both words.
COUNTRIES = """ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz
de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp
ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om
pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz
ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"""
GENERIC = """academy agency art asia bank bar best blog build business cat center church city click cloud club codes community company computer consulting coop design digital email energy events
expert finance fit fun fund games global group health help host house inc jobs land law legal life link live llc ltd marketing media mobi money museum network news ngo one ong online
page paris party photo photos pics plus press pro properties pub rest run sale school science services shop site social software solutions space store studio support systems tax team
tech technology tel tips today tools top town trade travel university video vip website wiki work works world wtf xxx xyz zone berlin wien koeln hamburg bayern nyc london tokyo"""
WORDED_ENDINGS = ENDINGS.union(COUNTRIES.split(), GENERIC.split())


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each ``@`` so that long words cost no more than short ones."""
    out: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    """The plain identifiers of each kind, leftmost and without overlap."""
    return {
        "email": emails(text) if "@" in text else [],
        "ip": [m.span() for m in IP.finditer(text) if all(len(d := p.lstrip("0")) < 4 and int(d or 0) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(d := only_digits(m.group())) <= 19 and luhn(d)],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(only_digits(m.group())) <= 15] if "+" in text else [],
    }


class Tape:
    """A text under rewriting: each character knows the span of source it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))

    def rewrite(self, spans: list[tuple[int, int, str]]) -> None:
        """Replace spans (in order, without overlap) by strings, whose characters stand for the whole span."""
        if not spans:
            return
        parts, starts, ends, at = [], [], [], 0
        for s, e, new in spans:
            parts += [self.text[at:s], new]
            starts += self.starts[at:s] + [self.starts[s]] * len(new)
            ends += self.ends[at:s] + [self.ends[e - 1]] * len(new)
            at = e
        self.text = "".join(parts) + self.text[at:]
        self.starts = starts + self.starts[at:]
        self.ends = ends + self.ends[at:]

    def source(self, span: Span) -> Span:
        return min(self.starts[span[0] : span[1]]), max(self.ends[span[0] : span[1]])


def plain_character(c: str) -> str:
    """What an unusual character stands for: nothing, ASCII characters, or itself."""
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS or c in MARKS:
        return HOMOGLYPHS.get(c) or MARKS[c]
    if unicodedata.category(c) == "Zs":
        return " "
    digit = unicodedata.decimal(c, None)
    if digit is None:
        digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() and folded else c


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Runs of at least seven digits of which some are words; a run in digits only stays."""
    out = []
    for m in SPELLED.finditer(text):
        run = m.group().rstrip(" \t,.-")
        if not SPELLED_WORD.search(run):
            continue
        new = "".join("+" if t.lower() == "plus" else DIGITS.get(t.lower(), t) for t in DIGIT_TOKEN.findall(run))
        if len(only_digits(new)) >= 7:
            out.append((m.start(), m.start() + len(run), new))
    return out


def worded_addresses(text: str) -> list[tuple[int, int, str]]:
    """``at`` and ``dot`` in words, only where what they join ends like an address.

    ``name at host dot com``, ``name at host.com`` and ``1 dot 2 dot 3 dot 4``.
    With a dot in words any country code or common generic ending will do.
    """
    out: list[tuple[int, int, str]] = []
    dots = [m.span() for m in WORD_DOT.finditer(text)]
    by_start, by_end = {d[0]: d for d in dots}, {d[1]: d for d in dots}
    for m in WORD_AT.finditer(text):
        pos, found = m.end(), []
        while label := LABEL.match(text, pos):
            pos = label.end()
            if pos not in by_start:
                break
            found.append(by_start[pos])
            pos = by_start[pos][1]
        parts = re.split(rf"[ \t]+{_DOT}[ \t]+|\.", text[m.end() : pos], flags=re.I)
        if len(parts) > 1 and parts[-1].lower() in (WORDED_ENDINGS if found else ENDINGS) and parts[0].lower() not in ARTICLES:
            left = m.start()
            while True:
                start = left
                while start > 0 and text[start - 1] in LOCAL:
                    start -= 1
                if start == left or start not in by_end:
                    break
                found.append(by_end[start])
                left = by_end[start][0]
            out += [(m.start(), m.end(), "@")] + [(s, e, ".") for s, e in found]
    for m in WORDED_IP.finditer(text):
        out += [(m.start() + d.start(), m.start() + d.end(), ".") for d in WORD_DOT.finditer(m.group())]
    return sorted(set(out))


def half_plain(text: str) -> list[tuple[int, int, str]]:
    """``name@host dot com``: worded dots after a real ``@``."""
    out = []
    for m in re.finditer(rf"@[A-Za-z0-9-]+(?:(?:\.|[ \t]+{_DOT}[ \t]+)[A-Za-z0-9-]+)+", text, re.I):
        last = re.split(rf"\.|[ \t]+{_DOT}[ \t]+", m.group(), flags=re.I)[-1]
        if last.lower() in WORDED_ENDINGS:
            out += [(m.start() + d.start(), m.start() + d.end(), ".") for d in WORD_DOT.finditer(m.group())]
    return out


def normalised(text: str) -> Tape:
    """Run the transducers one after the other: characters, escapes, digits, at and dot."""
    tape = Tape(text)
    tape.rewrite([(m.start(), m.end(), new) for m in UNUSUAL.finditer(text) if (new := plain_character(m.group())) != m.group()])
    tape.rewrite([(m.start(), m.end(), "." if re.search("46|2[eE]|period", m.group()) else "@") for m in ESCAPED.finditer(tape.text)])
    tape.rewrite(spelled_digits(tape.text))
    tape.rewrite([(m.start(), m.end(), ".") for m in BRACKET_DOT.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), "@") for m in BRACKET_AT.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), "@") for m in SPACED_AT.finditer(tape.text)])
    tape.rewrite(worded_addresses(tape.text))
    tape.rewrite(half_plain(tape.text))
    return tape


LABEL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
WORDED_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:[ \t]+{_DOT}[ \t]+[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
ARTICLES = ("the", "a", "an", "this", "that")
BRACKETED = re.compile(rf"[\[({{<][ \t]*(?:{_AT}|{_DOT}|@|\.)[ \t]*[\])}}>]")
AT_HOST = re.compile(rf" {_AT} +[a-z0-9-]+\.[a-z0-9-]")
NEAR_NAME = re.compile(rf"{_DIGIT}[ \t,.-]+(?:{_DIGIT}|[0-9])|[0-9][ \t,.-]+{_DIGIT}")  # a spelled digit beside another digit
FOLDED = str.maketrans("ſıİ", "sii")  # what patterns that ignore case take for s and i, and lower() does not
DOT_WORDS = (" dot ", " punto ", " point ", " punkt ")


def suspect(text: str) -> bool:
    """Whether any transducer could change the text; cheap, as most texts are plain.

    Each test is a part that the pattern of a transducer cannot do without.
    """
    if not text.isascii() and UNUSUAL.search(text):
        return True
    if ("&" in text or "%40" in text) and ESCAPED.search(text):
        return True
    if "@" in text and SPACED_AT.search(text):
        return True
    low = (text if text.isascii() else text.translate(FOLDED)).lower().replace("\t", " ")
    return any(w in low for w in DOT_WORDS) or bool(AT_HOST.search(low) or BRACKETED.search(low) or NEAR_NAME.search(low))


def all_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans, and the spans that only the normalised text shows."""
    base = base_spans(text)
    extra: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not suspect(text):
        return base, extra
    tape = normalised(text)
    for kind, spans in base_spans(tape.text).items():
        taken = list(base[kind])
        for span in spans:
            s, e = tape.source(span)
            if text[s:e] != tape.text[span[0] : span[1]] and not any(s < b and a < e for a, b in taken):
                taken.append((s, e))
                extra[kind].append((s, e))
    return base, extra


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def redact(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stays."""
    out, at = [], 0
    for s, e, kind in sorted((s, e, k) for k in KINDS for s, e in spans[k]):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, redacted string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find e-mail addresses, IP addresses, card and phone numbers in every text.

    n_* and base_sha256 are about the plain spans; ``spans`` adds those that
    only show after deobfuscation (n_added), unless they overlap a plain span
    of their kind.  Offsets are code points of the source, end exclusive;
    ``redacted`` is the text without them.  A null text is an empty one: no
    spans.  One row in, one row out, whatever the ids.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                base, extra = all_spans(text)
                every = {k: base[k] + extra[k] for k in KINDS}
                sha = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((doc, *(len(base[k]) for k in KINDS), sha, joined(every), sum(map(len, extra.values())), redact(text, every)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, SCHEMA)
