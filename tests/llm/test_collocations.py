import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleanery.llm import collocations as C
from tests.llm.helpers import SCHEMA, awkward, documents

FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, top=2000, least=10, cover=50):
    """All phrases of one to three words counted, then every rule applied to each."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    best = {}
    for (lang, *w), a in found.items():
        longer = [b for (other, *v), b in found.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * b >= cover * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        best.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return [(lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, all_ in best.items() for k, (s, a, p, left, right) in enumerate(sorted(all_)[:top], 1)]


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["É", "A", "b c", "\U0001f600"]
    fixed = ["New York City", "der die das", "x y z", "p q", "p q p q p q"]
    out = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(0, 60))]
        out.append((rng.choice(["en", "en", "de", None]), "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ! "]) for p in parts)))
    return out


def table(spark, rows):
    return spark.createDataFrame([(k % 7, t, lang, "s", 1, 2, 3, 4, 5.0) for k, (lang, t) in enumerate(rows)], SCHEMA)


def mined(docs, **options):
    return sorted(tuple(r[c] for c in FIELDS) for r in C.mine(docs, **options).select(*FIELDS).collect())


@pytest.mark.parametrize("options", [{}, {"top": 7, "widen": 1.5}, {"top": 3, "least": 2, "cover": 80, "widen": 2}])
def test_phrases_equal_brute_force(spark, options):
    rows = corpus(len(options)) + [(None, None), ("fr", ""), ("en", "New York City")]
    want = brute(rows, **{k: v for k, v in options.items() if k != "widen"})
    assert mined(table(spark, rows), **options) == sorted(want) and want


def test_small_batches_settle_in_rounds_with_ties(spark, monkeypatch):
    batches = []
    ends = C.batch_ends
    monkeypatch.setattr(C, "batch_ends", lambda pairs, size: (batches.append(size), ends(pairs, size))[1])
    ties = [("en", f"a{k} b{k} c{k}, d{k} e{k}") for k in range(30) for _ in range(10)]  # all score 1,000,000; triples cover two thirds of the pairs
    covered = [("es", f"a{k} b{k} c{k}") for k in range(25) for _ in range(10 + k)] + [("es", f"a{k}") for k in range(25) for _ in range(5 * k)]  # b c scores 1,000,000, yet goes
    rows = ties + covered
    assert mined(table(spark, rows), top=12, widen=1.5) == sorted(brute(rows, top=12))
    assert len(batches) > 1


def test_chunks_and_segments_lose_nothing(spark, monkeypatch):
    raw = b"ab c\xff" * 50 + b"no end at all " * 40
    for size in (1, 7, 100, 10_000):
        assert b"\xff".join(C.segments(raw, size)) == raw
    rows = corpus(9, 60)
    monkeypatch.setattr(C, "CHUNK", 50)
    assert mined(table(spark, rows).repartition(5)) == sorted(brute(rows))


def test_slots_agree_with_sql(spark):
    pairs = [("en", "a", "b"), ("de", "é", "\U0001f600"), ("und", "x y", "")]
    want = [r[0] for r in spark.createDataFrame(pairs, C.PAIR).select(C.slot_of(*C.PAIR)).collect()]
    h = lambda x: np.array([xxhash.xxh64_intdigest(x.encode(), 42)], dtype=np.uint64)
    assert want == [int(C.slots(h(a)[0], h(b), h(c))[0]) for a, b, c in pairs]


def test_products_beyond_64_bits_stay_exact(spark):
    a, left, right = 3_037_000_500_123, 4_037_000_500_777, 5_037_000_500_999
    row = spark.createDataFrame([(a, left, right)], "a long, b long, c long").select(C.score("a", "b", "c")).first()
    assert row[0] == 1_000_000 * a * a // (left * right)


def test_awkward_and_empty_tables(spark):
    docs = documents(spark, awkward()).withColumnsRenamed({"mark": "f", "copies": "w1", "n": "score"})
    assert mined(docs) == sorted(brute([("en", t) for _, t in awkward()]))
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert C.mine(docs).filter(F.col("rank") < 1).count() == 0
