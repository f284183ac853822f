import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import chat, extraction, fingerprints, lines, packing, pii, quality, rules
from tests.llm.helpers import SCHEMA, awkward, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------------- lines


def brute_lines(rows, least=lines.MIN_WORDS):
    """All runs of lines with ``least`` words against all runs that start earlier; wordless lines go with their neighbours."""
    docs = {(i, t): t.split("\n") for i, t in rows if t is not None}
    worded = {d: [(p, x.strip(" \t\n\x0b\x0c\r")) for p, x in enumerate(v) if x.strip(" \t\n\x0b\x0c\r")] for d, v in docs.items()}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    seen, gone = set(), {d: set() for d in docs}
    for d in order:
        seq = worded[d]
        for a in range(len(seq)):
            n, runs = 0, []
            for b in range(a, len(seq)):
                n += len(WORD.findall(seq[b][1]))
                if n >= least:
                    runs.append((tuple(x for _, x in seq[a : b + 1]), b))
            for key, b in runs:
                if key in seen:
                    gone[d].update(range(a, b + 1))
            seen.update(key for key, _ in runs)
    out = {}
    for d, v in docs.items():
        at = [p for p, _ in worded[d]]
        deleted = {at[k] for k in gone[d]} | {p for k in gone[d] if k + 1 in gone[d] for p in range(at[k], at[k + 1])}
        out[d] = "\n".join(x for p, x in enumerate(v) if p not in deleted)
    return out


def test_a_run_that_repeats_another_than_the_first_occurrence_goes(spark):
    long = "one two three four five"
    rows = [(1, f"{long}\nother"), (2, f"{long}\nz"), (3, f"begin\n{long}\n\nz\nend"), (4, f"z\n{long}")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: f"{long}\nother", 2: "z", 3: "begin\nend", 4: "z"}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    pool = [prose(rng, rng.choice([1, 2, 3, 6, 12])) for _ in range(25)]
    rows = [(k, "\n".join(rng.choice(pool + [" ", "", "z", "y y"]) for _ in range(rng.randrange(1, 12)))) for k in range(60)]
    want = brute_lines(rows)
    got = lines.dedup_lines(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == want[(r["doc_id"], dict(rows)[r["doc_id"]])]


def test_line_dedup_of_awkward_rows(spark):
    got = lines.dedup_lines(documents(spark, awkward()), keep=("lang",)).collect()
    assert len(got) == len(awkward())
    assert {r["text"] for r in got if r["doc_id"] == 3} == {None}
    kept = [r for r in got if r["text"] and r["text"].startswith("w") and r["n_deleted"] == 0]
    assert {r["doc_id"] for r in kept} >= {None, 7, 8}  # the null id comes first
    assert all(r["text"] == "" for r in got if r["doc_id"] in (1, 2))
    assert lines.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


# -------------------------------------------------------------------------- html


def page(body, k=0):
    return f"<!DOCTYPE html><html><head><title>t{k}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>menu {k}</a></li></ul></nav><div class='ad'>Buy {k}</div>{body}<footer>&copy; {k}</footer></body></html>"


def test_extraction_finds_the_article():
    rng = random.Random(2)
    want, pages = [], []
    for k in range(12):
        parts = [prose(rng, 8), *[prose(rng, 20) for _ in range(rng.randrange(1, 6))]]
        body = f"<article><h1>{parts[0]}</h1>" + "".join(f"<p>{p} &amp; <b>bold</b></p>" if j % 2 else f"<p>{p} &amp;\n  bold<br>" for j, p in enumerate(parts[1:])) + "<p>Share this story</p><section class='comments'><p>first!</p></section></article><aside>more</aside>"
        pages.append(page(body, k))
        want.append("\n".join([parts[0], *[f"{p} & bold" for p in parts[1:]]]))
    assert extraction.extract_block(pages) == want  # "Share this story" is the same on all pages


def test_copies_are_not_template():
    p = page("<article><h1>One</h1><p>same text here</p></article>")
    assert set(extraction.extract_block([p] * 20)) == {"One\nsame text here"}


@pytest.mark.parametrize("broken", ["", "<", "<p", "<p>a<p>b", "</p></div>x", "<a href='x", "<!-- open", "<script>never closed", "&#xZZ;&bogus;", "<div>" * 3000 + "deep"])
def test_extraction_never_fails(broken):
    assert isinstance(extraction.extract_block([broken])[0], str)


def test_pages_query(spark):
    rows = [(1, "https://h.com/a", page("<article><p>text &lt;1&gt;</p></article>"), 5), (2, None, None, 5), (None, "x", "", 5), (1, "https://h.com/a", page("<article><p>text &lt;1&gt;</p></article>"), 5)]
    got = extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "text <1>", 8), (1, "text <1>", 8), (2, "", 0)]
    assert extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_nothing_that_varies_is_left_outside_the_main_node():
    rng = random.Random(12)
    said = [[prose(rng, n) for n in (6, 12, 300, 8)] for _ in range(6)]
    want = ["\n".join(s) for s in said]
    plain = [f"<body><div><h1>{a}</h1><p>{b}</p><div><p>{c}</p><p>{d}</p></div></div><div><p>All our letters are free.</p></div></body>" for a, b, c, d in said]
    assert extraction.extract_block(plain) == want
    assert extraction.extract_block([f"<body><div><h1>{a}</h1><p>{b}</p><p>{c}</p><p>{d}</p></div></body>" for a, b, c, d in said]) == want
    several = [f"<body><article><h1>{a}</h1><p>{b}</p></article><article><p>{c}</p></article><div><article><p>{d}</p></article></div></body>" for a, b, c, d in said]
    assert extraction.extract_block(several) == want
    teased = [f"<body><div><h1>{a}</h1><p>{b}</p><p>{c}</p></div><article><p>{d}</p></article></body>" for a, b, c, d in said]
    assert extraction.extract_block(teased) == want


def test_parts_of_an_article_are_not_taken_for_furniture():
    rng = random.Random(18)
    for shape in ("<div class='entry-header'><h1>{}</h1></div><p>{}</p>", "<header class='article-header'><h1>{}</h1></header><p>{}</p>", "<h1>{}</h1><section class='side-by-side'><p>{}</p></section>", "<h1 data-x=it's>{}</h1><p title=5\">{}</p>"):
        said = [[prose(rng, 6), prose(rng, 30)] for _ in range(5)]
        assert extraction.extract_block([page(f"<article>{shape.format(*s)}</article>") for s in said]) == ["\n".join(s) for s in said]


def test_deep_pages_take_linear_time():
    import time

    start = time.monotonic()
    for tag in ("div", "x-y", "li", "span"):
        deep = f"<{tag}>a" * 10000 + "deep" + f"</{tag}></b>" * 10000
        assert extraction.extract_block([deep])[0].endswith("deep")
    assert time.monotonic() - start < 20


def furnished(rng, k):
    """A page whose furniture neither elements nor names tell, and its blocks."""
    blocks = [prose(rng, rng.randrange(3, 40)) for _ in range(rng.randrange(2, 12))]
    tags = ["h1"] + [rng.choice(["p", "p", "p", "h2", "div"]) for _ in blocks[1:]]
    body = "".join(f"<{t}>{b}</{t}>" for t, b in zip(tags, blocks))
    extra = rng.choice(["", "<p>This page was put on the web by our own staff.</p>"])
    return f"<html><body><div><p>The Daily Letter</p><ul><li>Home</li><li>News</li></ul></div><div>{body}{extra}<p>Tell us what you think of it.</p></div><div><p>All rights are ours.</p><p>Written in the north.</p></div></body></html>", blocks


def test_recall_and_precision_on_unnamed_furniture():
    rng = random.Random(19)
    pages = [furnished(rng, k) for k in range(60)]
    right = got = want = 0
    for (_, blocks), text in zip(pages, extraction.extract_block([p for p, _ in pages])):
        lines = text.split("\n")
        right += len(set(lines) & set(blocks))
        got, want = got + len(lines), want + len(blocks)
    assert right >= 0.97 * want and right >= 0.93 * got


def test_long_lists_of_children_are_aligned():
    rng = random.Random(13)
    pages, want = [], []
    for k in range(5):
        own = [(rng.choice(["p", "h2", "ul", "div"]), f"{k} {j} {prose(rng, 4)}") for j in range(600 + 7 * k)]
        half = len(own) // 2
        parts = [*own[:half], ("p", "All our letters are free."), *own[half:]]
        pages.append("<body><div>" + "".join(f"<{t} class='c{rng.randrange(3)}'>{x}</{t}>" if x[0].isdigit() else f"<p>{x}</p>" for t, x in parts) + "</div></body>")
        want.append("\n".join(x for _, x in own))
    assert extraction.extract_block(pages) == want


def test_matched_lists_weigh_as_much_as_the_whole_table(monkeypatch):
    rng = random.Random(14)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(40))] for _ in range(2))
        wa, wb = [rng.randrange(1, 9) for _ in a], [rng.randrange(1, 9) for _ in b]
        monkeypatch.setattr(extraction, "TABLE_CELLS", 10**9)
        table = extraction.matched(a, b, wa, wb)
        monkeypatch.setattr(extraction, "TABLE_CELLS", 6)
        split = extraction.matched(a, b, wa, wb)
        assert all(a[i] == b[j] for i, j in split) and all(p < q and r < s for (p, r), (q, s) in zip(split, split[1:]))
        assert sum(min(wa[i], wb[j]) for i, j in split) == sum(min(wa[i], wb[j]) for i, j in table)


def noticed_pages(rng, n):
    """Pages of one host with a notice that neither element nor class names tell."""
    return [(k, f"https://one.host/{k}", f"<html><body><div><p>All our letters are free.</p><p>{prose(rng, 30)}</p><p>{prose(rng, 31)}</p></div></body></html>") for k in range(n)]


@pytest.mark.parametrize("n, partitions", [(65, 1), (67, 4), (30, 16), (300, 3)])
def test_every_page_has_the_references_of_its_host(spark, n, partitions):
    rows = noticed_pages(random.Random(5), n) + [(1000, "https://alone.host/", "<p>one page</p>")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == n + 1
    assert [r["page_id"] for r in got if "letters" in r["text"]] == []


# ----------------------------------------------------------------------- packing


def test_fast_and_exact_tokens_are_the_same():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    encode, exact = packing.Encoder(path), Tokenizer.from_file(path)
    for t in ["", " ", "a\n\n b", "<|endoftext|> x", "é́ ß 中文 😀   \u0085x", "it's I'LL 'll 12 3rd", "﻿​ a"]:
        assert encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def test_fast_tokens_are_exact_for_every_character(sf_dir):
    import sys

    import pandas as pd
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    encode, exact = packing.Encoder(path), Tokenizer.from_file(path)
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}1{c}{c}\n" for c in every[k : k + 400]) for k in range(0, len(every), 400)]
    texts += pd.read_parquet(f"{sf_dir}/documents.parquet")["text"].dropna().tolist()
    for t, want in zip(texts, exact.encode_batch(texts, add_special_tokens=False)):
        assert encode(t).tolist() == want.ids


def test_placement_equals_the_rule():
    """Each piece, longest first, against every open bin: the sum of squares has to be the least."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths, capacity = rng.integers(1, 60, 80), 60
        bins, offsets = packing.place(lengths, capacity)
        gaps: dict[int, int] = {}

        def squares(gaps):
            n = np.bincount([g for g in gaps.values() if g], minlength=capacity + 1)
            return int((n.astype(np.int64) ** 2).sum())

        for i in np.argsort(-lengths, kind="stable"):
            room = [b for b, g in gaps.items() if g >= lengths[i]]
            if not room:
                assert bins[i] not in gaps and offsets[i] == 0
                gaps[int(bins[i])] = capacity - int(lengths[i])
                continue
            assert bins[i] in room and offsets[i] == capacity - gaps[int(bins[i])]
            best = min(squares(gaps | {b: gaps[b] - int(lengths[i])}) for b in room)
            gaps[int(bins[i])] -= int(lengths[i])
            assert squares(gaps) == best


def test_packing_is_a_round_trip(spark):
    import zlib

    rows = awkward()
    got = packing.pack(documents(spark, rows), group_pieces=7).collect()
    encode = packing.Encoder(packing.default_tokenizer())
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    want = []
    for i, t in rows:
        ids = np.append(encode(t or ""), 0).astype("<u4")
        want += [(i or 0, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_wastes_little():
    lengths = np.random.default_rng(0).integers(1, 2048, 4000)
    bins, offsets = packing.place(lengths, 2048)
    assert bins.max() + 1 <= 1.01 * lengths.sum() / 2048 + 1 or bins.max() + 1 <= 1.06 * lengths.sum() / 2048


# ------------------------------------------------------------------ fingerprints


def test_entropy_classes_equal_the_definition():
    data = np.frombuffer(prose(random.Random(3), 60).encode() + bytes(range(200)) + b"a" * 90, dtype=np.uint8)
    got = fingerprints.entropy_classes(data)
    for k in range(0, len(got), 7):
        n = np.bincount(data[k : k + fingerprints.WINDOW])
        p = n[n > 0] / fingerprints.WINDOW
        assert abs(got[k] - -(p * np.log2(p)).sum() / np.log2(fingerprints.WINDOW) * fingerprints.LEVELS) <= 1


def test_fingerprints_tell_edits_from_other_texts(spark):
    rng = random.Random(8)
    rows = [(k, prose(rng, 600)) for k in range(30)]
    got = fingerprints.fingerprint_edits(documents(spark, rows), partitions=4).collect()
    texts = dict(rows)
    for r in got:
        following = texts[(r["doc_id"] - 1) % 30]
        edited = fingerprints.edited_text(texts[r["doc_id"]], following)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0.3 < r["near_edited"] < 0.8 and r["near_next"] < 0.15


def brute_digest(text, ranking):
    """The features of a text by the definition, one window at a time, in one long chain of filters."""
    raw = text.encode()
    w, span = fingerprints.WINDOW, fingerprints.SPAN
    if len(raw) < w:
        found = [raw] if raw else []
    else:
        rank = []
        for k in range(len(raw) - w + 1):
            n = np.bincount(np.frombuffer(raw[k : k + w], dtype=np.uint8))
            s = int(sum(fingerprints.STEPS[:v].sum() for v in n if v))
            bits = np.log2(w) - s / (1 << 20) / w
            rank.append(int(ranking[int(np.clip(np.round(bits / np.log2(w) * fingerprints.LEVELS), 0, fingerprints.LEVELS))]))
        size = min(span, len(rank))
        wins = [0] * len(rank)
        for k in range(len(rank) - size + 1):
            wins[min(range(k, k + size), key=lambda j: (rank[j], j))] += 1
        chosen = [k for k, n in enumerate(wins) if n >= min(fingerprints.WINS, len(rank) - size + 1)] or [min(range(len(rank)), key=lambda j: (rank[j], j))]
        found = list(dict.fromkeys(raw[k : k + w] for k in chosen))
    filters = []
    for k, f in enumerate(found):
        if k % fingerprints.FILTER_FEATURES == 0:
            filters.append(np.zeros(fingerprints.FILTER_BITS, dtype=bool))
        for b in range(0, 20, 4):
            filters[-1][int.from_bytes(hashlib.sha1(f).digest()[b : b + 4], "little") % fingerprints.FILTER_BITS] = True
    return np.array(filters).reshape(-1, fingerprints.FILTER_BITS)


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(23)
    rows = [(k, prose(rng, rng.choice([1, 5, 20, 200]))) for k in range(12)] + [(5, prose(rng, 30)), (5, prose(rng, 40)), (None, prose(rng, 30)), (None, prose(rng, 12)), (None, None), (20, "")]
    ranking, _ = fingerprints.rarity(documents(spark, rows))
    order = sorted(((-(1 << 63) if i is None else i, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for i, t in rows), reverse=True)
    want = []
    for (i, _, text), (_, _, following) in zip(order, order[1:] + order[:1]):
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        mine, other, after = (brute_digest(x, ranking) for x in (text, edited, following))
        want.append((max(i, -1), len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.to_string(mine), fingerprints.to_string(other), fingerprints.likeness(mine, other), fingerprints.likeness(mine, after)))
    for partitions in (1, 3, 9):
        got = fingerprints.fingerprint_edits(documents(spark, rows), partitions=partitions).collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want)


def test_rows_of_one_id_are_spread_in_order():
    rng = np.random.default_rng(6)
    x = np.sort(np.where(rng.random(4000) < 0.5, 7, rng.integers(0, 15, 4000)))
    hashed = rng.integers(0, 1 << 32, 4000)
    cuts = np.sort(np.quantile(x, np.arange(1, 10) / 10, method="nearest")).astype(np.int64)
    import pandas as pd

    part = fingerprints.ranges(cuts).func(pd.Series(x), pd.Series(hashed)).to_numpy()
    order = np.lexsort((-hashed, -x))
    assert (np.diff(part[order]) >= 0).all() and len(set(part[x == 7])) >= 4 and np.bincount(part).max() < 1000


def test_fingerprints_of_awkward_rows(spark):
    got = fingerprints.fingerprint_edits(documents(spark, awkward()), partitions=3).collect()
    assert len(got) == len(awkward())
    same = {r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}
    assert len(same) == 1 and all(0 <= r["near_next"] <= 1 for r in got)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (3, 4)} == {""}
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0


# ----------------------------------------------------------------------- quality


def test_quality_learns_from_positives_alone(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(300):
        good = k % 4 != 0
        text = ". ".join(prose(rng, 12).capitalize() for _ in range(6)) + "." if good else " ".join(w + "%%%" for w in prose(rng, 60).split())
        rows.append((k, text))
        if k % 2 == 0 or good:
            labels.append((k, int(good)))
    got = quality.score_quality(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 300 and held
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held]) > 0.95
    kept = quality.filter_quality(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_the_prior_is_estimated_without_negatives(prior):
    rng = np.random.default_rng(3)
    draw = lambda n, good: rng.normal(1.0 if good else -1.0, 1.0, (n, 6))
    n = 3000
    mixed = np.concatenate([draw(int(n * prior), True), draw(n - int(n * prior), False)])
    assert abs(quality.estimate_prior(draw(1500, True), mixed, np.full(n, 1 / n), n) - prior) < 0.1


def test_weighted_points_cover_all_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, quality.N_FEATURES)).astype(np.float32)
    rows = spark.createDataFrame([(k, [float(v) for v in f]) for k, f in enumerate(x)], "doc_id long, features array<float>")
    points, weights, n = quality.weighted_points(rows, points=40)
    assert n == 500 and len(points) <= 40 and weights.sum() == pytest.approx(1)
    assert {tuple(p) for p in points} <= {tuple(f) for f in x.astype(np.float64)}
    assert abs(weights @ points - x.mean(0)).max() < 0.8  # one row stands for each region
    every, even, _ = quality.weighted_points(rows, points=500)
    assert len(every) == 500 and even == pytest.approx(1 / 500)


def test_negative_labels_are_not_learnt_from(spark):
    rng = random.Random(21)
    rows = [(k, prose(rng, 30) if k % 3 else "#" * 50) for k in range(90)]
    labels = [(k, int(k % 3 > 0)) for k in range(90)]
    score = lambda some: {r["doc_id"]: r["score"] for r in quality.score_quality(documents(spark, rows), spark.createDataFrame(some, "doc_id long, quality int")).collect()}
    assert score(labels) == pytest.approx(score([x for x in labels if x[1]]))


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(2, 1), (7, 1), (None, 1), (6, None)], "doc_id long, quality int")
    got = quality.score_quality(documents(spark, awkward()), labels).collect()
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.score_quality(documents(spark, awkward()), labels.filter("doc_id < 0")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score_quality(spark.createDataFrame([], SCHEMA), labels).count() == 0


# ------------------------------------------------------------------------- rules


def brute_repeats(words):
    seen = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    return len({j for at in seen.values() if len(at) > 1 for k in at for j in range(k, k + 8)})


def test_rules_equal_brute_force(spark):
    rng = random.Random(9)
    rows = awkward() + [(20 + k, "\n".join(rng.choice([prose(random.Random(k % 3), 12), prose(rng, 9), "#tag $1", ""]) for _ in range(6))) for k in range(40)]
    trusted = spark.createDataFrame([(k,) for k in range(20, 50)], "doc_id long")
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    for r in rules.apply_rules(documents(spark, rows), trusted).collect():
        t = texts[r["doc_id"]][0] if len(set(texts[r["doc_id"]])) == 1 else None
        if t is None:
            continue
        words = WORD.findall(t)
        split = [x for x in t.split("\n") if WORD.search(x)]
        repeats = brute_repeats(words)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(split) - len(set(split)), repeats)
        assert r["base_failed"] == (len(words) < 20 or 100 * repeats > 30 * len(words)) and r["kept"] <= (not r["base_failed"])


def test_log_ratios_equal_the_two_multinomials():
    rng = random.Random(20)
    texts, trusted = [prose(rng, rng.randrange(0, 60)) for _ in range(40)], [k % 3 == 0 for k in range(40)]
    grams = [rules.ngram_buckets(*rules.split_words([t], lower=True))[0].tolist() for t in texts]
    counts = np.zeros((2, rules.BUCKETS), dtype=np.int64)
    for g, good in zip(grams, trusted):
        for b in g:
            counts[0, b] += 1
            counts[1, b] += good
    got = rules.log_ratios(texts, counts)
    for k, (g, good) in enumerate(zip(grams, trusted)):
        for within in (False, True)[: 1 + good]:  # a trusted text leaves both multinomials
            raw, target = counts.astype(float)
            np.subtract.at(raw, g, 1)
            np.subtract.at(target, g, within)
            alpha = max(1.0, raw.sum() / target.sum())
            p, q = target + 1.0, raw + alpha
            p, q = p / p.sum(), q / q.sum()
            assert p.sum() == pytest.approx(1) and q.sum() == pytest.approx(1)
            assert got[int(within), k] == pytest.approx(np.mean([np.log(p[b]) - np.log(q[b]) for b in g]) if g else 0.0)


def test_a_text_is_judged_by_the_others_whether_trusted_or_not(spark):
    rng = random.Random(23)
    rows = [(k, prose(rng, 60)) for k in range(80)] + [(80, " ".join(f"only{k}" for k in range(40)))]
    ratio = lambda ids: {r["doc_id"]: r["log_ratio"] for r in rules.apply_rules(documents(spark, rows), spark.createDataFrame([(k,) for k in ids], "doc_id long")).collect()}
    half = list(range(0, 80, 2))
    assert ratio([*half, 80])[80] == pytest.approx(ratio(half)[80])  # a mark on itself does not help a text
    assert ratio([80])[80] == 0.0  # no other trusted text
    means = ratio(half)
    inside, outside = np.mean([means[k] for k in half]), np.mean([means[k] for k in range(1, 80, 2)])
    assert abs(inside - outside) < 0.05


def test_the_verdict_is_the_base_rules_and_the_threshold(spark):
    rng = random.Random(22)
    rows = [(k, prose(rng, rng.choice([5, 25, 80]))) for k in range(60)]
    trusted = spark.createDataFrame([(k,) for k in range(0, 60, 2)], "doc_id long")
    for r in rules.apply_rules(documents(spark, rows), trusted, least_ratio=0.01).collect():
        assert r["kept"] == (not r["base_failed"] and r["log_ratio"] >= 0.01)


def test_the_ratio_tells_trusted_words_from_others(spark):
    rng = random.Random(10)
    odd = [f"z{k}" for k in range(300)]
    rows = [(k, prose(rng, 80) if k % 3 else " ".join(rng.choice(odd) for _ in range(80))) for k in range(120)]
    trusted = spark.createDataFrame([(k,) for k in range(0, 60) if k % 3], "doc_id long")
    got = rules.apply_rules(documents(spark, rows), trusted).collect()
    assert all(r["kept"] == bool(r["doc_id"] % 3) for r in got)


# --------------------------------------------------------------------------- pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = {k: [m.span() for m in re.finditer(p, text)] for k, p in PATTERNS.items()}
    digits = lambda s: re.sub("[^0-9]", "", text[s[0] : s[1]])
    out["ip"] = [s for s in out["ip"] if all(int(p) <= 255 for p in text[s[0] : s[1]].split("."))]
    out["card"] = [s for s in out["card"] if 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s))]
    out["phone"] = [s for s in out["phone"] if 8 <= len(digits(s)) <= 15]
    return out


def test_plain_pii_equals_the_patterns():
    rng = random.Random(11)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "+1 (555) 555-1234", "+", "12", "word", ".", "-", "é", "😀", "a@b.c@d.e"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 9)))
        assert pii.base_spans(t) == brute_pii(t), t


@pytest.mark.parametrize(
    "text, kind, shown",
    [
        ("write to jane dot roe at mail dot example dot com today", "email", "jane dot roe at mail dot example dot com"),
        ("x john [at] example [dot] org y", "email", "john [at] example [dot] org"),
        ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("mail jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("ja​ne@exam​ple.com", "email", "ja​ne@exam​ple.com"),
        ("server 10 dot 0 dot 0 dot 7 is", "ip", "10 dot 0 dot 0 dot 7"),
        ("call plus one five five five, two three four five six seven eight now", "phone", "plus one five five five, two three four five six seven eight"),
        ("card ４１１１ １１１１ １１１１ １１１１.", "card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_disguised_pii(text, kind, shown):
    base, extra = pii.all_spans(text)
    assert not any(base.values()) or kind == "email"
    assert [text[s:e] for s, e in extra[kind]] == [shown]


@pytest.mark.parametrize(
    "text, kind, shown",
    [
        ("4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
        ("write to name at mail.1and1.com now", "email", "name at mail.1and1.com"),
        ("anna at example dot cz", "email", "anna at example dot cz"),
        ("anna at example dot co dot nz", "email", "anna at example dot co dot nz"),
        ("anna@example dot ie", "email", "anna@example dot ie"),
    ],
)
def test_disguised_pii_that_the_prefilter_or_the_endings_missed(text, kind, shown):
    assert [text[s:e] for s, e in pii.all_spans(text)[1][kind]] == [shown]


def test_whatever_the_transducers_change_is_suspect():
    rng = random.Random(15)
    parts = ["one", "Zwei", "trois", "ſeven", "sıx", "plus", "7", "411", "at", "AT", "arroba", "dot", "PUNTO", "poınt", "@", "[at]", "( dot )", "mail.1and1.com", "a.b", "example", "cz", "com", "10", "&#64;", "%40", "é", "x", "_", ",", ".", "-"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) + rng.choice([" ", " ", "\t", "", "\n"]) for _ in range(rng.randrange(1, 12)))
        if pii.normalised(t).text != t:
            assert pii.suspect(t), t


def disguised(rng, kind):
    """A random identifier of a kind, and a random disguise of it."""
    names = "zero one two three four five six seven eight nine".split()
    wide = lambda s: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in s)
    if kind == "email":
        plain = f"{rng.choice(['jane', 'john.roe', 'info7', 'a-b_c'])}@{rng.choice(['mail', 'uni-1', 'example'])}.{rng.choice(['com', 'org', 'de', 'co.uk'])}"
        look = str.maketrans("aeopc", "аеорс")
        return rng.choice([plain.replace("@", " at ").replace(".", " dot "), plain.replace("@", " [at] ").replace(".", " [dot] "), plain.replace("@", "(at)"), wide(plain), plain.translate(look), plain.replace("@", "&#64;"), plain.replace("@", " @ "), plain.replace("@", "\u200b@")])
    if kind == "ip":
        plain = ".".join(str(rng.randrange(256)) for _ in range(4))
        return rng.choice([plain.replace(".", " dot "), wide(plain), plain.replace(".", "[.]"), plain.replace(".", "[dot]"), plain.replace(".", "\u2024")])
    if kind == "card":
        digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
        digits += next(d for d in "0123456789" if pii.luhn(digits + d))
        grouped = " ".join(digits[k : k + 4] for k in range(0, 16, 4))
        spelled = " ".join(names[int(d)] for d in digits)
        return rng.choice([wide(digits), spelled, grouped.translate({48 + k: 0x660 + k for k in range(10)}), grouped[:-1] + " " + names[int(digits[-1])]])
    digits = "".join(str(rng.randrange(10)) for _ in range(rng.randrange(9, 13)))
    return rng.choice(["plus " + " ".join(names[int(d)] for d in digits), wide("+" + digits), "+" + " ".join(names[int(d)] for d in digits[:4]) + " " + digits[4:], "+" + digits[:3] + "\u2011" + digits[3:]])


@pytest.mark.parametrize("kind", pii.KINDS)
def test_recall_of_planted_disguises(kind):
    rng, found, n = random.Random(17), 0, 400
    for _ in range(n):
        shown = disguised(rng, kind)
        before = prose(rng, 5) + rng.choice([". ", ": ", " - "])
        base, extra = pii.all_spans(before + shown + ". " + prose(rng, 5))
        found += any(s < len(before) + len(shown) and e > len(before) for s, e in base[kind] + extra[kind])
    assert found >= 0.9 * n


def test_long_runs_of_digits_do_not_fail():
    assert pii.base_spans("1." + "0" * 5000 + ".1.1")["ip"] == [(0, 5006)]
    assert not any(pii.base_spans("1." + "9" * 5000 + ".1.1")[k] for k in ("email", "ip", "card", "phone"))


def test_plain_prose_has_no_pii():
    for t in ["look at the dot com boom", "he is at home. Then he left", "one two three", "meet at 5 dot 30", "a point of view at example", "un deux trois"]:
        assert not any(v for spans in pii.all_spans(t) for v in spans.values()), t


def test_pii_query(spark):
    got = pii.find_pii(documents(spark, awkward() + [(30, "a@b.co é 1.2.3.4")])).collect()
    assert len(got) == len(awkward()) + 1
    r = next(r for r in got if r["doc_id"] == 30)
    assert r["spans"] == "email:0:6,ip:9:16" and r["base_sha256"] == hashlib.sha256(b"email:0:6,ip:9:16").hexdigest() and r["redacted"] == "[EMAIL] é [IP]"
    assert pii.find_pii(spark.createDataFrame([], SCHEMA)).count() == 0


# -------------------------------------------------------------------------- chat


def test_tool_calls_meet_their_results(spark):
    call = '{"tool_calls":[{"id":"a","name":"f","arguments":"{\\"x\\":1}"},{"id":"b","function":{"name":"f","arguments":{"x":"1"}}}]}'
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id":"b","content":1}'), (1, 3, "tool", '{"tool_call_id":"a"}'), (1, 4, "tool", '{"tool_call_id":"z"}'), (1, 5, "tool", '{"tool_call_id":"a","content":"again"}')]
    rows += [(None, None, None, None), (2, 0, "user", "{not json"), (2, 0, "user", "{not json")]
    got = chat.link_tools(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}})
    first = [(r["turn"], r["status"], r["n_valid"], r["n_answered"]) for r in got.filter("conv_id = 1").orderBy("anchor", "step", "turn").collect()]
    assert first == [(0, "message", 0, 0), (1, "calls", 1, 2), (3, "result", 0, 0), (5, "repeat", 0, 0), (2, "result", 0, 0), (4, "orphan", 0, 0)]
    assert got.count() == len(rows)
    assert got.filter("conv_id = 2").select("json").distinct().collect()[0]["json"] == '{"content":"{not json","role":"user"}'
    assert chat.link_tools(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_links(rows):
    """Status, anchor and step of each message by reading the conversations from the start."""
    made, given, out = {}, {}, []
    parsed = [(conv, turn, *chat.read_message(role, text)) for conv, turn, role, text in rows]
    for conv, turn, _, _, calls in sorted(parsed, key=lambda m: m[1]):
        for k, call in enumerate(calls):
            if call["call_id"] is not None:
                made.setdefault((conv, call["call_id"]), (turn, k))
    for conv, turn, content, answers, _ in sorted(parsed, key=lambda m: m[1]):
        if answers is not None:
            given.setdefault((conv, answers), turn)
    for conv, turn, _, answers, calls in parsed:
        link = made.get((conv, answers)) if answers is not None else None
        status = "calls" if calls else "message"
        if answers is not None:
            status = "orphan" if link is None else "result" if given[(conv, answers)] == turn else "repeat"
        out.append((conv, turn, status, link[0] if link else turn, link[1] + 1 if link else 0, sum(made.get((conv, c["call_id"]), (None,))[0] == turn and (conv, c["call_id"]) in given for c in calls)))
    return sorted(out)


def test_links_equal_brute_force(spark):
    rng = random.Random(16)
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 12)):
            kind = rng.randrange(3)
            name = lambda: f"c{rng.randrange(6)}"
            if kind == 0:
                rows.append((conv, turn, "assistant", '{"tool_calls":[' + ",".join('{"id":"%s","name":"f","arguments":{}}' % i for i in rng.sample([f"c{k}" for k in range(6)], rng.randrange(1, 4))) + "]}"))
            elif kind == 1:
                rows.append((conv, turn, "tool", '{"tool_call_id":"%s","content":"%d"}' % (name(), turn)))
            else:
                rows.append((conv, turn, "user", prose(rng, 4)))
    got = chat.link_tools(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"], r["turn"], r["status"], r["anchor"], r["step"], r["n_answered"]) for r in got) == brute_links(rows)


def test_messages_that_are_hard_to_serialise(spark):
    import json

    deep = "[" * 900 + "]" * 900
    texts = [
        '{"tool_calls":[{"id":"a","name":"f","arguments":"%s"}]}' % deep, '{"tool_calls":[{"id":"b","name":"f","arguments":%s}]}' % ("[" * 60000 + "]" * 60000), '{"tool_calls":[{"id":["x"],"name":["f",1],"arguments":{}}]}',
        '{"tool_call_id":"a","content":"\\ud800 half"}', '{"tool_calls":[{"id":"\\ud800","name":"\\udfff","arguments":{"x":"\\udc00"}}]}', '{"tool_calls":[{"id":"n","name":"f","arguments":{"x":NaN}}]}', '{"tool_calls":[{"id":"i","name":"f","arguments":"{\\"x\\":1e999}"}]}',
        '{"tool_calls":[{"id":"d","name":"f","arguments":{"x":%s}}]}' % ("9" * 5000), "x" * 300000, '{"tools":[{"name":"\\ud801","parameters":%s}]}' % deep,
    ]
    rows = [(1, k, role, t) for k, t in enumerate(texts) for role in ("assistant", "tool", "system")]
    got = chat.link_tools(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        json.loads(r["json"], parse_constant=chat.refused)


def test_schema_problems():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"enum": [1, 2]}}}}
    assert chat.problem({"a": [1, 2]}, schema) is None
    assert chat.problem({}, schema) == "/a: missing"
    assert chat.problem({"a": [3]}, schema) == "/a/0: not one of the allowed values"
    assert chat.problem({"a": [], "b": 1}, schema) == "/b: unknown"
    assert chat.problem([], schema) == "/: not object"


def test_calls_are_checked_against_the_tools_of_their_conversation(spark):
    tools = '{"tools":[{"type":"function","function":{"name":"f","parameters":{"type":"object","required":["x"],"properties":{"x":{"type":"integer","minimum":1}}}}},{"name":"g","parameters":{"unevaluatedItems":false}}]}'
    call = '{"tool_calls":[{"id":"a","name":"f","arguments":{"x":1}},{"id":"b","name":"f","arguments":{"x":0}},{"id":"c","name":"g","arguments":{}},{"id":"d","name":"f","arguments":"{"}]}'
    rows = [(1, 0, "system", tools), (1, 1, "assistant", call), (2, 0, "user", tools), (2, 1, "assistant", call), (None, 0, "system", tools), (None, 1, "assistant", call)]
    got = chat.link_tools(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["turn"]): r["n_valid"] for r in got} == {(1, 0): 0, (1, 1): 1, (2, 0): 0, (2, 1): 0, (None, 0): 0, (None, 1): 1}


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"const": 1}, 1.0, True),
        ({"minimum": 1, "exclusiveMaximum": 3}, 1, 3),
        ({"multipleOf": 0.1}, 0.3, 0.35),
        ({"pattern": "^a", "maxLength": 2}, "ab", "abc"),
        ({"minItems": 1, "uniqueItems": True}, [1, True], [1, 1.0]),
        ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, ["a", 1], ["a", "b"]),
        ({"contains": {"const": 2}}, [1, 2], [1]),
        ({"anyOf": [{"type": "string"}, {"type": "null"}]}, None, 1),
        ({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, 1, 2),
        ({"allOf": [{"type": "string"}], "not": {"const": "a"}}, "b", "a"),
        ({"$defs": {"n": {"type": "object", "properties": {"next": {"$ref": "#/$defs/n"}}}}, "$ref": "#/$defs/n"}, {"next": {"next": {}}}, {"next": {"next": 1}}),
        ({"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": {"type": "string"}}, {"x1": 1, "y": "s"}, {"y": 1}),
        ({"if": {"required": ["a"]}, "then": {"required": ["b"]}}, {"c": 1}, {"a": 1}),
        (True, 1, None),
        ({"unevaluatedProperties": False}, None, {}),
    ],
)
def test_schema_keywords(schema, good, bad):
    assert (chat.problem(good, schema) is None) == (schema != {"unevaluatedProperties": False})
    assert (chat.problem(bad, schema) is None) == (schema is True)
