import hashlib
import re

import pytest

from gleanery.llm import middle
from tests.llm.helpers import SCHEMA, awkward, documents, prose

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def brute(doc_id, text, seed=7, percent=100, spm=50):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or re.search("<P>|<S>|<M>", text) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_the_tree_cuts_where_the_loop_does(block):
    for text in ("", "\n", "a", "a\n", "\n\n\n", "é\n\U0001f600\r\nx y\nz", "äöü" * 50, "".join(f"líne {k}\n" * (k % 3) for k in range(40)) + "end"):
        tree, units = middle.BlockTree(text.encode(), block), UNIT.findall(text)
        assert tree.n == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert tree.cut(k) == (len(head.encode()), len(head))


def test_outputs_equal_brute_force_and_restore(spark):
    import random

    rng = random.Random(3)
    texts = awkward() + [(100 + k, "\n".join(prose(rng, rng.randrange(0, 9)) + rng.choice(["", "é", "<", "\r"]) for _ in range(rng.randrange(1, 400)))) for k in range(60)]
    texts += [(200, "a <P> b"), (201, "x\n<S>"), (202, "<M>"), (203, "<\nP>\n<"), (204, "\n"), (205, "\n" * 5000)]
    made = middle.fill_in_middle(documents(spark, texts))
    got = made.withColumn("text", middle.restored(made["form"], made["output"])).collect()
    assert len(got) == len(texts)
    want = sorted((str((i, *brute(i, t), t or "")) for i, t in texts))
    assert sorted(str((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["text"])) for r in got) == want
    assert {"psm", "spm", "plain"} == {r["form"] for r in got}


def test_shares_marks_and_other_columns(spark):
    docs = documents(spark, [(k, f"a\nb {k}\nc") for k in range(400)]).withColumnsRenamed({"mark": "form", "copies": "output", "doc_id": "key", "text": "body"})
    rows = middle.fill_in_middle(docs, seed=1, percent=30, spm_percent=0, sentinels=("[p]", "[s]", "[m]"), id_col="key", text_col="body", keep=("lang",)).collect()
    assert {r["form"] for r in rows} == {"plain", "psm"} and 60 < sum(r["form"] == "psm" for r in rows) < 180
    assert all(r["output"].startswith("[p]") for r in rows if r["form"] == "psm") and rows[0]["lang"] == "en"
    assert rows == middle.fill_in_middle(docs.repartition(7), seed=1, percent=30, spm_percent=0, sentinels=("[p]", "[s]", "[m]"), id_col="key", text_col="body", keep=("lang",)).sort("doc_id").collect()


def test_empty_table(spark):
    assert middle.digests(middle.fill_in_middle(spark.createDataFrame([], SCHEMA))).collect() == []
