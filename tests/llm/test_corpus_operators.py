import random
import re

import pytest

from gleanery.llm import jaccard, lines, mixing
from tests.llm.helpers import SCHEMA, awkward, documents, prose
from tests.llm.test_text_operators import brute_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = [w.encode("utf-8", "surrogatepass").lower() for w in WORD.findall(text or "")]
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute_components(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            o = len(x & y)
            if x and y and 100 * o >= percent * (len(x) + len(y) - o) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    least = {}
    for (i, s), v in zip(sets, label):
        if s and i is not None:
            least[v] = min(i, least.get(v, i))
    return sorted(((i is None, i or 0), len(s), (least.get(v) if s else i) or 0) for (i, s), v in zip(sets, label))


def clusters(seed, sizes, n_words, edits):
    """Groups of edited copies of a text; some chains, some far apart."""
    rng = random.Random(seed)
    rows = []
    for size in sizes:
        base = prose(rng, rng.choice(n_words)).split()
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(edits)):
                words[rng.randrange(len(words))] = rng.choice("ABCDEFGH") + str(rng.randrange(99))
            rows.append((len(rows), " ".join(words)))
            if rng.random() < 0.3:
                base = words
    rng.shuffle(rows)
    return [(k, t) for k, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("n, percent, limits", [(3, 90, {}), (3, 90, {"region_sets": 5, "most_pivots": 3}), (5, 80, {"region_sets": 8}), (5, 80, {"cell_sets": 3, "region_sets": 6, "most_pivots": 2})])
def test_jaccard_equals_all_pairs(spark, n, percent, limits):
    rows = clusters(n + percent, [1] * 10 + [4, 9, 30, 45], [9, 14, 40, 120, 300], 4) + [(1000 + (i or 0), t) for i, t in awkward() if t is None or len(t) < 10000]
    got = jaccard.jaccard_components(documents(spark, rows), ngram=n, percent=percent, **limits).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"] or 0) for r in got) == brute_components(rows, n, percent)


def test_no_linked_pair_loses_its_cell():
    import numpy as np

    rng = np.random.default_rng(1)
    for percent in (80, 90):
        classes = jaccard.Classes(percent)
        for _ in range(300):
            a = int(rng.integers(9, 200))
            x = np.unique(rng.integers(0, 1 << 62, a).astype(np.uint64))
            apart = int(rng.integers(0, classes.most_apart(len(x)) + 1))
            drop = int(rng.integers(0, apart + 1))
            y = np.unique(np.concatenate([x[drop:], rng.integers(0, 1 << 62, apart - drop).astype(np.uint64)]))
            o = jaccard.overlap_with(x, y)
            if 100 * o >= percent * (len(x) + len(y) - o) and not np.array_equal(x, y):
                assert set(classes.cells(x).tolist()) & set(classes.cells(y).tolist())


def test_unfinished_components_are_an_error(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(8)], "a long, b long")
    with pytest.raises(RuntimeError):
        jaccard.components(pairs, most_rounds=1)


def test_jaccard_of_awkward_rows(spark):
    got = jaccard.jaccard_components(documents(spark, awkward()))
    assert got.count() == len(awkward())
    by = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert by[2]["component_id"] == 1 and by[8]["component_id"] == 1 and by[4]["component_id"] == 4 and by[4]["n_shingles"] == 0
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


# ------------------------------------------------------------------------ mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    total = sum(sizes)
    w = [weights[k % 3] for k in range(len(sizes))]
    capped = set()
    while True:
        left = total - sum(most * sizes[k] for k in capped)
        free = sum(w[k] for k in range(len(sizes)) if k not in capped)
        out = [most * sizes[k] if k in capped else left * w[k] / free for k in range(len(sizes))]
        over = {k for k in range(len(sizes)) if k not in capped and out[k] >= most * sizes[k]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 10, 10, 10], [5, 1000, 0, 7, 300], [1, 1]])
def test_targets_equal_the_loop(spark, sizes):
    rows = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert [got[f"s{k}"] for k in range(len(sizes))] == pytest.approx(brute_targets(sizes))


def test_mix_meets_its_targets(spark):
    rng = random.Random(12)
    rows = [(k, prose(rng, rng.choice([1, 5, 50, 400]))) for k in range(400)] + [(500, None), (501, ""), (1, "again"), (None, "no id")]
    sources = ["a", "b", "c", None, "B", "é"]
    docs = documents(spark, rows, sources)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken, target = {}, {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    order = sorted(s for s in target if s is not None) + [None]
    sizes = [sum(r["size"] for r in got if r["source"] == s) for s in order]
    assert [target[s] for s in order] == pytest.approx(brute_targets(sizes))
    for s in target:
        assert abs(taken[s] - target[s]) <= max(3, 0.01 * target[s])
    again = {(r["doc_id"], r["mark"]): r["copies"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert sum(again[(r["doc_id"], r["mark"])] != r["copies"] for r in got) == 0


def test_mix_of_empty_and_wordless_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r["taken"] for r in mixing.mix(documents(spark, [(1, ""), (2, None)])).collect()] == [0, 0]


# ---------------------------------------------------------------------- pipeline


def test_pipeline_stages_equal_brute_force(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]
    rows = clusters(3, [1] * 8 + [6, 12], [60, 150], 3)
    rows = [(i, t.replace(" ", "\n", 3) if i % 2 else t) for i, t in rows]
    docs = documents(spark, rows)
    kept = {r["doc_id"]: r["text"] for r in p.drop_repeated_lines(spark, docs, "").collect()}
    want = {i: t for (i, _), t in brute_lines(rows).items() if WORD.search(t)}
    assert kept == want
    heads = {r["doc_id"] for r in p.drop_near_copies(spark, docs, "").collect()}
    assert heads == {c for _, n, c in brute_components(rows, 5, 80)}
    mixed = p.mix_sources(spark, docs, "").groupBy("doc_id").count().collect()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixed} == copies


def test_whole_pipeline(spark, sf_dir):
    p = pytest.importorskip("corpus_pipeline")
    out = p.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    first = p.keep_good(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = first.select("doc_id").join(labels, "doc_id")
    assert kept.filter("quality = 0").count() <= 2 and kept.filter("quality = 1").count() >= 0.95 * labels.filter("quality = 1").count()


def test_line_oracle(spark, sf_dir):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = duckdb.sql(lines.ORACLE_SQL).fetchall()
    got = lines.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_lines", "n_deleted").collect()
    assert sorted(map(tuple, got)) == sorted(want)
