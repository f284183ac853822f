"""Small document tables with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark long, n long, copies long, source_size double"
WORDS = [f"w{k}" for k in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, sources=None):
    """Rows with columns whose names the operators use inside."""
    rows = [(i, t, "en", (sources or ["a", "b"])[k % len(sources or [1, 2])], None if t is None else len(t), 1, 2, 3, 4.0) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward():
    """Nulls, empty and white-space texts, ties, repeated rows, one very long text."""
    rng = random.Random(0)
    base = prose(rng, 60)
    return [(1, base), (1, base), (2, base), (None, base), (3, None), (4, ""), (5, " \n\t "), (6, "x"), (7, prose(rng, 30000)), (8, base + " tail"), (9, "Aé\U0001f600 one two"), (None, None)]
