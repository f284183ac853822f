"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_rows, mix, sliced, staged, text_or_empty, windows_of

#: Trusted positive rows that the fit uses at most; unlabelled text is summed up over all rows.
FIT_ROWS = 20000
#: Regions of unlabelled rows, each of which one of its rows stands for, weighted by its share.
POINTS = 2048
EPOCHS = 400
PUNCTUATION = "#*$%&|<>!?.,;:"
N_FEATURES = 34
SLICE = 500

_BYTES = np.arange(256)
IS_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
IS_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
IS_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
IS_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
IS_LETTER = IS_UPPER | IS_LOWER | (_BYTES >= 128)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each owner has."""
    _, first = np.unique(mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(owner[first], minlength=n)


def text_features(texts: list[str]) -> np.ndarray:
    """Numbers about form only, a row for each whole text: bytes by class, words, lines and repeats.

    Worked out over the joined bytes of all texts at once; zeros for a text
    without words.
    """
    n = len(texts)
    raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=n)
    owner = np.repeat(np.arange(n), sizes)
    table = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    space = IS_SPACE[data]
    edges = np.diff(np.concatenate(([1], space.view(np.int8))))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return np.zeros((n, N_FEATURES))
    ends = ends[ends > starts[0]]
    of = owner[starts]
    count = lambda mask: np.bincount(of[mask], minlength=n).astype(np.float64)
    total = lambda values: np.bincount(of, weights=values, minlength=n)
    words = np.bincount(of, minlength=n).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    within = lambda flags: (c := np.concatenate(([0], np.cumsum(flags[data], dtype=np.int64))))[ends] - c[starts]
    upper, lower, digit = within(IS_UPPER), within(IS_LOWER), within(IS_DIGIT)
    mean = ratio(total(length), words)
    spread = np.sqrt(np.maximum(0, ratio(total(length**2), words) - mean**2))

    # word hashes: a polynomial over the bytes, moved to position 0
    step = np.uint64(0x9E3779B97F4A7C15 | 1)
    back = np.uint64(pow(int(step), -1, 1 << 64))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data) - 1, step, dtype=np.uint64))))
        undo = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data) - 1, back, dtype=np.uint64))))
        sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)))
        hashes = mix((sums[ends] - sums[starts]) * undo[starts])
    grams, gram_owner = windows_of(hashes, words.astype(np.int64), 4)

    newline = np.flatnonzero(data == 10)
    before = data[np.maximum(newline - 1, 0)]
    line_owner = owner[newline]
    lines = np.bincount(line_owner, minlength=n).astype(np.float64)
    ended = np.bincount(line_owner[np.isin(before, list(b".!?"))], minlength=n)
    different = np.array([len(set(t.split("\n"))) for t in texts], dtype=np.float64)
    marks = table[:, [ord(c) for c in PUNCTUATION]]
    size = sizes.astype(np.float64) - 1
    out = np.column_stack([
        np.log1p(words), np.log1p(lines), ratio(words, lines) / 50, mean / 10, spread / 10, ratio(table[:, IS_LETTER].sum(1), size), ratio(count((upper > 0) & (lower == 0) & (length > 1)), words),
        np.minimum(10, marks / np.maximum(words, 1)[:, None]), (marks[:, :8] > 0).mean(1), ratio(ended, lines), ratio(distinct(of, hashes, n), words), ratio(distinct(gram_owner, grams, n), np.bincount(gram_owner, minlength=n)),
        ratio(different, lines), ratio(size, lines) / 500, ratio(count(digit == length), words), ratio(count(length <= 3), words), ratio(count(length > 12), words), ratio(count(IS_UPPER[data[starts]]), words),
        np.minimum(1, words / 20), np.minimum(1, words / 100), words < 10,
    ])
    out[words == 0] = 0
    return out.astype(np.float32)


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, features of every row; zeros for a text without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sliced(batches, SLICE):
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "features": list(text_features(part["text"].tolist()))})

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, "doc_id long, features array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    second: np.ndarray
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.maximum(np.c_[h, np.ones(len(h))] @ self.first, 0)
        return np.c_[h, np.ones(len(h))] @ self.second

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, weights: np.ndarray, prior: float, epochs: int = EPOCHS, hidden: int = 24, seed: int = 7, signed: bool = True) -> Model:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss.

    Where the negative part falls below zero, the step goes the other way on
    that part alone, as the non-negative estimator asks for.  Unlabelled points
    count by their weights, which add up to 1.  Not ``signed``, positives are only told from
    unlabelled points: R_p(+) + R_u(-).
    """
    rng = np.random.default_rng(seed)
    mean = weights @ unlabelled
    scale = np.sqrt(weights @ (unlabelled - mean) ** 2) + 1e-6
    prepare = lambda x: np.c_[np.clip((x - mean) / scale, -6, 6), np.ones(len(x))]
    xp, xu = prepare(positive), prepare(unlabelled)
    even = np.full(len(xp), 1 / len(xp))
    w1 = rng.normal(0, 1 / np.sqrt(xp.shape[1]), (xp.shape[1], hidden))
    w2 = rng.normal(0, 1 / np.sqrt(hidden), hidden + 1)
    moments = [np.zeros_like(w1), np.zeros_like(w1), np.zeros_like(w2), np.zeros_like(w2)]

    def gradient(x: np.ndarray, weight: np.ndarray, sign: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean logistic loss with all labels ``sign``, and its gradients."""
        h = x @ w1
        a = np.c_[np.maximum(h, 0), np.ones(len(x))]
        z = sign * (a @ w2)
        dz = -sign * sigmoid(-z) * weight
        return float(np.logaddexp(0, -z) @ weight), x.T @ (np.outer(dz, w2[:-1]) * (h > 0)), a.T @ dz

    for t in range(1, epochs + 1):
        pos, unl_neg = gradient(xp, even, 1.0), gradient(xu, weights, -1.0)
        if signed:
            pos_neg = gradient(xp, even, -1.0)
            if unl_neg[0] >= prior * pos_neg[0]:
                g = [prior * p + u - prior * n for p, u, n in zip(pos[1:], unl_neg[1:], pos_neg[1:])]
            else:
                g = [prior * n - u for u, n in zip(unl_neg[1:], pos_neg[1:])]
        else:
            g = [p + u for p, u in zip(pos[1:], unl_neg[1:])]
        for k, (w, d) in enumerate(((w1, g[0] + 1e-4 * w1), (w2, g[1] + 1e-4 * w2))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * d
            moments[2 * k + 1] = 0.999 * moments[2 * k + 1] + 0.001 * d * d
            w -= 0.02 * (moments[2 * k] / (1 - 0.9**t)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w1, w2, prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, weights: np.ndarray, rows: float, seed: int = 11) -> float:
    """Share of positives in unlabelled text, from trusted positives and unlabelled text alone.

    A network tells half of the positives from half of the unlabelled points;
    the others are scored.  Among those scored highest nearly all are positive, so that the share of
    unlabelled text above a threshold is the prior times the share of positives
    above it.  The threshold is where the upper confidence bound of that ratio
    is least.  The halves then change places, and the mean is taken.  ``rows`` is
    the number of unlabelled rows that the points stand for.
    """
    rng = np.random.default_rng(seed)
    half = lambda n: np.array_split(rng.permutation(n), 2) if n > 1 else [np.arange(n)] * 2
    (p0, p1), (u0, u1) = half(len(positive)), half(len(unlabelled))
    found = []
    for p_learn, p_rest, u_learn, u_rest in ((p0, p1, u0, u1), (p1, p0, u1, u0)):
        model = fit(positive[p_learn], unlabelled[u_learn], weights[u_learn] / weights[u_learn].sum(), 0.5, epochs=EPOCHS // 4, seed=seed, signed=False)
        p, u, w = np.sort(model.score(positive[p_rest])), model.score(unlabelled[u_rest]), weights[u_rest] / weights[u_rest].sum()
        at = np.argsort(u)
        above = np.append(np.cumsum(w[at][::-1])[::-1], 0.0)  # share of unlabelled text with at least this score
        cuts = np.quantile(p, np.linspace(0, 0.99, 100))
        q_p = 1 - np.searchsorted(p, cuts) / len(p)
        q_u = above[np.searchsorted(u[at], cuts)]
        slack = np.sqrt(np.log(40) / (2 * len(p))) + np.sqrt(np.log(40) / (2 * max(rows / 2, 1)))
        best = int(np.argmin((q_u + slack) / np.maximum(q_p, 1e-9)))
        found.append(q_u[best] / q_p[best])
    return float(np.clip(np.mean(found), 0.02, 0.98))


def weighted_points(features: DataFrame, points: int = POINTS) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows that stand for all, their weights, and how many rows there are.

    A few drawn rows part all rows into regions by the nearest of them; a random
    member of each region, the one with the least hash, stands for it with the
    region's share of all rows as its weight, so that weighted sums over
    the members have the mean of those over all rows.  What reaches the driver is bounded by ``points``.
    """
    rows = features.select("doc_id", "features", F.xxhash64("doc_id", "features").alias("h"))
    drawn = rows.orderBy("h", "features").limit(points).select("features").toPandas()
    if not len(drawn):
        return np.empty((0, N_FEATURES)), np.empty(0), 0
    centres = np.unique(np.array(drawn["features"].tolist(), dtype=np.float64), axis=0)
    middle, scale = centres.mean(0), np.where(centres.std(0) > 1e-6, centres.std(0), 1.0)
    near = ((centres - middle) / scale).astype(np.float32)
    offset = (near**2).sum(1) / 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, least, member = np.zeros(len(near), dtype=np.int64), np.full(len(near), np.iinfo(np.int64).max), np.zeros((len(near), N_FEATURES))
        for part in sliced(batches, SLICE):
            x, h = np.array(part["features"].tolist(), dtype=np.float64).reshape(-1, N_FEATURES), part["other"].to_numpy()
            at = np.argmax(((x - middle) / scale).astype(np.float32) @ near.T - offset, axis=1)
            np.add.at(n, at, 1)
            order = np.lexsort((h, at))
            first = order[np.unique(at[order], return_index=True)[1]]
            first = first[h[first] <= least[at[first]]]
            least[at[first]], member[at[first]] = h[first], x[first]
        some = np.flatnonzero(n)
        yield pd.DataFrame({"point": some, "n": n[some], "h": least[some], "member": list(member[some])})

    other = F.xxhash64("doc_id", "features", F.lit(1)).alias("other")  # not the hash that drew the centres
    each = rows.select("features", other).mapInPandas(run, "point int, n long, h long, member array<double>")
    total = each.groupBy("point").agg(F.sum("n").alias("n"), F.min(F.struct("h", "member"))["member"].alias("member")).orderBy("point").toPandas()
    n = total["n"].to_numpy(dtype=np.float64)
    return np.array(total["member"].tolist()), n / n.sum(), int(n.sum())


def train(features: DataFrame, positives: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Fit on the rows of ``features`` whose doc_id is in ``positives``, and on all of ``features`` as unlabelled text.

    At most ``fit_rows`` positives, those with the smallest hash of their id.
    The class prior comes from ``estimate_prior``; negative labels are never
    used.  None if there is no positive row.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = positives.select("doc_id").distinct()
    marked = features.join(known, "doc_id").orderBy(*order, "features").limit(fit_rows).select("features").toPandas()
    if not len(marked):
        return None
    x = np.array(marked["features"].tolist(), dtype=np.float64)
    unlabelled, weights, rows = weighted_points(features)
    prior = estimate_prior(x, unlabelled, weights, rows)
    # too large a prior lets all text be positive, one that is a little too small does no harm: a standard error less
    return fit(x, unlabelled, weights, max(0.02, prior - np.sqrt(prior * (1 - prior) / len(x))))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(column).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def learn(features: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """The model of rows that are not held out; a document with both labels is no trusted positive."""
    known = labels.filter(F.col("quality").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("least"))
    return train(features.filter(~held_out()), known.filter("least = 1"), fit_rows)


SCHEMA = "doc_id long, score double"


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    ``labels`` has doc_id and quality (1: trusted positive).  Rows whose crc32 of
    the id modulo 3 is 1 are held out: neither their labels nor their texts
    are learnt from.  The score sees the text alone; null is empty.  Without any
    trusted positive every score is 0.5.  Null ids are scored but not learnt from.
    """
    features = staged(document_features(docs, id_col, text_col), "features")
    model = learn(features, labels, fit_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["features"].tolist(), dtype=np.float64).reshape(-1, N_FEATURES)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.score(x) if model else np.full(len(x), 0.5)})

    scored = map_rows(features, run, SCHEMA)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``; see ``score_quality``."""
    model = learn(staged(document_features(docs, id_col, text_col), "features"), labels, fit_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sliced(batches, SLICE):
            if model is None:
                yield part
            else:
                yield part[model.score(text_features(["" if t is None else t for t in part[text_col]]).astype(np.float64)) >= least]

    whole = [f.name for f in docs.schema if f.dataType.typeName() in ("long", "integer", "short", "byte")]  # pandas has no nulls in these
    out = docs.withColumns({c: F.col(c).cast("string") for c in whole})
    out = out.mapInPandas(run, out.schema)
    return out.withColumns({c: F.col(c).cast(docs.schema[c].dataType) for c in whole})
