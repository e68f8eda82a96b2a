"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins at quantiles of the training rows. Cyclic
boosting visits the features in turn and adds, each time, a small step of a
shallow tree (three leaves) fitted to the logistic gradients; since a tree of one feature is
a step function, each feature ends up with a lookup table by bin. Then the pairs whose
four-way splits explain most of what is left get two-way tables in the same manner. A
score is the sum of the looked-up numbers through the logistic function: numpy additions by
bin, no shuffle.

The model is fitted on a bounded sample of labelled rows: at most about `train_rows` by a hash of
doc_id, whose features (20 numbers a row) the driver collects. Labels are joined by id; the text is
the only input of a score.

Defined cases: null and empty texts have all-zero features and get a score like any
other; labels other than 0 and 1 and null ids are not learned from; several labels of
one id count as 1 where at least half are 1; without labelled rows, or with one class only, the
model is a constant. Extra columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, bounded_batches, ngram_ids, remainder, space_words, table, word_ids

TRAIN_ROWS = 20_000
BINS = 32
ROUNDS = 150
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.1
THRESHOLD = 0.7
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "punctuation", "exclamations",
    "pipes", "distinct_words", "top_word", "repeat_3", "repeat_2", "log_lines", "dup_lines", "line_words",
    "short_lines", "sentence_ends", "non_ascii", "ratio",
)


def features(text: str | None) -> np.ndarray:
    """The numbers of FEATURES for one whole text."""
    out = np.zeros(len(FEATURES))
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
    words = space_words(text) if raw else []
    if not words:
        return out
    n, size = len(words), len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    ids = word_ids(words)
    by_word = np.bincount(ids)
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    per_line = np.array([len(x.split()) for x in lines])
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    of = lambda chars: sum(int(counts[ord(c)]) for c in chars)

    def repeated(k: int) -> float:
        w = ngram_ids(ids, k)
        return 1 - len(np.unique(w)) / len(w) if len(w) else 0.0

    out[:] = (
        np.log1p(size), np.log1p(n), (size - n) / n, counts[65:91].sum() / max(1, letters), counts[48:58].sum() / size,
        of("#*$%&|<>") / n, of(".,;:?'\"-()") / n, of("!") / n, of("|") / n, len(by_word) / n,
        by_word.max() / n, repeated(3), repeated(2), np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(per_line.mean()),
        (per_line < 4).mean(), of(".?!") / n, counts[128:].sum() / size, len(zlib.compress(raw, 1)) / size,
    )
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1).astype(np.int16)


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values by bin of the best tree of up to three leaves (two splits in a row)."""

    def best(lo: int, hi: int) -> tuple[float, int]:
        gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(gl):
            return 0.0, -1
        gs, hs = g[lo:hi].sum(), h[lo:hi].sum()
        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
        k = int(np.argmax(gain))
        return float(gain[k]), lo + k + 1

    cuts = [0, len(g)]
    for _ in range(2):
        gain, at = max(best(a, b) for a, b in zip(cuts, cuts[1:]))
        if gain <= 1e-9:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_step(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The values by cell, and the gain, of the best tree of one cut in each direction."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gain = 0.0
    quarters = []
    for c in (cg, ch):
        row, col, all_ = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        a = c[:-1, :-1]
        quarters.append((a, row - a, col - a, all_ - row - col + a))
    if quarters[0][0].size == 0:
        return np.zeros_like(g), 0.0
    total = sum(q**2 / (w + 1) for q, w in zip(*quarters)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    i, j = np.unravel_index(int(np.argmax(total)), total.shape)
    gain = float(total[i, j])
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return out, gain


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pairs: int = PAIRS) -> dict:
    """Lookup tables by cyclic boosting. Deterministic: no row is drawn at random."""
    k = x.shape[1] if x.size else len(FEATURES)
    model = {"edges": [np.zeros(0)] * k, "tables": [np.zeros(1)] * k, "pairs": [], "bias": 0.0}
    if not len(y):
        return model
    rate = (y.sum() + 1) / (len(y) + 2)
    model["bias"] = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return model
    model["edges"] = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    b = binned(x, model["edges"])
    width = [len(e) + 1 for e in model["edges"]]
    model["tables"] = [np.zeros(w) for w in width]
    f = np.full(len(y), model["bias"])

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            g, h = slopes()
            step = RATE * _step(np.bincount(b[:, j], g, width[j]), np.bincount(b[:, j], h, width[j]))
            model["tables"][j] += step
            f += step[b[:, j]]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, size = b[:, i].astype(np.int64) * width[j] + b[:, j], width[i] * width[j]
        g, h = slopes()
        shape = (width[i], width[j])
        return at, np.bincount(at, g, size).reshape(shape), np.bincount(at, h, size).reshape(shape)

    ranked = sorted(((-_pair_step(*cells(i, j)[1:])[1], i, j) for i in range(k) for j in range(i)))[:pairs]
    chosen = [(i, j, np.zeros((width[i], width[j]))) for gain, i, j in ranked if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, values in chosen:
            at, g, h = cells(i, j)
            step = RATE * _pair_step(g, h)[0]
            values += step
            f += step.ravel()[at]
    model["pairs"] = chosen
    return model


def score(x: np.ndarray, model: dict) -> np.ndarray:
    """Vectorised bin additions."""
    if not len(x):
        return np.zeros(0)
    b = binned(x, model["edges"])
    f = np.full(len(x), model["bias"])
    for j, values in enumerate(model["tables"]):
        f += values[b[:, j]]
    for i, j, values in model["pairs"]:
        f += values[b[:, i], b[:, j]]
    return 1 / (1 + np.exp(-f))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
) -> dict:
    """Fit on at most about `train_rows` labelled rows, chosen by a hash of the id."""
    bounded_batches(docs.sparkSession)
    ids = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    ids = ids.groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_y"))
    share = min(1.0, train_rows / max(1, ids.count()))
    ids = ids.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # About train_rows ids of two numbers each: a proven bound for the broadcast.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id")
    got = rows.select("_y", features_of("_text").alias("x")).collect()
    x = np.array([np.frombuffer(r["x"], np.float64) for r in got]).reshape(-1, len(FEATURES))
    y = np.array([r["_y"] for r in got], float)
    order = np.lexsort([*x.T, y])  # rows come in any order; sums of floats do not forgive that
    return fit(x[order], y[order])


def features_of(text_col: str) -> Column:
    """The features as packed float64."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).tobytes())

    return packed(F.col(text_col))


def classify(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(score(np.array([features(t) for t in part]), shared.value))

    out = docs.drop("score", "predicted").withColumn("score", scored(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(remainder(id_col, 4) == 2, F.lit(True))


def production_model(spark, sf_dir: str) -> dict:
    """Learned from the labelled documents that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return train(docs.where(~held_out()), labels.where(~held_out()))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, production_model(spark, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
