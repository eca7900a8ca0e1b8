"""Quality classifier: Naive Bayes support vectors.

A text's features are the indicators of its word unigrams and bigrams and of its
token-shape trigrams, hashed into a fixed table. Each indicator is scaled by its
log-count ratio between the classes, rows are brought to unit length, and a
linear model with hinge loss is fitted by dual coordinate descent. A logistic
curve fitted to cross-fitted margins turns the margin into a score.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.batches import few_rows
from voxloom.llm.labelled import TRAIN_ROWS, fold, training_rows

BITS = 18
#: Tokens a task remembers before it starts afresh.
REMEMBERED = 100_000
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]")
#: Tokens of a text whose features are made at a time; bounds the memory of a very long text.
PIECE = 200_000


class Tokens(dict):
    """token -> word hash and shape code, packed; a bounded memory.

    Shapes: 0 none, 1 lower case, 2 capitalised, 3 upper case, 4 mixed, 5 digits,
    6 the same token again, 8 and up a punctuation mark.
    """

    def __missing__(self, t: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        c = t[0]
        if 48 <= c <= 57:
            shape = 5
        elif len(t) == 1 and c < 128 and not t.isalpha():
            shape = 8 + c % 56
        else:
            s = t.decode("utf-8", "replace")
            shape = 1 if s.islower() else 3 if len(s) > 1 and s.isupper() else 2 if s[1:].islower() or len(s) == 1 else 4
        v = self[t] = (zlib.crc32(t.lower()) << 6) | shape
        return v


def features(text: bytes | None, known: Tokens) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text; a null or blank text has none."""
    tokens = TOKEN.findall(text) if text else []
    found = np.empty(0, np.int64)
    for a in range(0, len(tokens), PIECE):
        packed = np.fromiter(map(known.__getitem__, tokens[max(0, a - 2) : a + PIECE]), np.int64)
        word, shape = packed >> 6, packed & 63
        shape[1:][packed[1:] == packed[:-1]] = 6
        size = np.int64(1 << BITS)
        parts = [word % size]
        if len(word) > 1:
            parts.append(size + (word[:-1] * 40503 + word[1:] * 2654435761 >> 7) % size)
        if len(word) > 2:
            parts.append(2 * size + (shape[:-2] << 12) + (shape[1:-1] << 6) + shape[2:])
        found = np.union1d(found, np.concatenate(parts))
    return found


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    """log of the smoothed shares of each indicator among rows of class 1 and 0; 0 for what no row has."""
    p, q = np.full(size, alpha), np.full(size, alpha)
    for r, k in zip(rows, y):
        (p if k else q)[r] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    return np.where(p + q > 2 * alpha, ratio, 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, c: np.ndarray, epochs: int = 20, seed: int = 0) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + sum of c * hinge; the last place is the bias (an input of 1)."""
    w, a, rng = np.zeros(size + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    q = np.array([v @ v + 1 for v in values]) if rows else np.empty(0)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (values[i] @ w[rows[i]] + w[size]) - 1
            new = min(max(a[i] - g / q[i], 0.0), c[i])
            step = new - a[i]
            if step:
                w[rows[i]] += step * y[i] * values[i]
                w[size] += step * y[i]
                a[i], worst = new, max(worst, abs(step))
        if worst < 1e-3:
            break
    return w


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(1 | margin), by damped Newton steps on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum(), (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margins**2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


class QualityModel:
    """A fitted scorer: ``weights`` over the hashed indicators, already scaled; ``ratios`` for the row length."""

    def __init__(self, ratios, weights, bias, slope, intercept):
        self.ratios, self.weights, self.bias, self.slope, self.intercept = ratios.astype(np.float32), weights.astype(np.float32), bias, slope, intercept

    def score(self, feats: np.ndarray) -> float:
        r = self.ratios[feats].astype(np.float64)
        margin = float((r * self.weights[feats]).sum()) / max(float(np.sqrt((r * r).sum())), 1e-9) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.intercept, -30, 30))))


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 4.0, folds: int = 3) -> QualityModel:
    """Fit on feature sets and 0/1 labels. With one class alone the score is that class's smoothed share."""
    size = 3 << BITS
    if not len(y) or y.min() == y.max():
        share = (float(np.sum(y)) + 1) / (len(y) + 2)
        return QualityModel(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(share / (1 - share))))

    def train(ix):
        ratio = log_count_ratios([rows[i] for i in ix], y[ix], size)
        vals = [ratio[rows[i]] / max(np.linalg.norm(ratio[rows[i]]), 1e-9) for i in ix]
        each = np.where(y[ix] > 0, cost * len(ix) / (2 * max(1, y[ix].sum())), cost * len(ix) / (2 * max(1, (1 - y[ix]).sum())))
        return ratio, dual_coordinate_descent([rows[i] for i in ix], vals, np.where(y[ix] > 0, 1.0, -1.0), size, each)

    def margin(ratio, w, i):
        r = ratio[rows[i]]
        return (r @ w[rows[i]]) / max(np.linalg.norm(r), 1e-9) + w[size]

    at = np.arange(len(rows))
    crossed = np.zeros(len(rows))
    for k in range(folds):
        inside = at[at % folds != k]
        if y[inside].min() == y[inside].max():
            continue
        ratio, w = train(inside)
        for i in at[at % folds == k]:
            crossed[i] = margin(ratio, w, i)
    slope, intercept = _logistic(crossed, y)
    ratio, w = train(at)
    return QualityModel(ratio, w[:size], float(w[size]), slope, intercept)


def featurised(rows: DataFrame, text_col: str = "text", label: str = "y") -> DataFrame:
    """``(f, y)``: the feature numbers of each labelled text."""

    def run(batches):
        known = Tokens()
        for b in few_rows(batches):
            texts = b.column(0).cast(pa.binary()).to_pylist()
            f = pa.array([features(t, known).astype(np.int32) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([f, b.column(1)], names=["f", "y"])

    return rows.select(F.col(text_col).cast("string"), F.col(label).cast("int")).mapInArrow(run, "f array<int>, y int")


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, limit: int = TRAIN_ROWS) -> QualityModel:
    """Fit on at most ``limit`` labelled rows outside fold ``held_out``."""
    rows = featurised(training_rows(docs, labels, "quality", fold("doc_id", folds) != held_out, limit=limit)).toArrow()
    flat = [np.asarray(x.values, np.int64) if x.values is not None else np.empty(0, np.int64) for x in rows.column("f")]
    y = np.asarray(rows.column("y").to_pylist(), np.int64)
    order = sorted(range(len(y)), key=lambda i: (flat[i].tobytes(), y[i]))  # the order rows arrive in has no say
    return fit([flat[i] for i in order], y[order] if len(y) else y)


def score_texts(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with ``score_col``, from the whole text alone; null texts count as empty. A column of that name is replaced.

    Repeated rows and extra columns stay; an empty table gives an empty result.
    """

    def run(batches):
        known = Tokens()
        for b in few_rows(batches):
            texts = b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()
            s = pa.array([model.score(features(t, known)) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], s], names=[*b.schema.names[:-1], "score"])

    text, rest = F.col(text_col).cast("string").alias("scored"), [c for c in docs.columns if c != score_col]
    held = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], text)
    fields = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(rest))
    return held.mapInArrow(run, f"{fields}score double").toDF(*rest, score_col)
