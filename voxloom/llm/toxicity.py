"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the vectors of its own hash and of the hashes of its
beginnings. Filters of several widths slide over the words, each filter keeps its
largest response (max pooling) and a logistic layer weighs them. Training steps
only touch the windows that won the pooling. A flag per language uses a
threshold calibrated on cross-fitted scores of that language's training rows; the score
itself sees nothing but the text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.batches import few_rows
from voxloom.llm.labelled import TRAIN_ROWS, fold, training_rows

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
#: Lengths of a word's beginnings that have vectors of their own.
PREFIXES, REMEMBERED = (3, 4, 5, 7), 100_000
PARTS = 1 + len(PREFIXES)
PADDING = PARTS * BUCKETS
#: Words whose responses are computed at a time; bounds the memory of a very long text.
PIECE = 1 << 15
#: Letters without case, digits and all that is not ASCII make words.
TABLE = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
DEFAULT_THRESHOLD = 0.7
#: Flags by language: recall counts half as much as precision, as clean documents are by far the most; a gain below
#: FLAG_GAIN is one row or two and moves no threshold.
FLAG_BETA, FLAG_GAIN = 0.5, 0.005


def word_parts(word: bytes) -> list[int]:
    """Bucket numbers of a word and of its beginnings; the padding row where it is no longer than a beginning."""
    text = word.decode("utf-8", "replace")
    starts = [zlib.crc32(text[:k].encode("utf-8"), k) % BUCKETS + (i + 1) * BUCKETS if len(text) > k else PADDING for i, k in enumerate(PREFIXES)]
    return [zlib.crc32(word) % BUCKETS, *starts]


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text in lower case; null and wordless texts have none."""
    return text.lower().encode("utf-8", "replace").translate(TABLE).split() if text else []


class WordVectors(dict):
    """word -> row of ``table``, which holds the summed vectors; a bounded memory."""

    def __init__(self, embeddings: np.ndarray):
        self.embeddings = embeddings
        self.table = np.zeros((1024, DIM), np.float32)

    def __missing__(self, word: bytes) -> int:
        if len(self) == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        i = self[word] = len(self)
        self.table[i] = self.embeddings[word_parts(word)].sum(axis=0)
        return i

    def vectors(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= REMEMBERED:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.table[rows]


class ToxicityModel:
    """Embeddings (the last row is padding), filters by width, output layer, thresholds by language."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.e = (rng.normal(size=(PADDING + 1, DIM)) * 0.1).astype(np.float32)
        self.e[-1] = 0
        self.k = [(rng.normal(size=(w, DIM, FILTERS)) * np.sqrt(2 / (w * DIM))).astype(np.float32) for w in WIDTHS]
        self.kb = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = (rng.normal(size=len(WIDTHS) * FILTERS) * 0.1).astype(np.float32)
        self.bias = np.float32(0)
        self.slope, self.intercept = 1.0, 0.0
        self.thresholds: dict[str, float] = {}

    def pooled(self, vectors, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of every filter over ``n`` words, and where it was.

        ``vectors(a, z)`` gives the vectors of words a to z; zeros stand after the last.
        """
        best = np.full((len(WIDTHS), FILTERS), -np.inf, self.e.dtype)
        where = np.zeros((len(WIDTHS), FILTERS), np.int64)
        every, more = np.concatenate([k[j].T for k in self.k for j in range(len(k))]), max(WIDTHS) - 1
        for a in range(0, max(n, 1), PIECE):
            m = min(PIECE, max(n, 1) - a)
            x = np.zeros((m + more, DIM), self.e.dtype)
            z = min(n, a + m + more)
            if z > a:
                x[: z - a] = vectors(a, z)
            y, c = every @ x.T, 0  # a row of responses for each filter and place in it
            for w, width in enumerate(WIDTHS):
                r = y[c : c + FILTERS, :m]
                for j in range(1, width):
                    r = r + y[c + j * FILTERS : c + (j + 1) * FILTERS, j : j + m]
                c += width * FILTERS
                at = r.argmax(axis=1)
                top = r[np.arange(FILTERS), at]
                up = top > best[w]
                best[w, up], where[w, up] = top[up], at[up] + a
        return np.maximum(best + self.kb, 0), where

    def logit(self, parts: np.ndarray) -> float:
        """Of a text given as (n, PARTS) bucket numbers."""
        p, _ = self.pooled(lambda a, z: self.e[parts[a:z]].sum(axis=1), len(parts))
        return float(p.ravel() @ self.out + self.bias)

    def probability(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit + self.intercept, -30, 30))))

    def score(self, text: str | None, known: WordVectors) -> float:
        words = words_of(text)
        p, _ = self.pooled(lambda a, z: known.vectors(words[a:z]), len(words))
        return self.probability(float(p.ravel() @ self.out + self.bias))

    def gradients(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray):
        """Of the sum of weight * log loss: (touched embedding rows, their gradients), filters, filter biases, output layer, bias."""
        touched, grads = [], []
        gk, gkb, go, gb = [np.zeros_like(k) for k in self.k], np.zeros_like(self.kb), np.zeros_like(self.out), 0.0
        for parts, t, each in zip(texts, y, weight):
            p, where = self.pooled(lambda u, v, parts=parts: self.e[parts[u:v]].sum(axis=1), len(parts))
            d = each * (1 / (1 + np.exp(-np.clip(p.ravel() @ self.out + self.bias, -30, 30))) - t)
            go += d * p.ravel()
            gb += d
            back = np.where(p > 0, d * self.out.reshape(p.shape), 0)
            gkb += back
            padded = np.concatenate([parts, np.full((max(WIDTHS), PARTS), PADDING)])
            for w, width in enumerate(WIDTHS):
                live = np.nonzero(back[w])[0]
                for j in range(width):
                    rows = padded[where[w, live] + j]
                    gk[w][j][:, live] += (self.e[rows].sum(axis=1) * back[w, live, None]).T
                    touched.append(rows)
                    grads.append(back[w, live, None] * self.k[w][j][:, live].T)
        rows, g = np.concatenate(touched), np.concatenate(grads)
        flat = rows.ravel()
        by = np.argsort(flat, kind="stable")
        begin = np.nonzero(np.diff(flat[by], prepend=-1))[0]
        at = flat[by[begin]]
        ge = np.add.reduceat(g[by // PARTS], begin, axis=0) if len(begin) else g
        return (at[at != PADDING], ge[at != PADDING]), gk, gkb, go, gb

    def train(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = 4, rate: float = 0.05, batch: int = 16, seed: int = 1) -> None:
        """AdaGrad on the log loss, classes weighted to equal sums."""
        rng = np.random.default_rng(seed)
        weight = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
        sums, ksums, bsum = [np.full_like(v, 1e-2) for v in (self.e, self.out, self.kb)], [np.full_like(k, 1e-2) for k in self.k], 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                (at, ge), gk, gkb, go, gb = self.gradients([texts[i] for i in some], y[some], weight[some] / batch)
                sums[0][at] += ge * ge
                self.e[at] -= rate * ge / np.sqrt(sums[0][at])
                for k, gr, s in zip(self.k, gk, ksums):
                    s += gr * gr
                    k -= rate * gr / np.sqrt(s)
                for v, gr, s in ((self.out, go, sums[1]), (self.kb, gkb, sums[2])):
                    s += gr * gr
                    v -= rate * gr / np.sqrt(s)
                bsum += gb * gb
                self.bias = np.float32(self.bias - rate * gb / np.sqrt(bsum))


def _best_threshold(scores: np.ndarray, y: np.ndarray, beta: float = 1.0, near: float | None = None) -> float:
    """The threshold with the largest F-measure (recall counts ``beta`` times as much as precision), in the middle of its gap.

    With ``near``, that value itself unless another is better by more than FLAG_GAIN.
    """
    cut_at = np.unique(np.concatenate([scores, [0.0, 1.0]]))
    mids = (cut_at[1:] + cut_at[:-1]) / 2
    measure = lambda m: (1 + beta * beta) * (y[scores >= m].sum()) / max(1, (scores >= m).sum() + beta * beta * y.sum())
    f = [measure(m) for m in mids]
    if near is not None and measure(near) >= max(f) - FLAG_GAIN:
        return near
    return float(mids[int(np.argmax(f))])


def fit(texts: list[np.ndarray], y: np.ndarray, langs: list[str | None], epochs: int = 4, folds: int = 3, least: int = 20) -> ToxicityModel:
    """Train on all rows; scale the score and calibrate each language's threshold on cross-fitted scores of all rows.

    A row's cross-fitted score comes from a model of the other ``folds - 1`` parts of
    the rows. The score is scaled so that the best single threshold on these is
    DEFAULT_THRESHOLD. A language with fewer than ``least`` rows or no toxic one among
    them keeps the default threshold. With one class alone the score is its smoothed share.
    """
    from voxloom.llm.quality import _logistic

    model = ToxicityModel()
    if not len(y) or y.min() == y.max():
        share = (float(np.sum(y)) + 1) / (len(y) + 2)
        model.slope, model.intercept = 0.0, float(np.log(share / (1 - share)))
        return model
    model.train(texts, y, epochs)
    part = np.empty(len(y), np.int64)  # both classes are dealt out evenly
    for c in (0, 1):
        part[y == c] = np.arange((y == c).sum()) % folds
    logits = np.empty(len(y))
    for k in range(folds):
        inside, outside = np.nonzero(part != k)[0], np.nonzero(part == k)[0]
        other = model
        if y[inside].min() != y[inside].max():
            other = ToxicityModel()
            other.train([texts[i] for i in inside], y[inside], epochs)
        logits[outside] = [other.logit(texts[i]) for i in outside]
    slope, _ = _logistic(logits, y)
    best = np.clip(_best_threshold(1 / (1 + np.exp(-np.clip(logits, -30, 30))), y), 1e-9, 1 - 1e-9)
    model.slope = max(slope, 0.1)
    model.intercept = float(np.log(DEFAULT_THRESHOLD / (1 - DEFAULT_THRESHOLD)) - model.slope * np.log(best / (1 - best)))
    scores = np.array([model.probability(v) for v in logits])
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if own.sum() >= least and y[own].any():
            model.thresholds[lang] = _best_threshold(scores[own], y[own], FLAG_BETA, DEFAULT_THRESHOLD)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, limit: int = TRAIN_ROWS, lang_col: str = "lang") -> ToxicityModel:
    """Fit on at most ``limit`` labelled rows outside fold ``held_out``; languages serve the thresholds alone."""
    rows = training_rows(docs, labels, "toxic", fold("doc_id", folds) != held_out, limit=limit)

    def run(batches):
        for b in few_rows(batches):
            ids = pa.array([np.array([word_parts(w) for w in words_of(t)], np.int32).ravel() for t in b.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, b.column(1), b.column(2)], names=["ids", "lang", "y"])

    table = rows.select(F.col("text").cast("string"), F.col(lang_col).cast("string"), "y").mapInArrow(run, "ids array<int>, lang string, y int").toArrow()
    texts = [np.asarray(x.values, np.int64).reshape(-1, PARTS) for x in table.column("ids")]
    y, langs = np.asarray(table.column("y").to_pylist(), np.int64), table.column("lang").to_pylist()
    order = sorted(range(len(y)), key=lambda i: (zlib.crc32(texts[i].tobytes()), texts[i].tobytes(), y[i]))
    return fit([texts[i] for i in order], y[order] if len(y) else y, [langs[i] for i in order])


def score_texts(docs: DataFrame, model: ToxicityModel, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1, of the whole text) and ``flagged`` (by the language's threshold).

    Null, empty and wordless texts are scored as no words at all; a null or unknown
    language has the default threshold; repeated rows and extra columns stay, columns of
    the two names are replaced; an empty table gives an empty result.
    """

    def run(batches):
        known = WordVectors(model.e)
        for b in few_rows(batches):
            s = pa.array([model.score(t, known) for t in b.column(b.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], s], names=[*b.schema.names[:-1], "s"])

    rest = [c for c in docs.columns if c not in ("toxicity", "flagged")]
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    held = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], lang.alias("l"), F.col(text_col).cast("string").alias("scored"))
    fields = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(rest))
    limit = F.lit(DEFAULT_THRESHOLD)
    for name, t in model.thresholds.items():
        limit = F.when(F.col("l") == name, F.lit(t)).otherwise(limit)
    out = held.mapInArrow(run, f"{fields}l string, s double")
    return out.select(*[f"c{i}" for i in range(len(rest))], "s", (F.col("s") >= limit).alias("flagged")).toDF(*rest, "toxicity", "flagged")
