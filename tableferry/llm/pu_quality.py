"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear model by minimising the non-negative unbiased
risk: the positives' risk weighted by the class prior, plus the unlabelled text's risk as negatives less
that of the positives, held at zero or above. The class prior is estimated from the positives and the unlabelled text
as well, so no negative is ever asked for. Features come from the text alone.

Scores are calibrated so that their mean over the unlabelled sample is the class prior. Null and empty
texts have the features of an empty text and get a score. Training draws about ``MAX_POSITIVE`` and
``MAX_UNLABELLED`` rows, never twice as many, by a hash of their keys; scoring takes every row. Repeated rows get equal
scores. Without any positives every score is 0.5. Texts of any length are read
whole. Columns other than doc_id and text are never looked at, whatever their names. Tables without rows
give none.
"""

from __future__ import annotations

import dataclasses
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Bounds of the training sample: rows of labelled positives, and rows of unlabelled text.
MAX_POSITIVE, MAX_UNLABELLED = 8_000, 16_000
#: Rows of each half that a class prior is estimated from, at least, and the chance that a rate is further off.
LEAST_ROWS, DOUBT = 10, 0.1
#: Labels of one fold of so many are held out.
FOLDS = 5
#: Hashed word-form features besides the measures.
HASHED = 96
MEASURES = 21
WIDTH = MEASURES + HASHED

_word = re.compile(r"\S+")
_symbols = re.compile(r"[^\w\s.,;:!?'\"()-]")
_marks = re.compile(r"[.,;:!?]")
_digits = re.compile(r"[0-9]")
_ends = re.compile(r"[.!?]")


def features(text: str) -> np.ndarray:
    """Measures of form and repetition, and shares of hashed short words and word endings."""
    out = np.zeros(WIDTH, np.float32)
    words = text.split()
    n, chars = len(words), len(text)
    if n == 0:
        out[0] = 1.0
        return out
    low = [w.lower() for w in words]
    count = Counter(low)
    ranked = [c for _, c in count.most_common(5)]
    pairs = Counter(zip(low, low[1:], strict=False)) if n > 1 else Counter({("", ""): 1})
    lines = [x for x in text.split("\n") if x]
    line_count = Counter(lines)
    symbols, marks, digits, ends = (len(p.findall(text)) for p in (_symbols, _marks, _digits, _ends))
    capital = sum(w[0].isupper() for w in words)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    out[1:MEASURES] = (
        np.log1p(n) / 8,
        len(count) / n,
        ranked[0] / n,
        sum(ranked) / n,
        max(pairs.values()) / max(1, n - 1),
        len(pairs) / max(1, n - 1),
        lengths.mean() / 10,
        lengths.std() / 10,
        (lengths <= 3).mean(),
        (lengths >= 12).mean(),
        symbols / chars * 10,
        marks / n,
        digits / chars * 10,
        ends / n * 5,
        capital / n,
        sum(map(str.__eq__, low, low[1:])) / n,
        upper / n,
        np.log1p(n / max(1, len(lines))) / 6,
        1 - len(line_count) / max(1, len(lines)),
        np.log1p(n / max(1, ends)) / 6,
    )
    size = max(1, HASHED // 2)
    for w, c in count.items():
        form = w.strip(".,;:!?\"'()")
        if len(form) <= 4:
            out[MEASURES + zlib.crc32(form.encode("utf-8", "replace")) % size] += c / n
        else:
            out[MEASURES + size + zlib.crc32(form[-3:].encode("utf-8", "replace")) % (HASHED - size)] += c / n
    return out


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.stack([features(t or "") for t in texts]) if texts else np.zeros((0, WIDTH), np.float32)


@dataclasses.dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _loss(x: np.ndarray, sign: float, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
    """Mean logistic loss of x as the sign says, with its gradient."""
    z = sign * (x @ w + b)
    g = -sign / (1 + np.exp(np.clip(z, -30, 30))) / len(x)
    return float(np.logaddexp(0, -z).mean()), x.T @ g, float(g.sum())


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
    """Non-negative unbiased risk, and the step's direction by weights and bias: the gradient, or back on the
    negatives' risk where that is below zero."""
    l_p, gw_p, gb_p = _loss(positive, 1.0, w, b)
    l_n, gw_n, gb_n = _loss(positive, -1.0, w, b)
    l_u, gw_u, gb_u = _loss(unlabelled, -1.0, w, b)
    negative = l_u - prior * l_n
    if negative < 0:
        return prior * l_p, prior * gw_n - gw_u, prior * gb_n - gb_u
    return prior * l_p + negative, prior * gw_p + gw_u - prior * gw_n, prior * gb_p + gb_u - prior * gb_n


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 250, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Linear model of the least non-negative risk (logistic loss), by Adam over the whole sample."""
    if len(positive) == 0 or len(unlabelled) == 0:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), float(np.log(prior / (1 - prior))), prior)
    mean, scale = unlabelled.mean(0).astype(np.float64), unlabelled.std(0).astype(np.float64) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float64) for x in (positive, unlabelled))
    w, b = np.zeros(WIDTH), 0.0
    m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)

    for t in range(1, rounds + 1):
        _, gw, gb = risk(p, u, prior, w, b)
        g = np.append(gw + decay * w, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    low, high = -30.0, 30.0  # the shift at which the mean score of unlabelled text is the prior
    z = u @ w
    for _ in range(60):
        b = (low + high) / 2
        low, high = (b, high) if (1 / (1 + np.exp(-np.clip(z + b, -30, 30)))).mean() < prior else (low, b)
    return Model(mean, scale, w, b, prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from these two samples alone. A model of one half of each scores the
    other half. Above any threshold lie as many unlabelled rows as positives lie there, at the least: the share is no more
    than the ratio of both rates, and just that where no negatives score so high. Of all thresholds the one counts
    whose ratio is least with what chance may add. With fewer than LEAST_ROWS in any half, one half."""
    first, second = ([x[[zlib.crc32(r.tobytes()) % 2 == side for r in x]] for x in (positive, unlabelled)] for side in (0, 1))  # copies together
    if min(map(len, (*first, *second))) < LEAST_ROWS:
        return 0.5
    model = fit(*first, 0.5)
    p, u = (np.sort(model.scores(x)) for x in second)
    at = np.unique(p)
    of_p, of_u = (1 - np.searchsorted(x, at) / len(x) for x in (p, u))
    chance = sum(np.sqrt(np.log(4 / DOUBT) / (2 * len(x))) for x in (p, u))
    best = np.argmin((of_u + chance) / of_p)
    return float(np.clip(of_u[best] / of_p[best], 0.02, 0.98))


def held_out(key: Column) -> Column:
    """The fold that labels are never learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """Features of the rows; of ``2 * most`` of them at the most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in matrix(batch.column(0).to_pylist())], pa.binary())], names=["f"])

    got = rows.select("text").mapInArrow(run, "f binary").limit(2 * most).toArrow().column("f").to_pylist()
    return np.frombuffer(b"".join(got), np.float32).reshape(-1, WIDTH)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fits on the folds that are not held out. ``labels``: key and label (1 or 0)."""
    learn = docs.select(key, F.col(text).alias("text")).where(~held_out(F.col(key)))
    known = labels.select(key, F.col(label).alias("_label")).where(~held_out(F.col(key)) & F.col("_label").isNotNull())
    trusted = known.where("_label = 1").select(key).distinct()
    ones, n = trusted.count(), learn.count()

    def drawn(rows: DataFrame, of: int, most: int) -> DataFrame:
        """Each row with the chance that makes ``most`` of them expected, by a hash of its key."""
        share = min(1 << 20, (most << 20) // max(1, of))
        return rows.where(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 20)) < share)

    ids = drawn(trusted, ones, MAX_POSITIVE)
    positive = _sample(learn.join(F.broadcast(ids), key, "left_semi"), MAX_POSITIVE)  # as few ids as the bound
    unlabelled = _sample(drawn(learn, n, MAX_UNLABELLED), MAX_UNLABELLED)
    return fit(positive, unlabelled, class_prior(positive, unlabelled))


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score of 0 to 1. The model has a fixed size."""
    kept = [c for c in docs.columns if c != into]
    schema = docs.select(*kept).withColumn(into, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = matrix(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x).astype(np.float64), pa.float64())], names=[*batch.schema.names, into])

    return docs.select(*kept).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = scored(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
