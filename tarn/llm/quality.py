"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text becomes a short vector of transformed statistics. The covariance of each class is shrunk towards the
pooled covariance and that towards its diagonal; Cholesky factors are computed once, when the model is fitted, and
sent along. The score comes from the difference of the classes' log densities (Mahalanobis distances and log
determinants) with log priors. It is calibrated to a probability on differences that each half of the sample gets from
a model of the other half.

Defined cases: a null text counts as empty and gets a score like any text; repeated rows are each scored; rows
without doc_id are scored with a null doc_id and held_out false; other columns are ignored; labels are used
outside the held-out fold only. Without labels of both classes every score is the mean label (0.5 with none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import _fit, _store, _text

#: Labelled rows that the model is fitted on at most.
MAX_TRAIN = 20_000
THRESHOLD = 0.3
#: Observations, words or characters, by which the shares of a short text are drawn to usual values.
WEIGHT = 20.0

_CLASSES = np.zeros((6, 256), np.float64)
_CLASSES[0, [*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1  # lower-case letters and parts of other characters
_CLASSES[1, 0x41:0x5B] = 1
_CLASSES[2, 0x30:0x3A] = 1
_CLASSES[3, [0x20, *range(0x09, 0x0E)]] = 1
_CLASSES[4, [ord(c) for c in ".,;:'\"()-?"]] = 1
_CLASSES[5] = _CLASSES[:5].sum(axis=0) == 0  # any other sign
NAMES = ["log_words", "word_bytes", "upper", "digits", "usual_marks", "other_signs", "distinct", "adjacent_repeats", "lines", "short_words", "bare_signs", "distinct_pairs"]


def statistics(column: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text."""
    out = []
    for at, to, data, bounds in _text.chunks(column):
        n = to - at
        ends = bounds[1:]
        first, last, doc = _text.spans(data, bounds, _text.NON_SPACE)
        words = np.bincount(doc, minlength=n).astype(float)
        kinds = np.empty((6, n))
        for k in range(6):
            sums = np.concatenate([[0], np.cumsum(_CLASSES[k].astype(np.int8)[data], dtype=np.int64)])
            kinds[k] = sums[ends] - sums[bounds[:-1]]
        newlines = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
        lines = newlines[ends] - newlines[bounds[:-1]]
        hashes = _text.hash_spans(data, first, last, _text.FOLD_ASCII)
        same = (doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1])
        repeats = np.bincount(doc[1:][same], minlength=n)

        def distinct(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
            both = np.unique(_text.pair(keys, owner.astype(np.uint64)), return_index=True)[1]
            return np.bincount(owner[both], minlength=n)  # noqa: B023

        pairs = _text.windows(hashes, 2)
        within = doc[: len(pairs)] == doc[1 : 1 + len(pairs)]
        size = last - first
        short = np.bincount(doc[size <= 3], minlength=n)
        signs = np.bincount(doc[_CLASSES[5].astype(bool)[data[last - 1]]] if len(last) else doc, minlength=n)
        chars = np.maximum(kinds.sum(axis=0) - kinds[3], 1)
        share = lambda x, of, usual: np.log((x + WEIGHT * usual) / (of + WEIGHT))
        out.append(
            np.column_stack(
                [
                    np.log1p(words), share(kinds.sum(axis=0) - kinds[3], words, 5.0), share(kinds[1], chars, 0.03), share(kinds[2], chars, 0.002), share(kinds[4], words, 0.2), share(kinds[5], words, 0.01),
                    np.log1p(distinct(hashes, doc)) - np.log1p(words), share(repeats, words, 0.01), share(lines, words, 0.02), share(short, words, 0.3), share(signs, words, 0.01), np.log1p(distinct(pairs[within], doc[: len(pairs)][within])) - np.log1p(words),
                ]
            )
        )
    return np.vstack(out) if out else np.zeros((0, len(NAMES)))


def _forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution z of factor z = b for a lower triangular factor, column by column of b."""
    z = np.empty_like(b, dtype=float)
    for i in range(len(factor)):
        z[i] = (b[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class Discriminant:
    """Means, Cholesky factors of the shrunken covariances and log priors of classes 0 and 1, and the calibration."""

    means: np.ndarray
    factors: list[np.ndarray]
    priors: np.ndarray
    calibration: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = 0.1, to_diagonal: float = 0.1) -> Discriminant:
        own = [np.cov(x[y == k].T, bias=True) if (y == k).sum() > 1 else np.zeros((x.shape[1],) * 2) for k in (0, 1)]
        pooled = sum(c * (y == k).sum() for k, c in enumerate(own)) / len(y)
        factors = []
        for c in own:
            c = (1 - to_pooled) * c + to_pooled * pooled
            c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + 1e-4 * np.eye(len(c))
            factors.append(np.linalg.cholesky(c))
        return Discriminant(np.array([x[y == k].mean(axis=0) for k in (0, 1)]), factors, np.log([(y == k).mean() for k in (0, 1)]), np.array([1.0, 0.0]))

    @staticmethod
    def calibrated(x: np.ndarray, y: np.ndarray) -> Discriminant:
        """Fitted on all rows; calibrated on rows that the model compared had not seen, where both halves have both classes."""
        model, half = Discriminant.fit(x, y), np.arange(len(y)) % 2
        d = model.difference(x)
        if all(len(np.unique(y[half == k])) == 2 for k in (0, 1)):
            for k in (0, 1):
                d[half == k] = Discriminant.fit(x[half != k], y[half != k]).difference(x[half == k])
        model.calibration = _fit.logistic(d[:, None], y, ridge=0.1)
        return model

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, tamed far from both."""
        log = []
        for mean, factor, prior in zip(self.means, self.factors, self.priors, strict=True):
            z = _forward(factor, (x - mean).T)
            log.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(axis=0))
        d = log[1] - log[0]
        return np.sign(d) * np.log1p(np.abs(d))

    def score(self, x: np.ndarray) -> np.ndarray:
        return _fit.sigmoid(self.difference(x) * self.calibration[0] + self.calibration[1])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Discriminant | float:
    """The model, or the mean label where a class has no rows."""
    _store.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], names=["x", "label"])

    rows = _fit.labelled(docs, labels, "quality", most).select("text", "label").mapInArrow(run, "x array<double>, label int").collect()
    y = np.array([r["label"] for r in rows], float)
    if not len(y):
        return 0.5
    if y.min() == y.max():
        return float(y.mean())
    x = np.array([r["x"] for r in rows])
    order = np.lexsort((*x.T, y))  # sums don't depend on the order in which rows came
    return Discriminant.calibrated(x[order], y[order])


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(2))
            s = model.score(x) if isinstance(model, Discriminant) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _fit.held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those scored below the threshold; all columns are kept."""
    model = fit(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(b.schema.get_field_index("text")).cast(pa.string()))
            s = model.score(x) if isinstance(model, Discriminant) else np.full(len(x), model)
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
