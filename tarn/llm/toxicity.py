"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Tokens are words and their beginnings. A token's score is the log-odds of toxic against other documents under an
informative Dirichlet prior (pseudo-counts in the proportions of the next shorter beginning, those of the shortest
in the proportions of all documents), less a multiple of its standard deviation; a word takes the score of its
longest known token. Words without evidence cost a little each.
A linear-time scan (Ruzzo and Tompa) finds all maximal-scoring segments of a document; under chance the largest
score S of n words has P(S > s) = 1 - exp(-K n exp(-lambda s)). Every significant segment is reported, and the
document's score is calibrated on the summed and the largest evidence lambda S - log(K n).

Defined cases: a null text counts as empty and gets a score like any text; repeated rows are each scored; rows
without doc_id are scored with a null doc_id and held_out false; other columns are ignored; labels are used
outside the held-out fold only. Without labels of both classes every score is the mean label (0.5 with none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import _fit, _store, _text

#: Labelled rows that the model is fitted on at most.
MAX_TRAIN = 12_000
THRESHOLD = 0.5
#: Bytes of the beginnings of words that count as tokens, besides whole words.
PREFIXES = (3, 4, 5, 6, 8)
PRIOR, DEVIATIONS, COST = 5.0, 1.0, 0.05
#: Lower scores are no evidence.
LEAST_SCORE = 0.7
#: Remainder of crc32(doc_id as text) whose labelled documents calibrate instead of counting.
CALIBRATION = 1
#: Beginnings of tokens in fewer toxic documents can't score; tokens in fewer documents are unknown.
LEAST_TOXIC, LEAST_KNOWN = 4, 3
#: Share of calibrating clean documents, those with the highest scores, that chance statistics leave out: labels err.
TRIM = 0.02


def _heads(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first three bytes of each word as a number below 2**24."""
    code = np.zeros(len(first), np.int32)
    for k in range(3):
        has = first + k < last
        code = code * 256 + np.where(has, _text.FOLD_ASCII[data[np.minimum(first + k, len(data) - 1)]], 0)
    return code


def _tokens(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[np.ndarray]:
    """From the shortest beginning to the whole word; 0 where the word is no longer than the beginning."""
    for k in PREFIXES:
        longer = last - first > k
        out = np.zeros(len(first), np.uint64)
        out[longer] = _text.hash_spans(data, first[longer], first[longer] + k, _text.FOLD_ASCII) + np.uint64(k)
        yield out
    yield _text.hash_spans(data, first, last, _text.FOLD_ASCII)


@dataclass
class Model:
    heads: np.ndarray  # sorted three-byte beginnings of all scoring tokens
    tokens: np.ndarray  # sorted
    scores: np.ndarray
    decay: float = 1.0  # lambda
    scale: float = 1.0  # K
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    _table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def words(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words score above zero, and what."""
        if self._table is None:
            self._table = np.zeros(1 << 24, bool)
            self._table[self.heads] = True
        some = np.flatnonzero(self._table[_heads(data, first, last)]) if len(data) else np.zeros(0, np.int64)
        score = np.full(len(some), -1.0)
        for tokens in _tokens(data, first[some], last[some]):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            known = (self.tokens[at] == tokens) & (tokens != 0) if len(self.tokens) else np.zeros(len(some), bool)
            score[known] = self.scores[at[known]]
        return some[score > 0], score[score > 0]

    def evidence(self, segments: list[tuple[float, int, int]], n: int) -> list[float]:
        return [self.decay * s[0] - np.log(self.scale * max(n, 1)) for s in segments]

    def probability(self, segments: list[tuple[float, int, int]], n: int) -> float:
        return float(_fit.sigmoid(np.dot(self.weights, _features(self.evidence(segments, n)))))


def _features(evidence: list[float]) -> np.ndarray:
    significant = [e for e in evidence if e > 0]
    return np.array([max([0.0, *significant]), np.log1p(sum(significant)), float(bool(significant)), 1.0])


def segments(place: np.ndarray, score: np.ndarray, cost: float = COST) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first word, end), by Ruzzo and Tompa's scan; words between the places cost.

    Each candidate keeps a link to the last one before it that begins lower, which is where a search for such a one can
    go on: no candidate is passed twice on the way, and the scan is linear.
    """
    found: list[tuple[float, float, int, int, int]] = []  # cumulative score before, after, first, end, link
    total, end = 0.0, 0
    for p, s in zip(place.tolist(), score.tolist(), strict=True):
        total -= cost * (p - end)
        left, right, lo, hi = total, total + s, p, p + 1
        total, end = right, p + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                break
            left, lo, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
        found.append((left, right, lo, hi, j))
    return [(b - a, lo, hi) for a, b, lo, hi, _ in found]


def _scan(model: Model, column: pa.Array) -> Iterator[tuple[int, list[tuple[float, int, int]]]]:
    """Words and segments of each text."""
    for at, to, data, bounds in _text.chunks(column):
        first, last, doc = _text.spans(data, bounds, _text.ALNUM)
        size = np.bincount(doc, minlength=to - at)
        begin = np.cumsum(size) - size
        some, score = model.words(data, first, last)
        owner = doc[some]
        cuts = np.searchsorted(owner, np.arange(to - at + 1))
        for d in range(to - at):
            a, b = cuts[d], cuts[d + 1]
            yield int(size[d]), segments(some[a:b] - begin[d], score[a:b]) if b > a else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        label = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, to, data, bounds in _text.chunks(b.column(0)):
            first, last, doc = _text.spans(data, bounds, _text.ALNUM)
            if not len(first):
                continue
            head = _heads(data, first, last)
            parents = np.zeros(len(first), np.uint64)
            for level, tokens in enumerate(_tokens(data, first, last)):
                use = np.flatnonzero(tokens)
                once = use[np.unique(_text.pair(tokens[use], doc[use].astype(np.uint64)), return_index=True)[1]]
                unique, index, inverse = np.unique(tokens[once], return_index=True, return_inverse=True)
                n = np.bincount(inverse, minlength=len(unique))
                t = np.bincount(inverse, weights=label[at:to][doc[once]], minlength=len(unique)).astype(np.int64)
                first_of = once[index]
                columns = [head[first_of], np.full(len(unique), level, np.int32), unique.view(np.int64), parents[first_of].view(np.int64), t, n - t]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["head", "level", "token", "parent", "toxic", "other"])
                parents = np.where(tokens != 0, tokens, parents)


def log_odds(level: np.ndarray, token: np.ndarray, parent: np.ndarray, toxic: np.ndarray, other: np.ndarray, base: float) -> np.ndarray:
    """Log-odds of toxicity against those of all documents, each token's prior being its parent's rate; less DEVIATIONS of their standard deviation."""
    rate, score = np.full(len(token), base), np.zeros(len(token))
    order = np.argsort(token)
    for k in np.unique(level):
        own = np.flatnonzero(level == k)
        at = order[np.minimum(np.searchsorted(token, parent[own], sorter=order), len(token) - 1)]
        prior = np.where(token[at] == parent[own], rate[at], base)
        n = toxic[own] + other[own] + PRIOR
        rate[own] = np.clip((toxic[own] + PRIOR * prior) / n, 0.001, 0.999)
        score[own] = np.log(rate[own] / (1 - rate[own])) - np.log(base / (1 - base)) - DEVIATIONS * np.sqrt(1 / (toxic[own] + 1) + 1 / (other[own] + 1))
    return score


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model | float:
    """The model, or the mean label where a class has no rows."""
    spark = docs.sparkSession
    _store.ship(spark)
    own = _fit.labelled(docs, labels, "toxic", most)
    own = own.groupBy("text", "label").agg(F.min("doc_id").alias("doc_id"))  # copies are one observation, always of the same number
    sample = _store.written(own.select("text", "label", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(_fit.FOLDS)) == CALIBRATION).alias("later")))
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return float(next(iter(n), 0.5))
    base = n[1] / (n[0] + n[1])
    counting, calibrating = (sample.where(F.col("later") == x).select("text", "label") for x in (False, True))
    if calibrating.agg(F.countDistinct("label").alias("n")).first()["n"] < 2:
        counting = calibrating = sample.select("text", "label")
    counted = counting.mapInArrow(_count, "head int, level int, token bigint, parent bigint, toxic bigint, other bigint")
    total = counted.groupBy("token").agg(*(F.min(c).alias(c) for c in ("head", "level", "parent")), F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = _store.written(total.where(F.col("toxic") + F.col("other") >= LEAST_KNOWN))
    # Beginnings under which a token may score, and all known tokens with them: all bounded by the sample.
    heads = counts.where((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") >= 1.5 * base * (F.col("toxic") + F.col("other")))).select("head").distinct()
    rows = counts.join(F.broadcast(heads), "head", "left_semi").select("token", "parent", "head", "level", "toxic", "other").collect()
    got = np.array(rows, np.int64).reshape(-1, 6)
    got = got[np.argsort(got[:, 0].view(np.uint64) if len(got) else got[:, 0])]
    token = got[:, 0].copy().view(np.uint64)
    score = log_odds(got[:, 3], token, got[:, 1].copy().view(np.uint64), got[:, 4], got[:, 5], base)
    score[score < LEAST_SCORE] = -1.0
    scoring = np.unique(got[score > 0, 2])
    own = np.isin(got[:, 2], scoring)
    model = Model(scoring.astype(np.int32), token[own], score[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(size, [s for s, _, _ in found]) for size, found in _scan(model, b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64())), b.column(1)], names=["n", "segments", "label"])

    rows = sorted(tuple(r) for r in calibrating.mapInArrow(run, "n bigint, segments array<double>, label int").collect())
    size, label = np.array([r[0] for r in rows], float), np.array([r[2] for r in rows], float)
    top = np.array([max(r[1], default=0.0) for r in rows])
    clean = (label == 0) & (top <= np.quantile(top[label == 0], 1 - TRIM))
    # lambda solves E[exp(lambda s)] = 1 over the words of clean documents; K is the maximum-likelihood value given it.
    steps = np.array([s for r, c in zip(rows, clean, strict=True) if c for s in r[1]])
    words = max(1.0, size[clean].sum())
    excess = lambda x: (np.exp(np.minimum(x * steps, 50)).sum() + (words - len(steps)) * np.exp(-x * COST)) / words - 1
    lo, hi = 1e-3, 5.0
    if excess(hi) > 0:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    model.decay = hi if excess(lo) < 0 else lo
    model.scale = max(1e-6, clean.sum() / max(1e-9, (np.maximum(size[clean], 1) * np.exp(-model.decay * top[clean])).sum()))
    x = np.array([_features(model.evidence([(s, 0, 0) for s in r[1]], int(r[0])))[:-1] for r in rows])
    model.weights = _fit.logistic(x, label, ridge=0.1)
    return model


def find(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, threshold: float = THRESHOLD, passages: bool = True) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted and, if wanted, the significant segments (first word, end, score)."""
    model = fit(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, where = [], []
            column = b.column(2)
            for size, found in _scan(model, column) if isinstance(model, Model) else ((0, []) for _ in range(len(column))):
                score.append(model.probability(found, size) if isinstance(model, Model) else model)
                where.append([{"first": lo, "last": hi, "score": s} for (s, lo, hi), e in zip(found, model.evidence(found, size), strict=True) if e > 0] if passages and found else [])
            s = np.array(score, float)
            columns = [b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(where, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "segments"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _fit.held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, segments array<struct<first:bigint,last:bigint,score:double>>")


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    return find(docs, labels, most, threshold, passages=False).select("doc_id", "held_out", "score", "predicted")
