"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors become integers; a block of candidates is kept as postings by term (dimension): the places of candidates whose
component isn't zero, and the components. Query rows come in batches of bounded size; one batch at a time is on the
driver and broadcast, and its results are written before the next. For each term of a query its weight times the
term's postings is scattered into a dense array of scores, one for each candidate of the block; a partition selection
takes the best of the block, and running bests are merged from block to block and, at last, across tasks.

Sums are taken in 32 bits, 64 bits or unbounded integers, whichever the largest components of a block need, so that
all scores are exact.

Defined cases: vectors that are null, or hold null or non-finite components (also after scaling), take no part, nor
do rows without vec_id; a score that no long can hold ranks by its exact value and is reported as the nearest long; a
shorter vector is zero beyond its length; repeated rows are candidates each, and queries each; a query's own vec_id is
no candidate of it; other columns are ignored; ties go to the smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.llm import _store

K, SCALE, EVERY = 20, 64, 20
#: Bound of the queries that are broadcast at once.
QUERIES_PER_PASS = 20_000
BLOCK, STRIP = 4096, 64
_LONG = (1 << 63) - 1
_FOUND = "query bigint, query_id bigint, vec_id bigint, score bigint, beyond string"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the scaled vector, whose floors are the integers, of the rows that take part."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * scale).alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Floors of a list column's rows as a matrix of doubles, filled up with zeros or cut to the width."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(column), width))
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(column)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    use = place < width
    out[row[use], place[use]] = flat[use]
    return out


def _integers(values: np.ndarray, kind: type) -> np.ndarray:
    return values.astype(kind) if kind is not object else np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def _as_long(score: int) -> tuple[int, str | None]:
    """The nearest long and, where that isn't the score, a text that sorts as the scores do."""
    if -_LONG - 1 <= score <= _LONG:
        return score, None
    digits = str(abs(score))
    if score > 0:
        return _LONG, f"{len(digits):05d}{digits}"
    return -_LONG - 1, f"{99999 - len(digits):05d}" + "".join(str(9 - int(c)) for c in digits)


class _Best:
    """The best k candidates of each query so far."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, k: int):
        self.ids, self.weights, self.k = ids, weights, k
        self.largest = float(np.abs(weights).max(initial=0))
        self.score = np.zeros((len(ids), 0), np.int64)
        self.found = np.zeros((len(ids), 0), np.int64)
        self.valid = np.zeros((len(ids), 0), bool)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, columns = ids[order], np.ascontiguousarray(vectors[order].T)
        n, k = len(ids), min(self.k, len(ids))
        bound = self.largest * float(np.abs(columns).max(initial=0)) * max(1, len(columns))
        kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 62 else object
        weights, postings = _integers(self.weights, kind), []
        for t, column in enumerate(columns):
            places = np.flatnonzero(column)
            if len(places) > n // 8:  # a long list is cheaper to add with its gaps
                postings.append((t, slice(None), _integers(column, kind)))
            elif len(places):
                postings.append((t, places, _integers(column[places], kind)))
        top_score = np.zeros((len(self.ids), k), object if kind is object else np.int64)
        top_id, top_valid = np.zeros((len(self.ids), k), np.int64), np.zeros((len(self.ids), k), bool)
        lo, hi = np.searchsorted(ids, self.ids, "left"), np.searchsorted(ids, self.ids, "right")
        for at in range(0, len(self.ids), STRIP):
            to = min(at + STRIP, len(self.ids))
            scores = np.zeros((to - at, n), kind)
            strip = weights[at:to]
            for t, places, values in postings:
                some = np.flatnonzero(strip[:, t])  # sparse query rows
                if not len(some):
                    continue
                part = strip[some, t, None] * values
                if len(some) == to - at:
                    scores[:, places] += part
                elif isinstance(places, slice):
                    scores[some] += part
                else:
                    scores[np.ix_(some, places)] += part
            own = np.zeros((to - at, n), bool)
            for q in np.flatnonzero(hi[at:to] > lo[at:to]):
                own[q, lo[at + q] : hi[at + q]] = True
            # The key orders by score, then by the smaller vec_id, and puts the query's own rows last.
            if kind is np.int32:
                key = (scores.astype(np.int64) << 20) - np.arange(n)
                key[own] = -(1 << 62)
                pick = np.argpartition(-key, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), (to - at, n))
            else:
                pick = np.stack([_order(s, np.arange(n), ~o)[:k] for s, o in zip(scores, own, strict=True)])
            row = np.arange(to - at)[:, None]
            top_score[at:to], top_id[at:to], top_valid[at:to] = scores[row, pick], ids[pick], ~own[row, pick]
        self._merge(top_score, top_id, top_valid)

    def _merge(self, score: np.ndarray, found: np.ndarray, valid: np.ndarray) -> None:
        score, found, valid = np.hstack([self.score, score]), np.hstack([self.found, found]), np.hstack([self.valid, valid])
        if score.dtype == object:
            order = np.stack([_order(*x)[: self.k] for x in zip(score, found, valid, strict=True)]) if len(score) else np.zeros(score.shape, np.int64)
        else:
            order = np.lexsort((found, -score, ~valid), axis=1)[:, : self.k]
        self.score, self.found, self.valid = (np.take_along_axis(x, order, axis=1) for x in (score, found, valid))


def _order(score: np.ndarray, found: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Valid entries first, by falling score, then by rising number."""
    if score.dtype != object:
        return np.lexsort((found, -score, ~valid))
    return np.array(sorted(range(len(score)), key=lambda i: (not valid[i], -score[i], found[i])), np.int64)


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. queries: vectors of the same columns; without them the rows whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    _store.ship(spark)
    rows = quantised(vectors, scale)
    if queries is not None:
        asked = quantised(queries, scale)
        n_rows, n_asked = rows.count(), asked.count()
    else:
        own = F.pmod("vec_id", F.lit(every)) == 0
        asked = rows.where(own)
        n_rows, n_asked = rows.agg(F.count("*"), F.count_if(own)).first()
    passes = max(1, -(-n_asked // QUERIES_PER_PASS))
    if passes > 1:  # each batch is a partition, all of one size
        asked = _store.written(asked.repartition(passes).withColumn("batch", F.spark_partition_id()))
    else:
        asked = asked.withColumn("batch", F.lit(0))
    tasks = max(1, -(-n_rows // BLOCK))
    rows = rows.coalesce(tasks)
    found = None
    for p in range(passes):
        got = pa.Table.from_batches(_arrow(asked.where(F.col("batch") == p).orderBy("vec_id").select("vec_id", "v")), _VECTORS).combine_chunks()
        ids = got.column("vec_id").to_numpy() if len(got) else np.zeros(0, np.int64)
        weights = _matrix(got.column("v").combine_chunks() if len(got) else pa.array([], pa.list_(pa.float64())))
        sent = spark.sparkContext.broadcast((ids, weights))
        part = rows.mapInArrow(_searcher(sent, k), _FOUND).withColumn("batch", F.lit(p))
        if passes > 1:
            part = _store.written(part)
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("batch", "query").orderBy(F.col("score").desc(), F.col("beyond").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_VECTORS = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])


def _arrow(df: DataFrame) -> list[pa.RecordBatch]:
    return df.toArrow().cast(_VECTORS).to_batches()


def _searcher(sent, k: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weights = sent.value
        best = _Best(ids, weights, k)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                held.append((part.column(0).to_numpy(), _matrix(part.column(1), weights.shape[1])))
                if sum(len(x[0]) for x in held) >= BLOCK:
                    best.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
        if held:
            best.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
        row, place = np.nonzero(best.valid)
        for lo in range(0, len(row), 50_000):
            r, p = row[lo : lo + 50_000], place[lo : lo + 50_000]
            score, beyond = best.score[r, p], [None] * len(r)
            if score.dtype == object:
                score, beyond = zip(*map(_as_long, score), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(ids[r]), pa.array(best.found[r, p]), pa.array(score, pa.int64()), pa.array(beyond, pa.string())], names=[c.split()[0] for c in _FOUND.split(", ")])

    return run
