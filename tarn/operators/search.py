"""Exact top-k retrieval of a table of queries (qid, term, weight).

A batch of bounded size is collected and broadcast; larger tables of queries take several. The postings of their terms, each read and
packed once whatever the number of queries and batches that share it, are dealt by blocks of documents; a block's postings are added term by
term to dense scores of the queries, and only the best k of each query leave a task. With `prune`, queries are skipped in blocks whose summed
upper bounds stay below the k-th score they have reached.

Documents are filtered before anything is scored. Ties go to the smaller doc_id; only scores above zero count.
"""

from __future__ import annotations

import asyncio
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.functions.scoring import Model
from tarn.operators.index import Index

DocSet = DataFrame | Iterable[int] | Iterable[bool] | None


class Documents:
    """A set of document numbers as a table (doc_id), with the algebra of sets; no operation runs a job but `in` and len()."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()

    @staticmethod
    def of(spark: SparkSession, ids: Iterable[int]) -> Documents:
        return Documents(spark.createDataFrame([(int(i),) for i in ids], "doc_id bigint"))

    @staticmethod
    def from_mask(spark: SparkSession, mask: Iterable[bool]) -> Documents:
        return Documents.of(spark, (i for i, x in enumerate(mask) if x))

    def __or__(self, other: Documents) -> Documents:
        return Documents(self.rows.unionByName(other.rows))

    def __and__(self, other: Documents) -> Documents:
        return Documents(self.rows.join(other.rows, "doc_id", "left_semi"))

    def __sub__(self, other: Documents) -> Documents:
        return Documents(self.rows.join(other.rows, "doc_id", "left_anti"))

    def insert(self, *ids: int) -> Documents:
        return self | Documents.of(self.rows.sparkSession, ids)

    def remove(self, *ids: int) -> Documents:
        return self - Documents.of(self.rows.sparkSession, ids)

    def complement(self, n: int) -> Documents:
        """The numbers below n that aren't in the set."""
        return Documents(self.rows.sparkSession.range(n).withColumnRenamed("id", "doc_id")) - self

    def __contains__(self, number: int) -> bool:
        return self.rows.where(F.col("doc_id") == int(number)).limit(1).count() > 0

    def __len__(self) -> int:
        return self.rows.count()


def doc_set(index: Index, ids: DocSet | Documents) -> DataFrame | None:
    """A set of documents as a table of doc_id: from a set, a table, numbers, or a mask by document number."""
    if isinstance(ids, Documents):
        return ids.rows
    if ids is None or isinstance(ids, DataFrame):
        return ids
    given = list(ids)
    if given and all(isinstance(x, bool) for x in given):
        given = [i for i, x in enumerate(given) if x]
    return index.spark.createDataFrame([(int(i),) for i in given], "doc_id bigint")


def filtered(rows: DataFrame, deleted: DataFrame | None, allowed: DataFrame | None) -> DataFrame:
    """rows without deleted documents, and of allowed ones alone if there are such."""
    if deleted is not None:
        rows = rows.join(deleted.select("doc_id"), "doc_id", "left_anti")
    if allowed is not None:
        rows = rows.join(allowed.select("doc_id"), "doc_id", "left_semi")
    return rows


def weighted(index: Index, queries: DataFrame, model: Model) -> DataFrame:
    """qid, term, factor: what each query gives a term's postings; unknown terms go."""
    merged = queries.groupBy("qid", "term").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    if model.needs_df:
        known = merged.join(index.terms.select("term", "df"), "term")
        known = model.query_weights(known)
        return known.select("qid", "term", (F.col("weight") * model.term_factor(F.col("df"), index.stats())).alias("factor"))
    return model.query_weights(merged).select("qid", "term", F.col("weight").alias("factor"))


def scores(index: Index, queries: DataFrame, model: Model | None = None, deleted: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, score of every document that shares a term with the query."""
    model = model or index.model
    rows = filtered(index.postings.select("term", "doc_id", "value", "dl"), deleted, allowed)
    hits = rows.join(weighted(index, queries, model), "term")
    part = F.col("factor") * model.posting_factor(F.col("value"), F.col("dl"), index.stats())
    return hits.groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))


#: Decimals of a score that count: copies of a document must tie, in whichever order their parts were added.
DIGITS = 9


def top(scored: DataFrame, k: int, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The best k of each query above zero, with ranks from 1."""
    if k < 1:
        raise ValueError("k must be at least 1")
    scored = scored.withColumn("score", F.round("score", DIGITS))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), *by)
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", *(c for c in scored.columns if c not in ("qid", "rank")))


#: Rows (query, term) that are collected and broadcast at once, at most (but for a query of more); larger tables take several passes.
BATCH = 1_000_000
#: Batches that share a pass over the postings.
PASS = 8
#: Terms whose names are pushed into the scan of the postings.
PUSHED = 1000
#: Documents of a block, and cells of the dense scores that are held at once.
BLOCK_DOCS, CELLS = 4096, 1 << 22


def search(index: Index, queries: DataFrame, k: int = 10, model: Model | None = None, deleted: DocSet = None, allowed: DocSet = None, prune: bool = False, width: int = BLOCK_DOCS) -> DataFrame:
    """qid, rank, doc_id, score."""
    if k < 1:
        raise ValueError("k must be at least 1")
    model, deleted, allowed = model or index.model, doc_set(index, deleted), doc_set(index, allowed)
    rows = filtered(index.postings.select("term", "doc_id", "value", "dl"), deleted, allowed)
    part = model.posting_factor(F.col("value"), F.col("dl"), index.stats())
    return top(candidates(rows, part, batches(weighted(index, queries, model)), k, prune, width), k)


@dataclass
class Batch:
    """Queries as arrays: for each term of names, places and factors of the queries that ask for it; least: a floor of each query's k-th score."""

    names: pa.Array
    qids: pa.Array
    lists: np.ndarray
    place: np.ndarray
    factor: np.ndarray
    least: np.ndarray | None = None


def batches(factors: DataFrame, least: DataFrame | None = None) -> Iterator[Batch]:
    """qid, term, factor (and qid, least) in batches of bounded size that hold queries whole."""
    first = factors.limit(BATCH + 1).toArrow()
    if first.num_rows <= BATCH:
        yield _batch(first, least.toArrow() if least is not None else None)
        return
    parts = -(-factors.count() // BATCH) + 1
    own = lambda rows, i: rows.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i)
    for i in range(parts):
        yield _batch(own(factors, i).toArrow(), own(least, i).toArrow() if least is not None else None)


def _batch(rows: pa.Table, least: pa.Table | None) -> Batch:
    def coded(name: str) -> tuple[pa.Array, np.ndarray]:
        column = rows.column(name).combine_chunks()
        column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
        return column.dictionary, column.indices.to_numpy(zero_copy_only=False)

    (names, term), (qids, query) = coded("term"), coded("qid")
    order = np.lexsort((query, term))
    floor = None
    if least is not None:
        known = dict(zip(least.column("qid").to_pylist(), least.column("least").to_pylist(), strict=True))
        floor = np.array([known.get(q) or 0.0 for q in qids.to_pylist()], float)
    return Batch(names, qids, np.searchsorted(term[order], np.arange(len(names) + 1)), query[order].astype(np.int32), rows.column("factor").to_numpy()[order].astype(float), floor)


def candidates(rows: DataFrame, part: Column, queries: Iterable[Batch], k: int, prune: bool = False, width: int = BLOCK_DOCS, bounds: tuple[int, float] | None = None) -> DataFrame:
    """qid, doc_id, score: of each batch and task each query's best k of its blocks of documents; the best k of all are among them.

    Postings are packed before they are shuffled, once for all batches; a task's blocks share one list of the best, so
    what leaves it grows with the queries alone.
    bounds (documents of a small block, alpha): only small blocks count in which alpha times the sum of the largest
    parts of a query's terms reaches the query's floor.
    """
    spark, out = rows.sparkSession, None
    table = lambda column, name, number: F.broadcast(spark.createDataFrame(pa.table({number: pa.array(np.arange(len(column), dtype=np.int32)), name: column})))
    every = iter(queries)
    while own := list(itertools.islice(every, PASS)):
        names = sorted({n for batch in own for n in batch.names.to_pylist()})
        asked = table(pa.array(names).cast(pa.string()), "term", "_t").select("term")  # no more than the batches have
        some = of_terms(rows, names).join(asked, "term", "left_semi")
        some = some.select(F.floor(F.col("doc_id") / width).alias("_block"), F.col("term").cast("string").alias("term"), "doc_id", part.cast("double").alias("_part"))
        dealt = some.mapInArrow(_packed, "_block bigint, term string, docs binary, parts binary").repartition(max(12, 2 * spark.sparkContext.defaultParallelism), "_block").sortWithinPartitions("_block")
        sent = [spark.sparkContext.broadcast((b.names.cast(pa.string()).to_pylist(), b.lists, b.place, b.factor, len(b.qids), b.least)) for b in own]
        found = dealt.mapInArrow(_accumulator(sent, k, prune, bounds), "_q int, doc_id bigint, score double")
        found = found.join(table(pa.concat_arrays([b.qids for b in own]), "qid", "_q"), "_q").select("qid", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones: bytes that are alike lie together and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block and term of a batch: gaps of the documents and the parts, as planes of bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.filter(pa.compute.is_valid(batch.column(2)))
        block, doc, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
        coded = batch.column(1).dictionary_encode()
        term = coded.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((doc, block, term))
        block, doc, part, term = block[order], doc[order], part[order].astype(float), term[order]
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(term) != 0)) + 1
        runs = [(lo, hi) for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True) if hi > lo]
        first = np.array([lo for lo, _ in runs], np.int64)
        docs = [_planes(np.diff(doc[lo:hi], prepend=0)) for lo, hi in runs]
        columns = [pa.array(block[first]), coded.dictionary.take(pa.array(term[first])), pa.array(docs, pa.binary()), pa.array([_planes(part[lo:hi]) for lo, hi in runs], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["_block", "term", "docs", "parts"])


def of_terms(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of some terms; files and row groups hold ranges of terms, so a few names skip most of them."""
    if len(terms) > PUSHED:
        return postings
    if len(terms) > 8:
        return postings.where(F.col("term").isin(terms))
    wanted = F.lit(False)
    for t in terms:
        wanted = wanted | (F.col("term") == t)
    return postings.where(wanted)


def _accumulator(sent, k: int, prune: bool, small: tuple[int, float] | None = None):  # noqa: ANN001, ANN202
    def blocks(batches: Iterator[pa.RecordBatch], code: dict[str, int]) -> Iterator[list[np.ndarray]]:
        """term, document and part of the postings of each block, by term."""
        now, held = None, []
        for batch in batches:
            for block, term, docs, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and block != now:
                    yield whole(held)
                    held = []
                now = block
                if term in code:
                    doc = np.cumsum(_values(docs, np.int64))
                    held.append((np.full(len(doc), code[term]), doc, _values(parts, float)))
        if held:
            yield whole(held)

    def whole(held: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        """A block's postings; those of one term and document, as split lists have them, are added up."""
        term, doc, part = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((doc, term))
        term, doc, part = term[order], doc[order], part[order]
        new = np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])
        return [term, doc, part] if new.all() else [term[new], doc[new], np.add.reduceat(part, np.flatnonzero(new))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, first = [x.value for x in sent], 0
        code = {t: i for i, t in enumerate(sorted({t for names, *_ in asked for t in names}))}
        own = []
        for names, *rest in asked:
            of = np.full(len(code), -1)
            of[[code[t] for t in names]] = np.arange(len(names))
            own.append((of, *rest, Best(rest[3], k, first, HELD // len(asked))))
            first += rest[3]
        for term, doc, part in blocks(batches, code):
            docs, column = np.unique(doc, return_inverse=True)
            for batch in own:
                yield from added(*batch, term, docs, column, part, prune, small, cells=CELLS)
        for batch in own:
            yield from batch[-1].rest()

    return run


def added(of, lists, asked, weights, n, floor, best, term, docs, column, part, prune: bool = False, small: tuple[int, float] | None = None, mask: np.ndarray | None = None, cells: int = CELLS) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Adds a block to the best documents of a batch; mask: which documents (columns) count for each query (row)."""
    safe = prune and not (weights < 0).any()
    cuts = [0, *(np.flatnonzero(np.diff(term)) + 1).tolist(), len(term)]
    runs = [(a, b, asked[lists[t] : lists[t + 1]], weights[lists[t] : lists[t + 1]]) for a, b, t in zip(cuts, cuts[1:], of[term[cuts[:-1]]].tolist(), strict=False) if t >= 0]
    bound = np.zeros(n)
    for a, b, q, w in runs:
        bound[q] += np.abs(w) * np.abs(part[a:b]).max()
    active = np.flatnonzero((bound > 0) & ((bound * (1 + 1e-9) + 1e-8 >= best.least) if safe else True) & (mask.any(axis=1) if mask is not None else True))
    # Blocks whose terms are in many documents are products of matrices, others are added list by list.
    full = sum(b - a for a, b, _, _ in runs) * 8 >= len(runs) * len(docs) and len(runs) * len(docs) <= cells
    if full:
        parts = np.zeros((len(runs), len(docs)))
        for i, (a, b, _, _) in enumerate(runs):
            parts[i, column[a:b]] = part[a:b]
    if small:
        of, group = np.unique(docs // small[0], return_inverse=True)
        peaks = [np.zeros(len(of)) for _ in runs]
        for peak, (a, b, _, _) in zip(peaks, runs, strict=True):
            np.maximum.at(peak, group[column[a:b]], part[a:b])
    step = max(1, cells // max(len(docs), len(runs) if full else 0))
    for at in range(0, len(active), step):
        own = active[at : at + step]
        place = np.full(n, -1)
        place[own] = np.arange(len(own))
        score = np.zeros((0 if full else len(own), len(docs)))
        asks = np.zeros((len(own), len(runs) if full else 0))
        sums = np.zeros((len(own), len(of))) if small else None
        for i, (a, b, q, w) in enumerate(runs):
            row = place[q]
            use = row >= 0
            if not use.any():
                continue
            if full:
                asks[row[use], i] = w[use]
            else:
                score[row[use][:, None], column[a:b]] += w[use][:, None] * part[a:b]
            if small:
                sums[row[use]] += w[use][:, None] * peaks[i]
        if full:
            score = asks @ parts
        if small:
            score[~(small[1] * sums >= floor[own][:, None])[:, group]] = 0
        if mask is not None:
            score[~mask[own]] = 0
        yield from best.add(own, docs, score)


#: Rows that Best holds; what more it has to keep it gives away.
HELD = 2_000_000


class Best:
    """The best k documents of each of n queries, over blocks of scores; ties go to the smaller document."""

    def __init__(self, n: int, k: int, first: int = 0, held: int = HELD):
        self.k, self.n, self.first, self.held, self.rows, self.kept, self.least = k, n, first, held, [], 0, np.zeros(n)

    def add(self, queries: np.ndarray, docs: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        """score: a row for each of some queries, a column for each document, ascending."""
        if not score.size:
            return
        low = np.maximum(self.least[queries] - 1e-8, 0)
        some = score > low[:, None]
        if score.shape[1] > self.k and np.count_nonzero(some) > 4 * self.k * len(queries):
            at = score.shape[1] - self.k
            low = np.maximum(np.partition(score, at, axis=1)[:, at] - 1e-8, low)
            some = score > low[:, None]
        row, column = np.nonzero(some)
        if len(row):
            yield from self.take(queries[row], docs[column], score[row, column])

    def take(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.rows.append((query.astype(np.int32), doc, score))
        if sum(len(x[0]) for x in self.rows) > max(2 * self.kept, min(self.n * self.k, self.held)):
            self.cut()
            if self.kept > self.held // 2:
                yield from self.rest()

    def cut(self) -> None:
        query, doc, score = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        order = np.lexsort((doc, -np.round(score, DIGITS), query))
        query, doc, score = query[order], doc[order], score[order]
        begin = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        rank = np.arange(len(query)) - np.repeat(begin, np.diff([*begin, len(query)]))
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        self.rows, self.kept = [tuple(x[rank < self.k] for x in (query, doc, score))], int((rank < self.k).sum())

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            self.cut()
            query, doc, score = self.rows[0]
            yield pa.RecordBatch.from_arrays([pa.array(query + np.int32(self.first)), pa.array(doc), pa.array(score)], names=["_q", "doc_id", "score"])
        self.rows, self.kept = [], 0


#: Both of the exact strategies a user may name give the same rows.
search_maxscore = search_many = search


def search_wand(index: Index, queries: DataFrame, k: int = 10, model: Model | None = None, **options) -> DataFrame:  # noqa: ANN003
    """search() with pruning, in smaller blocks, whose bounds are closer. Weights below zero switch pruning off."""
    return search(index, queries, k, model, **{"prune": True, "width": 512} | options)


def search_text(index: Index, queries: DataFrame, k: int = 10, **options) -> DataFrame:  # noqa: ANN003
    """queries (qid, text), analysed as the index was."""
    if index.analyzer is None:
        raise ValueError("the index has no analyzer: it was not built from text")
    return search(index, index.analyzer.query_terms(queries), k, **options)


async def search_async(index: Index, queries: DataFrame, k: int = 10, **options) -> list:  # noqa: ANN003
    """The rows of a search, awaited while the job runs."""
    return await asyncio.to_thread(lambda: search(index, queries, k, **options).collect())


def search_one(index: Index, weights: dict[str | int, float], k: int = 10, model: Model | None = None) -> DataFrame:
    """rank, doc_id, score of one query: a bounded heap in each task, merged at the end (no window, no second shuffle)."""
    found = scores(index, from_map(index, {0: weights}), model).select("doc_id", F.round("score", DIGITS).alias("score")).where("score > 0")
    best = found.orderBy(F.col("score").desc(), "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id"))).select("rank", "doc_id", "score")  # of k rows


def from_map(index: Index, queries: dict[int, dict[str | int, float]]) -> DataFrame:
    """queries as a table, from {qid: {term: weight}}."""
    return index.spark.createDataFrame([(q, str(t), float(w)) for q, own in queries.items() for t, w in own.items()], "qid bigint, term string, weight double")
