"""Approximate retrieval: block-max pruning over quantised impacts, and pruned lists with block summaries."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.operators.index import Index
from tarn.operators.ranking import picked, ranked, tidy
from tarn.operators.search import BLOCK_DOCS, CELLS, Batch, Best, _planes, _values, added, batches, candidates, of_terms, top

#: The largest quantised query weight.
MAX_TERM_WEIGHT = 32
LEVELS = 256


def level(value: Column, largest: float) -> Column:
    """Impacts as 8 bits; the least value is zero by convention."""
    return F.greatest(F.lit(0), F.least((value.cast("double") * LEVELS / F.lit(largest)).cast("int"), F.lit(LEVELS - 1)))


@dataclass
class BlockMaxIndex:
    """forward (term, block, doc_id, q), block_max (term, block, q) and kth (term, k, q: the k-th best, 0 if there are fewer)."""

    forward: DataFrame
    block_max: DataFrame
    kth: DataFrame
    block_size: int
    n_docs: int

    @staticmethod
    def build(index: Index, block_size: int = 64) -> BlockMaxIndex:
        if not 1 <= block_size <= 256:
            raise ValueError("block_size must be between 1 and 256")
        largest = float(index.postings.agg(F.max(F.col("value").cast("double")).alias("m")).first()["m"] or 1.0)
        forward = index.postings.select("term", F.floor(F.col("doc_id") / block_size).alias("block"), "doc_id", level(F.col("value"), largest).alias("q"))
        return BlockMaxIndex(forward, block_maxima(forward), kth_best(forward), block_size, index.stats().n)

    def packed(self) -> DataFrame:
        """block, term and the list of (place in block, q): the forward form."""
        place = F.struct((F.col("doc_id") - F.col("block") * self.block_size).cast("int").alias("place"), "q")
        return self.forward.groupBy("block", "term").agg(F.array_sort(F.collect_list(place)).alias("entries"))

    def super_blocks(self, width: int = 256) -> DataFrame:
        return self.block_max.groupBy("term", F.floor(F.col("block") / width).alias("super_block")).agg(F.max("q").alias("q"))

    def search(self, queries: DataFrame, k: int = 10, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
        """qid, rank, doc_id, score in quantised units. alpha scales block bounds (smaller: faster, less exact), beta is the share of each query's heaviest terms that count."""
        weighted = quantised_queries(queries)
        order = Window.partitionBy("qid").orderBy(F.col("weight").desc(), "term")
        size = F.count("*").over(Window.partitionBy("qid"))
        heavy = weighted.withColumn("_r", F.row_number().over(order)).withColumn("_n", size).where(F.col("_r") <= F.ceil(F.lit(beta) * F.col("_n"))).select("qid", "term", "weight")
        # The k-th best posting of any term alone is a floor for the k-th score.
        step = next((s for s in (10, 100, 1000) if s >= k), None)
        floor = heavy.join(self.kth.where(F.col("k") == (step or 0)), "term").groupBy("qid").agg(F.max(F.col("weight") * F.col("q")).cast("double").alias("least"))
        batch = batches(heavy.select("qid", "term", F.col("weight").cast("double").alias("factor")), floor)
        width = self.block_size * max(1, BLOCK_DOCS // self.block_size)
        return top(candidates(self.forward.select("term", "doc_id", "q"), F.col("q"), batch, k, width=width, bounds=(self.block_size, alpha)), k)


def quantised_queries(queries: DataFrame) -> DataFrame:
    merged = queries.groupBy("qid", "term").agg(F.sum("weight").alias("weight"))
    share = F.col("weight") / F.max("weight").over(Window.partitionBy("qid"))
    return merged.withColumn("weight", F.ceil(share * MAX_TERM_WEIGHT).cast("bigint")).where("weight > 0")


def block_maxima(forward: DataFrame) -> DataFrame:
    return forward.groupBy("term", "block").agg(F.max("q").alias("q"))


def kth_best(forward: DataFrame, ks: tuple[int, ...] = (10, 100, 1000)) -> DataFrame:
    """term, k, q from the ranks k; terms with fewer postings have 0."""
    counts = forward.groupBy("term", "q").agg(F.count("*").alias("n"))  # LEVELS rows a term at most
    reached = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("term").orderBy(F.col("q").desc())))
    found = [F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("q"))), F.lit(0)).alias("q") for k in ks]
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), q) for k, q in zip(ks, found, strict=True)))
    return reached.groupBy("term").agg(pairs.alias("x")).select("term", F.explode("x").alias("x")).select("term", "x.k", "x.q")


#: Values of centres that are broadcast at once, values of members that a round of summaries gathers, bits of (query, block) that a group of queries asks for.
CENTRES, ROUND, BITS = 8_000_000, 32_000_000, 1 << 29
#: Queries of a group, at most.
GROUP = 16384


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in their narrowest exact types, as planes of bytes, compressed."""
    heads, body = [], []
    for a in arrays:
        if a.dtype.kind == "f":
            with np.errstate(over="ignore"):
                small = a.astype(np.float32)
            a = small if (small == a).all() else a.astype(float)
        else:
            low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
            a = a.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))
        heads.append((a.dtype.str, len(a)))
        body.append(_planes(a) if len(a) else b"")
    whole = b"".join(body)
    head = ";".join(f"{kind},{n}" for kind, n in heads).encode()
    return len(head).to_bytes(4, "little") + len(whole).to_bytes(8, "little") + head + pa.compress(whole, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    long, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:12], "little")
    whole, at, out = pa.decompress(data[12 + long :], size, codec="zstd", asbytes=True) if size else b"", 0, []
    for head in data[12 : 12 + long].decode().split(";"):
        kind, n = head.split(",")
        wide = np.dtype(kind).itemsize * int(n)
        a = _values(whole[at : at + wide], kind) if wide else np.zeros(0, kind)
        out.append(a.astype(float if a.dtype.kind == "f" else np.int64))
        at += wide
    return out


def _gathered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after another, and which range each is of."""
    sizes = ends - starts
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of], of


@dataclass
class Part:
    """Some documents and their postings by term: runs (code, first, end), and for each posting the document's place, value and block (0: what is left, -1: not in the list)."""

    docs: np.ndarray
    codes: np.ndarray
    ends: np.ndarray
    column: np.ndarray
    value: np.ndarray
    block: np.ndarray

    @staticmethod
    def of(data: bytes) -> Part:
        gaps, codes, sizes, column, value, block = _unpack(data)
        return Part(np.cumsum(gaps), codes, np.cumsum(sizes), column, value, block)

    def packed(self) -> bytes:
        return _pack(np.diff(self.docs, prepend=0), self.codes, np.diff(self.ends, prepend=0), self.column, self.value, self.block)

    def runs(self) -> Iterator[tuple[int, int, int]]:
        return zip(self.codes.tolist(), [0, *self.ends[:-1].tolist()], self.ends.tolist(), strict=True)

    def terms(self) -> np.ndarray:
        return np.repeat(self.codes, np.diff(self.ends, prepend=0))

    def rows(self, heads: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings by document: where each document's end, their terms and values; heads: only so many of its strongest."""
        term, column, value = self.terms(), self.column, self.value
        if heads is not None:
            order = np.lexsort((term, -value, column))
            first = np.searchsorted(column[order], np.arange(len(self.docs)))
            order = np.sort(order[np.arange(len(order)) - first[column[order]] < heads])
            term, column, value = term[order], column[order], value[order]
        order = np.argsort(column, kind="stable")
        return np.searchsorted(column[order], np.arange(len(self.docs)), "right"), term[order], value[order]


def _matrix(ends: np.ndarray, term: np.ndarray, value: np.ndarray, rows: np.ndarray, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Some documents as rows over the terms they have."""
    take, of = _gathered(np.concatenate([[0], ends[:-1]])[rows], ends[rows])
    terms, place = np.unique(term[take], return_inverse=True)
    out = np.zeros((len(rows), len(terms)), kind)
    out[of, place] = value[take]
    return terms, out


@dataclass
class Centres:
    """Documents around which lists are clustered: for each list (code) their values by term; blocks count from 1."""

    codes: np.ndarray
    sizes: np.ndarray
    ends: np.ndarray
    term: np.ndarray
    block: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(data: bytes) -> Centres:
        *places, term, block, value = _unpack(data)
        return Centres(*places, term.astype(np.int32), block.astype(np.int32), value.astype(np.float32))

    def packed(self) -> bytes:
        """For a broadcast, of which each executor keeps a file."""
        return _pack(self.codes, self.sizes, self.ends, self.term, self.block, self.value)

    def nearest(self, code: int, rows: np.ndarray, own: tuple[np.ndarray, ...]) -> np.ndarray | None:
        """The block whose centre has the largest product with each document's main components, the first one of equals."""
        i = int(np.searchsorted(self.codes, code))
        if i == len(self.codes) or self.codes[i] != code or not self.sizes[i]:
            return None
        lo, hi = (int(self.ends[i - 1]) if i else 0), int(self.ends[i])
        term, out = self.term[lo:hi], np.zeros(len(rows), np.int64)
        step = max(1, CELLS // max(int(self.sizes[i]), 64))
        for at in range(0, len(rows), step):
            terms, heads = _matrix(*own, rows[at : at + step])
            take, of = _gathered(np.searchsorted(term, terms), np.searchsorted(term, terms, "right"))
            centres = np.zeros((len(terms), int(self.sizes[i])), np.float32)
            centres[of, self.block[lo:hi][take] - 1] = self.value[lo:hi][take]
            out[at : at + step] = (heads @ centres).argmax(axis=1) + 1
        return out


def _centres(lists: list[tuple[int, np.ndarray]], docs: np.ndarray, ends: np.ndarray, term: np.ndarray, value: np.ndarray) -> Iterator[Centres]:
    """Centres of (code, documents), of so many lists at once as may be broadcast."""
    starts, held, size = np.concatenate([[0], ends[:-1]]), [], 0

    def made() -> Centres:
        parts = []
        for _, own in held:
            at = np.searchsorted(docs, own)
            take, of = _gathered(starts[at], ends[at])
            order = np.argsort(term[take], kind="stable")
            parts.append((term[take][order].astype(np.int32), (of[order] + 1).astype(np.int32), value[take][order].astype(np.float32)))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return Centres(np.array([c for c, _ in held]), np.array([len(own) for _, own in held]), np.cumsum([len(p[0]) for p in parts]), *columns)

    for code, own in lists:
        at = np.searchsorted(docs, own)
        n = int((ends[at] - starts[at]).sum())
        if held and size + n > CENTRES:
            yield made()
            held, size = [], 0
        held.append((code, own))
        size += n
    if held:
        yield made()


def _limits(rows: DataFrame, sizes: dict[str, int], longest: int, total: int | None) -> dict[str, tuple[float, int]]:
    """term: the least value and, at that value, the last document that its list keeps, where one is cut.

    total: so many postings of all lists together are kept before. Values are selected by counts, so no list is sorted.
    """
    every, out, spark = 2**63 - 1, {}, rows.sparkSession

    def cut(rows: DataFrame, n: dict[str, int], wanted: dict[str, int], order: list[str]) -> Iterator[Row]:
        """The last rows kept where each key (term, with n rows) keeps its first so many, by value descending and order."""
        asked = spark.createDataFrame([(t, 0, n[t] - most + 1) for t, most in wanted.items()], "term string, j int, rank bigint")
        least = F.broadcast(picked(rows, asked).select("term", F.col("value").alias("least")))
        near = rows.join(least, "term").where("value >= least")
        more = near.groupBy("term").agg(F.count(F.when(F.col("value") > F.col("least"), 1)).alias("above"))
        need = spark.createDataFrame([(r["term"], wanted[r["term"]] - r["above"]) for r in more.collect()], "term string, need bigint")
        ties = ranked(near.where("value = least"), "term", order)
        return ties.join(F.broadcast(need), "term").where("rank = need").toLocalIterator()

    if longest < 1 or (total is not None and total < 1):
        return dict.fromkeys(sizes, (float("inf"), -every))
    long = {t: longest for t, n in sizes.items() if n > longest}
    if long:
        for r in cut(of_terms(rows, list(long)), sizes, long, ["doc_id"]):
            out[r["term"]] = (r["value"], r["doc_id"])
    if total is not None and total < sum(sizes.values()):
        one = rows.select(F.lit("").alias("term"), F.col("term").alias("name"), "doc_id", "value")
        last = next(iter(cut(one, {"": sum(sizes.values())}, {"": total}, ["name", "doc_id"])))
        for t in sizes:
            own = (t.encode() > last["name"].encode()) - (t.encode() < last["name"].encode())
            of_all = (last["value"], last["doc_id"] if own == 0 else -every if own > 0 else every)
            out[t] = min(out.get(t, (0.0, every)), of_all, key=lambda x: (-x[0], x[1]))
    return out


@dataclass
class PrunedIndex:
    """Lists cut to their strongest postings and clustered around some of their documents, with a summary vector for each block.

    Documents are packed by ranges of their numbers, with all their values and the block of each list that they are in.
    """

    terms: DataFrame  # term, code, blocks: numbers below which the blocks of its list are, 0 being what is left
    packed: DataFrame  # part, data
    sums: DataFrame  # code, data
    neighbours: DataFrame | None
    n_docs: int

    @property
    def lists(self) -> DataFrame:
        """term, block, doc_id; block -1 is what is left where no block is large enough."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                own = part.block >= 0
                yield pa.RecordBatch.from_arrays([pa.array(part.terms()[own].astype(np.int32)), pa.array(part.block[own] - 1), pa.array(part.docs[part.column[own]])], names=["code", "block", "doc_id"])

        return self._named(self.packed.mapInArrow(run, "code int, block bigint, doc_id bigint")).select("term", "block", "doc_id")

    @property
    def forward(self) -> DataFrame:
        """doc_id, term, value."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                yield pa.RecordBatch.from_arrays([pa.array(part.terms().astype(np.int32)), pa.array(part.docs[part.column]), pa.array(part.value)], names=["code", "doc_id", "value"])

        return self._named(self.packed.mapInArrow(run, "code int, doc_id bigint, value double")).select("doc_id", "term", "value")

    @property
    def summaries(self) -> DataFrame:
        """term, block, component, value."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for code, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    block, term, value = _unpack(data)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), code, np.int32)), pa.array(block - 1), pa.array(term.astype(np.int32)), pa.array(value)], names=["code", "block", "other", "value"])

        rows = self._named(self.sums.mapInArrow(run, "code int, block bigint, other int, value double"))
        other = self.terms.select(F.col("code").alias("other"), F.col("term").alias("component"))
        return rows.join(F.broadcast(other), "other").select("term", "block", "component", "value")

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self.terms.select("code", "term")), "code")

    @staticmethod
    def build(index: Index, n_postings: int = 6000, max_fraction: float = 1.5, centroid_fraction: float = 0.1, min_cluster_size: int = 2, doc_cut: int = 15, summary_energy: float = 0.4, knn: int = 0, global_threshold: bool = False, store: Callable[[DataFrame], DataFrame] | None = None) -> PrunedIndex:
        """Each list keeps its n_postings * max_fraction strongest; centroid_fraction of these, picked by hash, are centres of its blocks.

        A document joins the centre that has the largest product with its doc_cut strongest components; blocks of fewer
        than min_cluster_size are given up and theirs join the others. summary_energy is the share of a block's mass
        (its largest values of each component) that its summary keeps.
        global_threshold: of all lists together only the n_postings a term strongest are kept before, exactly so many.
        store: writes a table and reads it back (see sources.store); without it tables are kept by persist().
        """
        spark, keep = index.spark, store or (lambda df: df.persist(StorageLevel.MEMORY_AND_DISK))
        rows = index.postings.where("doc_id is not null").select(F.col("term").cast("string").alias("term"), "doc_id", F.col("value").cast("double").alias("value"))
        known = sorted(((str(r["term"]), r["df"]) for r in index.terms.select("term", "df").toLocalIterator()), key=lambda x: x[0].encode())
        names, sizes, n_docs = [t for t, _ in known], dict(known), index.stats().n
        limits = _limits(rows, sizes, int(n_postings * max_fraction), n_postings * max(1, len(names)) if global_threshold else None)
        least = np.array([limits.get(t, (0.0, 0))[0] for t in names], float)
        last = np.array([limits.get(t, (0.0, 0))[1] for t in names], np.int64)
        coded = pa.table({"term": pa.array(names, pa.string()), "code": pa.array(np.arange(len(names), dtype=np.int32)), "least": least, "last": last})
        joined = rows.join(F.broadcast(spark.createDataFrame(coded)), "term")
        own = joined.where((F.col("value") > F.col("least")) | ((F.col("value") == F.col("least")) & (F.col("doc_id") <= F.col("last"))))
        length = np.zeros(len(names), np.int64)
        if global_threshold:
            for r in own.groupBy("code").count().collect():
                length[r["code"]] = r["count"]
        else:
            length[:] = [min(sizes[t], max(0, int(n_postings * max_fraction))) for t in names]

        centres = PrunedIndex._picked(spark, own, rows, names, length, centroid_fraction)
        width = max(256, min(BLOCK_DOCS, n_docs // 48))
        at = spark.sparkContext.broadcast((pa.array(names, pa.string()), least, last))
        parts = rows.mapInArrow(_dealt(at, width), "part bigint, code int, data binary").repartition(max(12, 2 * spark.sparkContext.defaultParallelism), "part").sortWithinPartitions("part")
        with tidy(spark):
            table = None
            for some in _centres(*centres):
                sent = spark.sparkContext.broadcast(some.packed())
                table = keep(parts.mapInArrow(_gathering(at, sent, doc_cut), PACKED)) if table is None else keep(table.mapInArrow(_settling(sent, doc_cut), PACKED))
            if table is None:
                table = keep(parts.mapInArrow(_gathering(at, None, doc_cut), PACKED))
            # Blocks that are too small are given up: the others are numbered anew, and documents without a block join those.
            sized = table.mapInArrow(_counting, "code int, block bigint, n bigint").groupBy("code", "block").agg(F.sum("n").alias("n"))
            kept = sized.where((F.col("n") >= min_cluster_size) & (F.col("block") > 0)).select("code", "block").toArrow()
            code, block = (kept.column(i).to_numpy() for i in range(2))
            order = np.lexsort((block, code))
            code, block = code[order], block[order]
            alive, anew, blocks = [], {}, np.ones(len(names), np.int32)
            for c, own_docs in centres[0]:
                places = block[np.searchsorted(code, c) : np.searchsorted(code, c, "right")]
                anew[c] = np.zeros(len(own_docs) + 1, np.int64)
                anew[c][places] = np.arange(1, len(places) + 1)
                blocks[c] += len(places)
                if len(places):
                    alive.append((c, own_docs[places - 1]))
            told = spark.sparkContext.broadcast(anew)
            for some in _centres(alive, *centres[1:]):
                table, told = keep(table.mapInArrow(_settling(spark.sparkContext.broadcast(some.packed()), doc_cut, told), PACKED)), None
            if told is not None and anew:
                table = keep(table.mapInArrow(_settling(None, doc_cut, told), PACKED))
            sums, mean = None, sum(sizes.values()) / max(1, index.docs.count())
            for some in _rounds(length * mean):
                asked = spark.sparkContext.broadcast((some, blocks[some], len(names)))
                peaks = table.mapInArrow(_peaking(asked), SUMS).repartition(len(some), "code").sortWithinPartitions("code")
                round_ = keep(peaks.mapInArrow(_summing(summary_energy), SUMS))
                sums = round_ if sums is None else sums.unionByName(round_)
        if sums is None:
            sums = spark.createDataFrame([], SUMS)
        neighbours = None
        if knn:
            main = Window.partitionBy("doc_id").orderBy(F.col("value").desc(), "term")
            heads = rows.withColumn("_r", F.row_number().over(main)).where(F.col("_r") <= doc_cut).select("doc_id", F.col("term").alias("component"), "value")
            both = heads.join(heads.select(F.col("doc_id").alias("near"), "component", F.col("value").alias("other")), "component").where("doc_id <> near")
            dots = both.groupBy("doc_id", "near").agg(F.sum(F.col("value") * F.col("other")).alias("s"))
            neighbours = dots.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("s").desc(), "near"))).where(F.col("_r") <= knn).select("doc_id", "near")
        terms = spark.createDataFrame(pa.table({"term": coded.column("term"), "code": coded.column("code"), "blocks": pa.array(blocks)}))
        return PrunedIndex(terms, table, sums, neighbours, n_docs)

    @staticmethod
    def _picked(spark: SparkSession, own: DataFrame, rows: DataFrame, names: list[str], length: np.ndarray, fraction: float) -> tuple:
        """(code, documents) of the centres of each list, those with its smallest hashes, and the vectors of all of them."""
        n = np.minimum(length, np.maximum(1, (fraction * length).astype(np.int64)))
        few = np.minimum(1.0, (n + 6 * np.sqrt(n) + 12) / np.maximum(1, length)) * 2**31  # enough of them, almost surely
        table = spark.createDataFrame(pa.table({"code": pa.array(np.arange(len(names), dtype=np.int32)), "_most": pa.array(few.astype(np.int64))}))
        some = own.join(F.broadcast(table), "code").withColumn("_h", F.shiftrightunsigned(F.xxhash64("term", "doc_id"), 33))
        found = some.where(F.col("_h") < F.col("_most")).select("code", "doc_id", "_h").toArrow()
        code, doc, place = (found.column(i).to_numpy() for i in range(3))
        order = np.lexsort((doc, place, code))
        code, doc = code[order], doc[order]
        lists = [(c, doc[lo : lo + int(n[c])]) for c, lo in zip(*(x.tolist() for x in np.unique(code, return_index=True)), strict=True)]
        ids = np.unique(np.concatenate([d for _, d in lists])) if lists else np.zeros(0, np.int64)
        wanted = F.broadcast(spark.createDataFrame(pa.table({"doc_id": pa.array(ids)})))
        at = spark.sparkContext.broadcast((pa.array(names, pa.string()), None, None))
        packed = rows.join(wanted, "doc_id", "left_semi").select("term", "doc_id", "value").mapInArrow(_dealt(at, 2**40), "part bigint, code int, data binary").select("code", "data").toArrow()
        docs, terms, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for c, data in zip(*(x.to_pylist() for x in packed.columns), strict=True):
            d, v = _unpack(data)
            docs.append(np.cumsum(d))
            terms.append(np.full(len(d), c, np.int32))
            values.append(v.astype(np.float32))
        docs, terms, values = np.concatenate(docs), np.concatenate(terms), np.concatenate(values)
        order = np.argsort(docs, kind="stable")
        return lists, ids, np.searchsorted(docs[order], ids, "right"), terms[order], values[order]

    def search(self, queries: DataFrame, k: int = 10, query_cut: int = 10, heap_factor: float = 0.7, n_knn: int = 0) -> DataFrame:
        """qid, rank, doc_id, score. Lists of the query_cut heaviest terms are read; blocks whose summary scores under heap_factor times the floor are skipped (higher: faster, less exact); found documents are scored exactly.

        Queries are broadcast in groups; scores are added within ranges of documents, as in operators.search.
        """
        merged = queries.groupBy("qid", "term").agg(F.sum("weight").alias("weight")).where("weight > 0").select("qid", F.col("term").cast("string").alias("term"), F.col("weight").cast("double").alias("weight"))
        spark, known = self.packed.sparkSession, self.terms.toArrow()
        names, codes, blocks = known.column("term").combine_chunks(), known.column("code").to_numpy(), known.column("blocks").to_numpy()
        sizes = np.zeros(len(codes), np.int64)
        sizes[codes] = blocks
        out = None
        for batch in batches(merged.withColumnRenamed("weight", "factor")):
            for asked, qids in _asked(batch, names, codes, sizes, query_cut):
                sent, floor = spark.sparkContext.broadcast(asked), None
                if heap_factor > 0:
                    # Floor: the k-th exact score among the documents of each query's best block of every list.
                    seeds = top(self._scores(sent, self._opened(sent, None, 0.0), k).withColumnRenamed("_q", "qid"), k).where(F.col("rank") == k).select("qid", "score").toArrow()
                    floor = np.full(asked.n, -np.inf)
                    floor[seeds.column("qid").to_numpy()] = seeds.column("score").to_numpy()
                found = self._scores(sent, self._opened(sent, floor if floor is not None else np.full(asked.n, -np.inf), heap_factor), k)
                table = spark.createDataFrame(pa.table({"_q": pa.array(np.arange(asked.n, dtype=np.int32)), "qid": qids}))
                found = found.join(F.broadcast(table), "_q").select("qid", "doc_id", "score")
                out = found if out is None else out.unionByName(found)
        if out is None:
            out = merged.select("qid", F.lit(0).cast("bigint").alias("doc_id"), F.col("weight").alias("score")).limit(0)
        if n_knn and self.neighbours is not None:
            best = top(out, k).select("qid", "doc_id")
            near = best.join(self.neighbours, "doc_id").select("qid", F.col("near").alias("doc_id")).distinct()
            near = near.join(self.forward, "doc_id").join(merged, ["qid", "term"]).groupBy("qid", "doc_id").agg(F.sum(F.col("weight") * F.col("value")).alias("score"))
            out = out.unionByName(near).groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
        return top(out, k)

    def _opened(self, sent, floor: np.ndarray | None, heap_factor: float) -> dict[int, tuple[int, bytes]]:  # noqa: ANN001
        """Of each list which blocks (rows of bits) each query reads: those that reach its floor, and the best one; without floors only that."""
        rows = self.sums.mapInArrow(_opening(sent, floor, heap_factor), "code int, bytes bigint, bits binary").toArrow()
        return {c: (n, b) for c, n, b in zip(*(x.to_pylist() for x in rows.columns), strict=True)}

    def _scores(self, sent, opened: dict[int, tuple[int, bytes]], k: int) -> DataFrame:  # noqa: ANN001
        """_q, doc_id, score: of each task and query the best k of the documents in its blocks."""
        return self.packed.mapInArrow(_scoring(sent, self.packed.sparkSession.sparkContext.broadcast(opened), k), "_q int, doc_id bigint, score double")


PACKED, SUMS = "part bigint, data binary", "code int, data binary"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    for batch in batches:
        for data in batch.column(batch.schema.get_field_index("data")):
            yield Part.of(data.as_py())


def _dealt(at, width: int):  # noqa: ANN001, ANN202
    """Postings as rows (part, code, data) for each term and range of documents in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = at.value[0]
        for batch in batches:
            if not batch.num_rows:
                continue
            terms = batch.column(0).dictionary_encode()
            term = pa.compute.index_in(terms.dictionary, value_set=names).to_numpy(zero_copy_only=False)[terms.indices.to_numpy(zero_copy_only=False)]
            doc, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            order = np.lexsort((doc, doc // width, term))
            doc, value, term = doc[order], value[order], term[order]
            part = doc // width
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(term) != 0)) + 1
            first, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(doc)]])
            data = [_pack(np.diff(doc[a:b], prepend=0), value[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)]
            columns = [pa.array(part[first]), pa.array(term[first].astype(np.int32)), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "code", "data"])

    return run


def _settled(part: Part, centres: Centres | None, doc_cut: int, anew: dict[int, np.ndarray] | None = None) -> Part:
    """Gives members without a block the nearest one; anew: other numbers of blocks, 0 for those given up."""
    heads = None
    for code, a, b in part.runs():
        block = part.block[a:b]
        if anew is not None and code in anew:
            block[block > 0] = anew[code][block[block > 0]]
        open_ = np.flatnonzero(block == 0)
        if centres is None or not len(open_):
            continue
        heads = heads if heads is not None else part.rows(doc_cut)
        found = centres.nearest(code, part.column[a:b][open_], heads)
        if found is not None:
            block[open_] = found
    return part


def _told(number: int, part: Part) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part.packed()], pa.binary())], names=["part", "data"])


def _gathering(at, sent, doc_cut: int):  # noqa: ANN001, ANN202
    """Makes parts of what _dealt() made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, least, last), centres = at.value, Centres.of(sent.value) if sent else None
        rows = ((n, c, d) for batch in batches for n, c, d in zip(*(x.to_pylist() for x in batch.columns), strict=True))
        for number, own in itertools.groupby(rows, key=lambda r: r[0]):
            term, doc, value = [], [], []
            for _, code, data in own:
                gaps, v = _unpack(data)
                term.append(np.full(len(gaps), code))
                doc.append(np.cumsum(gaps))
                value.append(v)
            term, doc, value = np.concatenate(term), np.concatenate(doc), np.concatenate(value)
            order = np.lexsort((doc, term))
            term, doc, value = term[order], doc[order], value[order]
            docs, column = np.unique(doc, return_inverse=True)
            codes, first = np.unique(term, return_index=True)
            member = (value > least[term]) | ((value == least[term]) & (doc <= last[term]))
            part = Part(docs, codes, np.concatenate([first[1:], [len(term)]]), column, value, np.where(member, 0, -1))
            yield _told(number, _settled(part, centres, doc_cut))

    return run


def _settling(sent, doc_cut: int, told=None):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = Centres.of(sent.value) if sent else None
        for batch in batches:
            for number, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                yield _told(number, _settled(Part.of(data), centres, doc_cut, told.value if told else None))

    return run


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each block."""
    for part in _parts(batches):
        own = part.block >= 0
        key, n = np.unique(part.terms()[own] << 32 | part.block[own], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array(key & (2**32 - 1)), pa.array(n.astype(np.int64))], names=["code", "block", "n"])


def _rounds(size: np.ndarray) -> Iterator[np.ndarray]:
    """Codes in groups of bounded size; those without any are left out."""
    held, total = [], 0
    for code in np.flatnonzero(size > 0).tolist():
        if held and total + size[code] > ROUND:
            yield np.array(held)
            held, total = [], 0
        held.append(code)
        total += size[code]
    if held:
        yield np.array(held)


def _largest(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each key."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[first], np.maximum.reduceat(value, first)) if len(key) else (key, value)


def _peaking(asked):  # noqa: ANN001, ANN202
    """For each list that is asked for a row with the largest values of the components in each block, of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, blocks, n = asked.value
        base = np.concatenate([[0], np.cumsum(blocks.astype(np.int64))])
        dense = np.zeros((int(base[-1]), n)) if int(base[-1]) * n <= 2 * CELLS else None
        held, rows = [], 0

        def cut() -> None:
            nonlocal held, rows
            held = [_largest(*(np.concatenate(c) for c in zip(*held, strict=True)))]
            rows = len(held[0][0])

        for part in _parts(batches):
            own = None
            for code, a, b in part.runs():
                i = int(np.searchsorted(codes, code))
                member = np.flatnonzero(part.block[a:b] >= 0)
                if i == len(codes) or codes[i] != code or not len(member):
                    continue
                own = own or part.rows()
                order = member[np.argsort(part.block[a:b][member], kind="stable")]
                column, block = part.column[a:b][order], part.block[a:b][order]
                if dense is not None:
                    terms, values = _matrix(*own, column, float)
                    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                    cells = np.ix_(base[i] + block[first], terms)
                    dense[cells] = np.maximum(dense[cells], np.maximum.reduceat(values, first, axis=0))
                    continue
                take, of = _gathered(np.concatenate([[0], own[0][:-1]])[column], own[0][column])
                held.append(_largest((base[i] + block[of]) * n + own[1][take], own[2][take]))
                rows += len(held[-1][0])
                if rows > 2 * CELLS and rows > 2 * len(held[0][0]):
                    cut()
        if dense is not None:
            key = np.flatnonzero(dense)
            value = dense.ravel()[key]
        elif held:
            cut()
            key, value = held[0]
        else:
            return
        ends = np.searchsorted(key, base * n)
        for i, code in enumerate(codes.tolist()):
            lo, hi = int(ends[i]), int(ends[i + 1])
            if hi > lo:
                yield pa.RecordBatch.from_arrays([pa.array([code], pa.int32()), pa.array([_pack(key[lo:hi] // n - base[i], key[lo:hi] % n, value[lo:hi])], pa.binary())], names=["code", "data"])

    return run


def _summing(energy: float):  # noqa: ANN202
    """Puts together what tasks told of a list's blocks; a summary keeps the largest values up to a share of their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(x.to_pylist() for x in batch.columns), strict=True))
        for code, own in itertools.groupby(rows, key=lambda r: r[0]):
            block, term, value = (np.concatenate(c) for c in zip(*(_unpack(data) for _, data in own), strict=True))
            key, value = _largest(block << 32 | term, value)
            block, term = key >> 32, key & (2**32 - 1)
            order = np.lexsort((term, -value, block))
            block, term, value = block[order], term[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            of = np.repeat(np.arange(len(first)), np.diff([*first, len(block)]))
            before = np.cumsum(value) - value
            kept = before - before[first][of] < energy * np.add.reduceat(value, first)[of]
            kept[first] = True
            yield pa.RecordBatch.from_arrays([pa.array([code], pa.int32()), pa.array([_pack(block[kept], term[kept], value[kept])], pa.binary())], names=["code", "data"])

    return run


@dataclass
class Asked:
    """A group of queries by term: for each code the places and weights of its queries, and which of them read its list."""

    n: int
    codes: np.ndarray
    lists: np.ndarray
    place: np.ndarray
    factor: np.ndarray
    reads: np.ndarray

    def of(self, code: int) -> slice:
        i = int(np.searchsorted(self.codes, code))
        return slice(int(self.lists[i]), int(self.lists[i + 1])) if i < len(self.codes) and self.codes[i] == code else slice(0, 0)

    def own(self, code: int) -> np.ndarray:
        """The queries that rows of bits of a list are for: all of them, where many read it."""
        at = self.of(code)
        some = self.place[at][self.reads[at]]
        return some if 8 * len(some) < self.n else np.arange(self.n if len(some) else 0)


def _asked(batch: Batch, names: pa.Array, codes: np.ndarray, sizes: np.ndarray, query_cut: int) -> Iterator[tuple[Asked, pa.Array]]:
    """Groups of a batch's queries, of bounded size, and their qids."""
    texts = batch.names.cast(pa.string())
    order = np.argsort(np.array([t.encode() for t in texts.to_pylist()], object), kind="stable")
    by_name = np.empty(len(order), np.int64)
    by_name[order] = np.arange(len(order))
    at = pa.compute.index_in(texts, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False) if len(texts) else np.zeros(0, np.int64)
    code = np.where(at >= 0, codes[at], -1) if len(codes) else np.full(len(at), -1)
    of = np.repeat(np.arange(len(texts)), np.diff(batch.lists))
    order = np.lexsort((by_name[of], -batch.factor, batch.place))
    place, factor, term = batch.place[order].astype(np.int64), batch.factor[order], code[of[order]]
    rank = np.arange(len(place)) - np.searchsorted(place, place)
    reads = (rank < query_cut) & (term >= 0)
    cost = np.bincount(place[reads], sizes[term[reads]], minlength=len(batch.qids)).astype(np.int64)
    lo = 0
    while lo < len(cost):
        hi = lo + max(1, min(GROUP, int(np.searchsorted(np.cumsum(cost[lo : lo + GROUP]), BITS, "right"))))
        own = np.flatnonzero((place >= lo) & (place < hi) & (term >= 0))
        own = own[np.lexsort((place[own], term[own]))]
        some, first = np.unique(term[own], return_index=True)
        yield Asked(min(hi, len(cost)) - lo, some, np.append(first, len(own)), (place[own] - lo).astype(np.int32), factor[own], reads[own]), batch.qids.slice(lo, hi - lo)
        lo = hi


def _opening(sent, floor: np.ndarray | None, heap_factor: float):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = sent.value
        limit = np.where(np.isneginf(floor), -np.inf, heap_factor * np.maximum(floor, 0)) if floor is not None else None
        for batch in batches:
            for code, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                at = asked.of(code)
                readers = asked.place[at][asked.reads[at]]
                if not len(readers):
                    continue
                block, term, value = _unpack(data)
                there, row = np.unique(block, return_inverse=True)
                terms, column = np.unique(term, return_inverse=True)
                summary = np.zeros((len(terms), len(there)))
                summary[column, row] = value
                own = asked.own(code)
                reads = np.zeros(asked.n, bool)
                reads[readers] = True
                wide = -(-len(own) // 8)
                bits = np.zeros((int(there[-1]) + 1, wide), np.uint8)
                step = max(8, CELLS // max(len(there), len(terms)) // 8 * 8)
                for lo in range(0, len(own), step):
                    queries = own[lo : lo + step]
                    spot = np.full(asked.n, -1)
                    spot[queries] = np.arange(len(queries))
                    weights = np.zeros((len(queries), len(terms)))
                    for j, t in enumerate(terms.tolist()):
                        of = asked.of(t)
                        r = spot[asked.place[of]]
                        weights[r[r >= 0], j] = asked.factor[of][r >= 0]
                    score = weights @ summary
                    opened = score >= limit[queries][:, None] if limit is not None else np.zeros(score.shape, bool)
                    opened[np.arange(len(queries)), score.argmax(axis=1)] = True
                    opened[~reads[queries]] = False
                    bits[there, lo // 8 : lo // 8 + -(-len(queries) // 8)] = np.packbits(opened.T, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([code], pa.int32()), pa.array([wide], pa.int64()), pa.array([_pack(bits.ravel().view(np.int8))], pa.binary())], names=["code", "bytes", "bits"])

    return run


def _scoring(sent, opened, k: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = sent.value
        bits = {c: (asked.own(c), _unpack(b)[0].astype(np.uint8).reshape(-1, wide)) for c, (wide, b) in opened.value.items()}
        best = Best(asked.n, k)
        of = np.full(int(asked.codes.max(initial=0)) + 1, -1)
        of[asked.codes] = np.arange(len(asked.codes))
        for part in _parts(batches):
            full, few = np.zeros((len(part.docs), -(-asked.n // 8)), np.uint8), []
            for code, a, b in part.runs():
                if code not in bits:
                    continue
                own, rows = bits[code]
                member = np.flatnonzero(part.block[a:b] >= 0)
                column, block = part.column[a:b][member], part.block[a:b][member]
                if len(own) == asked.n:
                    full[column] |= rows[block]
                else:
                    few.append((column, block, own, rows))
            mask = np.unpackbits(full, axis=1, count=asked.n).astype(bool)
            for column, block, own, rows in few:
                i, j = np.nonzero(np.unpackbits(rows[block], axis=1, count=len(own)))
                mask[column[i], own[j]] = True
            some = mask.any(axis=1)
            term = part.terms()
            take = some[part.column] & (term < len(of))
            if not take.any():
                continue
            take &= of[np.minimum(term, len(of) - 1)] >= 0
            docs = np.cumsum(some) - 1
            yield from added(of, asked.lists, asked.place, asked.factor, asked.n, None, best, term[take], part.docs[some], docs[part.column[take]], part.value[take], mask=mask[some].T, cells=CELLS)
        yield from best.rest()

    return run
