"""Indexes: postings and document lengths, built from texts, tokens or impacts, as DataFrames.

A posting carries its document's length, so that scoring joins postings with the terms of the queries and nothing
else: the one shuffle of a search is the sum by query and document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn import schema
from tarn.functions.scoring import Dot, Model, Stats
from tarn.plans.analyzer import Analyzer


@dataclass(frozen=True)
class BuildOptions:
    """block_size: postings in a block; positions: keep them; dtype: the type in which values are stored."""

    block_size: int = 128
    positions: bool = False
    dtype: str = "float32"

    def __post_init__(self) -> None:
        if self.dtype not in schema.DTYPES:
            raise ValueError(f"unknown dtype '{self.dtype}', expected one of: {', '.join(schema.DTYPES)}")
        if self.block_size < 1:
            raise ValueError("block_size must be at least 1")


@dataclass
class Index:
    """postings (term, doc_id, value, dl, positions) and docs (doc_id, dl) of the documents there are; see dense() for gaps."""

    postings: DataFrame
    docs: DataFrame
    analyzer: Analyzer | None = None
    options: BuildOptions = field(default_factory=BuildOptions)
    model: Model = field(default_factory=Dot)
    info: dict = field(default_factory=dict)
    _terms: DataFrame | None = None
    _stats: Stats | None = None

    @property
    def spark(self):  # noqa: ANN201
        return self.postings.sparkSession

    @property
    def terms(self) -> DataFrame:
        """Per term: df, cf, max_value, max_doc_id, min_dl."""
        if self._terms is None:
            self._terms = term_statistics(self.postings)
        return self._terms

    def stats(self) -> Stats:
        """n (largest document number + 1), average and least length, numbers without a document being empty ones: one row on the driver."""
        if self._stats is None:
            row = self.docs.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), F.coalesce(F.min("dl"), F.lit(0)).alias("min_dl"), F.count("*").alias("docs")).first()
            self._stats = Stats(row["n"], row["total"] / row["n"] if row["n"] else 0.0, row["min_dl"] if row["docs"] == row["n"] else 0)
        return self._stats

    def with_scoring(self, model: Model) -> Index:
        return replace(self, model=model)

    def persisted(self) -> Index:
        """Keeps postings and lengths, which many searches read, in memory and on disk."""
        return replace(self, postings=self.postings.persist(StorageLevel.MEMORY_AND_DISK), docs=self.docs.persist(StorageLevel.MEMORY_AND_DISK), _terms=None)

    # --- what a reader asks of an index

    def postings_of(self, term: str | int) -> DataFrame:
        """doc_id, value (and positions) of one term, by document."""
        columns = ["doc_id", "value", *(["positions"] if self.options.positions else [])]
        return self.postings.where(F.col("term") == str(term)).select(*columns).orderBy("doc_id")

    def term_row(self, term: str | int) -> dict:
        """df, max_value and max_doc_id of one term; zeros where it is unknown."""
        row = self.terms.where(F.col("term") == str(term)).first()
        return {"df": 0, "max_value": 0.0, "max_doc_id": None} if row is None else {k: row[k] for k in ("df", "max_value", "max_doc_id")}

    def value_range(self, term: str | int) -> tuple[float, float]:
        """(0, largest value): the least value is zero by convention."""
        return 0.0, float(self.term_row(term)["max_value"])

    def num_terms(self) -> int:
        """Distinct terms; for numbered terms, one more than the largest number."""
        if self.info.get("numbered"):
            return int(self.postings.agg(F.coalesce(F.max(F.col("term").cast("bigint")) + 1, F.lit(0)).alias("n")).first()["n"])
        return self.postings.select("term").distinct().count()

    def max_doc_id(self) -> int | None:
        return self.postings.agg(F.max("doc_id").alias("m")).first()["m"]

    def vocabulary(self) -> DataFrame:
        """term, term_id: numbered by first occurrence (document, then position or term).

        The ranking runs over one row for each term, in ranges of first occurrence, never in one task.
        """
        place = F.get("positions", F.lit(0)) if self.options.positions else F.lit(None).cast("int")
        first = self.postings.groupBy("term").agg(F.min(F.struct("doc_id", place.alias("pos"), "term")).alias("at"))
        return numbered(first, ["at"], "term_id").select("term", "term_id")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with a dense number from 0 in the order of columns: ranges are ranked apart and shifted by the counts before."""
    parts = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    shift = F.create_map(*(F.lit(x).cast("bigint") for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(name, rank.cast("bigint") + F.try_element_at(shift, F.col("_part").cast("bigint"))).drop("_part")


def term_statistics(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum(F.col("value").cast("double")).alias("cf"), F.max(F.col("value").cast("double")).alias("max_value"), F.max("doc_id").alias("max_doc_id"), F.min("dl").alias("min_dl")
    )


def dense(lengths: DataFrame) -> DataFrame:
    """doc_id, dl for every number from 0 to the largest; gaps have length 0."""
    top = lengths.agg(F.max("doc_id").alias("m")).first()["m"]
    every = lengths.sparkSession.range(0, 0 if top is None else top + 1).withColumnRenamed("id", "doc_id")
    return every.join(lengths, "doc_id", "left").select("doc_id", F.coalesce(F.col("dl").cast("int"), F.lit(0)).alias("dl"))


def _stored(value: Column, options: BuildOptions) -> Column:
    return value.cast(schema.DTYPES[options.dtype])


def from_text(docs: DataFrame, analyzer: Analyzer, options: BuildOptions | None = None, key: str = "doc_id", text: str = "text", store: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """Terms, frequencies and, if wanted, positions of texts. dl counts the terms that stay, once each occurrence.

    store: writes postings and reads them back (see sources.store); statistics then come from what was written and
    texts are analysed once. Without it they are kept by persist().
    """
    options = options or BuildOptions(dtype="int32")
    keep = store or (lambda df: df.persist(StorageLevel.MEMORY_AND_DISK))
    docs = docs.where(F.col(key).isNotNull())
    ids = docs.select(F.col(key).cast("bigint").alias("doc_id")).where("doc_id is not null")
    postings = counted(analyzer.arrays(docs, key, text), options.positions)
    once = ids.distinct()
    if ids.count() != once.count():  # texts that share a number are one document
        places = F.array_sort(F.flatten(F.collect_list("positions"))) if options.positions else F.lit(None).cast("array<int>")
        postings = postings.groupBy("term", "doc_id").agg(F.sum("value").cast("int").alias("value"), F.max("dl").alias("dl"), places.alias("positions"))
    postings = keep(postings.withColumn("value", _stored(F.col("value"), options)))  # counted from tokens, so there is nothing to check
    return Index(postings, keep(lengths_of(once, postings)), analyzer, options)


def counted(rows: DataFrame, positions: bool) -> DataFrame:
    """Postings of arrays of terms (a number and the array), counted where each array is: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sizes = part.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = part.column(1).flatten()
                text = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                some = np.asarray(flat.is_valid())
                coded = flat.drop_null().dictionary_encode()
                text, place, code = text[some], place[some], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                key = text * max(1, len(coded.dictionary)) + code
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
                ends = np.concatenate([first, [len(key)]]).astype(np.int32)
                of = order[first]
                lengths = np.bincount(text, minlength=len(sizes)).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32))) if positions else pa.nulls(len(first), pa.list_(pa.int32()))
                columns = [coded.dictionary.take(pa.array(code[of])), part.column(0).take(pa.array(text[of])), pa.array(np.diff(ends).astype(np.int32)), pa.array(lengths[text[of]]), places]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "value", "dl", "positions"])

    return rows.mapInArrow(run, "term string, doc_id bigint, value int, dl int, positions array<int>")


def lengths_of(ids: DataFrame, postings: DataFrame) -> DataFrame:
    """doc_id, dl of documents; those without a posting have length 0."""
    known = postings.groupBy("doc_id").agg(F.max("dl").alias("dl"))
    return ids.join(known, "doc_id", "left").select("doc_id", F.coalesce(F.col("dl").cast("int"), F.lit(0)).alias("dl"))


def from_tokens(docs: DataFrame, options: BuildOptions | None = None) -> Index:
    """doc_id, terms (array) and values (array) of counted tokens; dl sums the whole parts of the values."""
    options = options or BuildOptions(dtype="int32")
    return _from_arrays(docs, options)


def from_impacts(docs: DataFrame, options: BuildOptions | None = None, keep: bool = True) -> Index:
    """doc_id, terms (array) and values (array) of learned impacts; values must be above zero and terms unique in a document.

    keep: whether postings are kept by persist(); they needn't be if docs are cheap to read and the index is saved at once.
    """
    return _from_arrays(docs, options or BuildOptions(), keep)


def from_positions(docs: DataFrame) -> Index:
    """doc_id, terms (array) and positions (array of arrays): the value is the number of positions."""
    pairs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(F.arrays_zip("terms", "positions")).alias("x"))
    rows = pairs.select(F.col("x.terms").cast("string").alias("term"), "doc_id", F.size("x.positions").cast("double").alias("value"), F.col("x.positions").cast("array<int>").alias("positions"))
    return _finish(rows, docs, BuildOptions(positions=True, dtype="int32"))


def _from_arrays(docs: DataFrame, options: BuildOptions, keep: bool = True) -> Index:
    same = F.size("terms") == F.size("values")
    if not keep and docs.agg((F.count("doc_id") == F.countDistinct("doc_id")) & (F.count("*") == F.count("doc_id"))).first()[0]:
        # Each document is one row, which tells all of its postings: nothing is shuffled.
        whole = F.when(~same, F.raise_error(F.lit("terms and values differ in length"))).when(F.size(F.array_distinct("terms")) < F.size("terms"), F.raise_error(F.lit("a term occurs more than once in a document")))
        length = F.aggregate("values", F.lit(0.0), lambda a, x: a + F.floor(x.cast("double"))).cast("int")
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole.otherwise(F.arrays_zip("terms", "values")).alias("x"), length.alias("dl"))
        lengths = rows.select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"))
        rows = rows.select("doc_id", "dl", F.explode("x").alias("x")).select(F.col("x.terms").cast("string").alias("term"), "doc_id", F.col("x.values").cast("double").alias("value"), "dl")
        postings = schema.check_postings(rows).select("term", "doc_id", _stored(F.col("value"), options).alias("value"), "dl", F.lit(None).cast("array<int>").alias("positions"))
        return Index(postings, lengths, None, options, info={"numbered": dict(docs.dtypes)["terms"] in ("array<int>", "array<bigint>")})
    pairs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(F.when(same, F.arrays_zip("terms", "values")).otherwise(F.raise_error(F.lit("terms and values differ in length")))).alias("x"))
    rows = pairs.select(F.col("x.terms").cast("string").alias("term"), "doc_id", F.col("x.values").cast("double").alias("value"), F.lit(None).cast("array<int>").alias("positions"))
    index = _finish(rows, docs, options)
    index.info["numbered"] = dict(docs.dtypes)["terms"] in ("array<int>", "array<bigint>")
    return index


def _finish(rows: DataFrame, docs: DataFrame, options: BuildOptions) -> Index:
    """One aggregation finds repeated terms and sums lengths; nothing else passes over the rows."""
    once = rows.groupBy("term", "doc_id").agg(F.count("*").alias("n"), F.max("value").alias("value"), F.any_value("positions").alias("positions"))
    once = once.withColumn("value", schema.demand(F.col("n") == 1, F.col("value"), "a term occurs more than once in a document"))
    total = F.sum(F.floor("value")).over(Window.partitionBy("doc_id"))
    columns = schema.check_postings(once if options.positions else once.drop("positions"))
    postings = columns.select("term", "doc_id", _stored(F.col("value"), options).alias("value"), total.cast("int").alias("dl"), F.col("positions") if options.positions else F.lit(None).cast("array<int>").alias("positions"))
    postings = postings.persist(StorageLevel.MEMORY_AND_DISK)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    return Index(postings, lengths_of(ids, postings).persist(StorageLevel.MEMORY_AND_DISK), None, options)
