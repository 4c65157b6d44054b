"""Incremental collections: a stream of documents becomes segments and tombstones; searches see the latest versions.

A micro-batch is one segment, written under the batch's number, so that a batch that runs again replaces what it
wrote. Documents carry a version; of two versions the larger counts, whenever it arrives.

Tables under the root: postings/segment=N, docs/segment=N (doc_id, dl, version), tombstones/segment=N (doc_id, version).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tarn.functions.scoring import Model
from tarn.operators.index import BuildOptions, Index, from_text
from tarn.operators.search import search
from tarn.plans.analyzer import Analyzer

_POSTINGS = "term string, doc_id bigint, value int, dl int, version bigint, segment int"
_DOCS = "doc_id bigint, dl int, version bigint, segment int"
_TOMBSTONES = "doc_id bigint, version bigint, segment int"


class Incremental:
    """An incrementally maintained collection under a root directory."""

    def __init__(self, spark: SparkSession, root: str, analyzer: Analyzer):
        self.spark, self.root, self.analyzer = spark, root.rstrip("/"), analyzer

    def _read(self, name: str, columns: str) -> DataFrame:
        try:
            return self.spark.read.schema(columns).parquet(f"{self.root}/{name}")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], columns)

    def write_segment(self, batch: DataFrame, segment: int) -> None:
        """doc_id, text, version, deleted (boolean): one segment, the same result each time it is written."""
        latest = batch.groupBy("doc_id").agg(F.max_by(F.struct("text", "version", "deleted"), "version").alias("x")).select("doc_id", "x.*")
        live = latest.where("not coalesce(deleted, false)")
        index = from_text(live.select("doc_id", "text"), self.analyzer, BuildOptions(dtype="int32"))
        versions = live.select("doc_id", "version")
        index.postings.join(versions, "doc_id").select("term", "doc_id", "value", "dl", "version").write.mode("overwrite").parquet(f"{self.root}/postings/segment={segment}")
        versions.join(index.postings.groupBy("doc_id").agg(F.max("dl").alias("dl")), "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"), "version").write.mode("overwrite").parquet(f"{self.root}/docs/segment={segment}")
        latest.where("deleted").select("doc_id", "version").write.mode("overwrite").parquet(f"{self.root}/tombstones/segment={segment}")
        index.postings.unpersist()
        index.docs.unpersist()

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch."""

        def each(batch: DataFrame, number: int) -> None:
            kept = batch.persist()
            try:
                self.write_segment(kept, number)
            finally:
                kept.unpersist()

        return each

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:  # noqa: ANN003
        """Starts the stream (doc_id, text, version, deleted)."""
        return stream.writeStream.foreachBatch(self.sink()).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _latest(self) -> DataFrame:
        """doc_id, version, segment, dl and dead (whether it is a deletion) of each document's latest version."""
        docs = self._read("docs", _DOCS)
        dead = self._read("tombstones", _TOMBSTONES).select("doc_id", F.lit(None).cast("int").alias("dl"), "version", "segment")
        every = docs.select("doc_id", "dl", "version", "segment").unionByName(dead)
        # Of equal versions the later segment counts, and a deletion over a document.
        last = every.groupBy("doc_id").agg(F.max(F.struct("version", "segment", F.col("dl").isNull().alias("dead"), "dl")).alias("x"))
        return last.select("doc_id", "x.version", "x.segment", "x.dl", "x.dead")

    def current(self) -> DataFrame:
        """doc_id, version, segment, dl of each document's latest version that isn't deleted."""
        return self._latest().where("not dead").drop("dead")

    def index(self) -> Index:
        """What searches see."""
        now = self.current()
        postings = self._read("postings", _POSTINGS).join(now.select("doc_id", "segment", "version"), ["doc_id", "segment", "version"], "left_semi")
        rows = postings.select("term", "doc_id", "value", "dl", F.lit(None).cast("array<int>").alias("positions"))
        return Index(rows, now.select("doc_id", "dl"), self.analyzer, BuildOptions(dtype="int32"))

    def search(self, queries: DataFrame, k: int = 10, model: Model | None = None) -> DataFrame:
        return search(self.index(), queries, k, model)

    def search_with_buffer(self, queries: DataFrame, buffer: DataFrame, k: int = 10, model: Model | None = None) -> DataFrame:
        """Also over documents (doc_id, text) that aren't in a segment yet; they hide older versions."""
        base, extra = self.index(), from_text(buffer, self.analyzer, BuildOptions(dtype="int32"))
        fresh = buffer.select("doc_id").distinct()
        rows = base.postings.join(fresh, "doc_id", "left_anti").unionByName(extra.postings.select(*base.postings.columns))
        lengths = base.docs.join(fresh, "doc_id", "left_anti").unionByName(extra.docs.join(fresh, "doc_id", "left_semi"))
        return search(Index(rows, lengths, self.analyzer, base.options), queries, k, model)

    def merge(self) -> int:
        """Rewrites all segments as one, numbered after the last; old ones go once it is written.

        Deletions stay, with their versions: older data of a deleted document may still arrive.
        """
        from tarn.sources.store import _fs

        now = self.current()
        old = sorted(r["segment"] for r in self._read("docs", _DOCS).select("segment").unionByName(self._read("tombstones", _TOMBSTONES).select("segment")).distinct().collect())
        number = (old[-1] + 1) if old else 0
        kept = self._read("postings", _POSTINGS).join(now.select("doc_id", "segment", "version"), ["doc_id", "segment", "version"], "left_semi")
        kept.drop("segment").write.mode("overwrite").parquet(f"{self.root}/postings/segment={number}")
        now.select("doc_id", "dl", "version").write.mode("overwrite").parquet(f"{self.root}/docs/segment={number}")
        self._latest().where("dead").select("doc_id", "version").write.mode("overwrite").parquet(f"{self.root}/tombstones/segment={number}")
        for s in old:
            for name in ("postings", "docs", "tombstones"):
                fs, where = _fs(self.spark, f"{self.root}/{name}/segment={s}")
                fs.delete(where, True)
        self.spark.catalog.clearCache()
        return number


def standing(index: Index, queries: DataFrame, k: int, each: Callable[[DataFrame, int], None], checkpoint: str, model: Model | None = None, **trigger) -> StreamingQuery:  # noqa: ANN003
    """A stream of queries (qid, term, weight) answered batch by batch from an index."""
    return queries.writeStream.foreachBatch(lambda batch, n: each(search(index, batch, k, model), n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


__all__ = ["Incremental", "standing"]
