"""Collections in segments: immutable indexes that are searched as one, with filters of their own."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.scoring import Model, Stats
from tarn.operators.index import Index
from tarn.operators.search import DocSet, batches, candidates, doc_set, filtered, top

ALGORITHMS = ("maxscore", "wand")


class SegmentedIndex:
    """Several indexes; their documents may share numbers, results name the segment by its place."""

    def __init__(self, segments: list[Index]):
        if not segments or any(not isinstance(s, Index) for s in segments):
            raise TypeError("a segmented index needs a list of indexes")
        self.segments = segments

    def __len__(self) -> int:
        return len(self.segments)

    def postings(self, deleted: list[DocSet] | None = None, allowed: list[DocSet] | None = None, positions: bool = False) -> DataFrame:
        """All postings with their segment, filtered by each segment's own sets."""
        out = None
        for rows in self._rows(deleted, allowed, positions):
            out = rows if out is None else out.unionByName(rows)
        return out

    def _rows(self, deleted: list[DocSet] | None = None, allowed: list[DocSet] | None = None, positions: bool = False) -> list[DataFrame]:
        """The postings of each segment, filtered by its own sets."""
        for name, sets in (("deleted", deleted), ("allowed", allowed)):
            if sets is not None and len(sets) != len(self.segments):
                raise ValueError(f"'{name}' has {len(sets)} entries for {len(self.segments)} segments")
        out = []
        for i, s in enumerate(self.segments):
            rows = filtered(s.postings, doc_set(s, deleted[i] if deleted else None), doc_set(s, allowed[i] if allowed else None))
            out.append(rows.select(F.lit(i).alias("segment"), "term", "doc_id", F.col("value").cast("double").alias("value"), "dl", *(["positions"] if positions else [])))
        return out

    def stats(self) -> Stats:
        """Of all segments together."""
        every = [s.stats() for s in self.segments]
        n = sum(s.n for s in every)
        return Stats(n, sum(s.avgdl * s.n for s in every) / n if n else 0.0, min(s.min_dl for s in every))

    def search(self, queries: DataFrame, k: int = 10, model: Model | None = None, deleted: list[DocSet] | None = None, allowed: list[DocSet] | None = None, algorithm: str = "maxscore") -> DataFrame:
        """qid, rank, segment, doc_id, score. Statistics of a model are those of all segments together."""
        if algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm '{algorithm}', expected one of: {', '.join(ALGORITHMS)}")
        if k < 1:
            raise ValueError("k must be at least 1")
        model, stats = model or self.segments[0].model, self.stats()
        rows = self._rows(deleted, allowed)
        merged = queries.groupBy("qid", "term").agg(F.sum("weight").alias("weight"))
        if model.needs_df:
            every = self.postings()
            merged = model.query_weights(merged.join(every.groupBy("term").agg(F.count("*").alias("df")), "term"))
            merged = merged.select("qid", "term", (F.col("weight") * model.term_factor(F.col("df"), stats)).alias("factor"))
        else:
            merged = model.query_weights(merged).select("qid", "term", F.col("weight").cast("double").alias("factor"))
        part, batch, scored = model.posting_factor(F.col("value"), F.col("dl"), stats), list(batches(merged)), None
        for i in range(len(self.segments)):
            own = candidates(rows[i], part, batch, k).withColumn("segment", F.lit(i))
            scored = own if scored is None else scored.unionByName(own)
        return top(scored, k, ("segment", "doc_id")).select("qid", "rank", "segment", "doc_id", "score")

    def merged(self) -> Index:
        """One index of all segments: of a document's versions the later segment's counts, also if that has no terms.

        Positions stay if every segment has them; otherwise the index says that it has none.
        """
        positions = all(s.options.positions for s in self.segments)
        versions = None
        for i, s in enumerate(self.segments):
            own = s.docs.select("doc_id", F.struct(F.lit(i).alias("segment"), "dl").alias("version"))
            versions = own if versions is None else versions.unionByName(own)
        latest = versions.groupBy("doc_id").agg(F.max("version").alias("version")).select("doc_id", "version.segment", "version.dl")
        kept = self.postings(positions=positions).join(latest.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
        kept = kept.select("term", "doc_id", "value", "dl", F.col("positions") if positions else F.lit(None).cast("array<int>").alias("positions"))
        first = self.segments[0]
        return replace(first, postings=kept, docs=latest.select("doc_id", "dl"), options=replace(first.options, positions=positions), _terms=None, _stats=None)
