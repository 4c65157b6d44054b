"""Substring deduplication: level-wise doubling of repeated windows of words.

Windows are tried at a quarter of the wanted length, then at half of it, then at the whole of it. At each level windows
that occur in one document alone go, and only starts whose window repeats are extended to twice the length, until no
candidates survive or the wanted length is reached. A window of the wanted length can only repeat if all shorter
windows within it do, so below that length one of them is enough: the one with the smallest hash, which equal texts
choose alike. This keeps a tenth of the starts or so in the first level.

Whole copies of a document's words are found first, by one digest per document: all of a later copy's windows start
in the first one. They take no part in the levels, which keeps groups of thousands of copies out of the shuffles.

Shorter levels compare 64-bit hashes, where two windows of one hash merely go on as candidates. What is removed, whole
copies and windows of the wanted length, is compared by cryptographic digests (BLAKE2b, 128 bits) of the words
themselves. Defined cases: a null or empty text has no words; texts shorter than a window are kept as they are; each
row is reported and judged on its own text, also where rows share a doc_id (their windows never remove each other);
rows without doc_id come neither before nor after others and are kept whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import _store, _text

WINDOW = 50
#: How often the wanted length is halved for the shorter levels.
HALVINGS = 2


def lengths(width: int) -> list[int]:
    """The levels' lengths, each at most twice the one before."""
    out = [width]
    while out[0] > 1 and len(out) <= HALVINGS:
        out.insert(0, -(-out[0] // 2))
    return out


class _Words:
    """Words of a chunk of texts: their rows, hashes, and their bytes with one space between."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        first, last, self.doc = _text.spans(data, bounds, _text.NON_SPACE)
        self.hashes = _text.hash_spans(data, first, last)
        word = _text.NON_SPACE[data]
        keep = word.copy()
        keep[last[last < len(data)]] = True
        place = np.cumsum(keep)
        self.first, self.last = place[first] - 1, place[last - 1]
        self.raw = memoryview(np.where(word, data, np.uint8(0x20))[keep].tobytes())

    def digests(self, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        """Of the words [start, end) of one text each."""
        return [hashlib.blake2b(self.raw[a:b], digest_size=16).digest() for a, b in zip(self.first[start].tolist(), self.last[end - 1].tolist(), strict=True)]

    def starts(self, width: int) -> np.ndarray:
        """Where a window lies within one text."""
        n = max(0, len(self.doc) - width + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[width - 1 : width - 1 + n])

    def least(self, width: int, length: int) -> np.ndarray:
        """The smallest hash of windows of the length in each window of the width."""
        return _text.sliding(_text.windows(self.hashes, length), width - length + 1, np.minimum)


def _levels(width: int, shorter: list[int]):
    """Per text of at least a window: the digest of all its words and the distinct choices of the shorter levels."""
    names = [f"l{k}" for k in range(len(shorter))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in _text.chunks(batch.column(2)):
                words = _Words(data, bounds)
                start = words.starts(width)
                doc = words.doc[start]
                levels = [words.least(width, n)[start] for n in shorter]
                order = np.lexsort((*levels, doc))
                doc, levels = doc[order], [x[order] for x in levels]
                new = np.ones(len(doc), bool)
                new[1:] = np.any([x[1:] != x[:-1] for x in (doc, *levels)], axis=0)
                doc, levels = doc[new], [x[new] for x in levels]
                size = np.bincount(words.doc, minlength=to - at)
                begin = np.cumsum(size) - size
                some = np.flatnonzero(size >= width)
                whole = words.digests(begin[some], begin[some] + size[some])
                ends = np.searchsorted(doc, [*some, to - at]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in levels], names))
                take = pa.array(some + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(whole, pa.binary()), lists], names=["row", "doc_id", "whole", "levels"])

    return run


def _windows(width: int, length: int):
    """Windows of the width whose choice at the last shorter level survived, by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in _text.chunks(batch.column(2)):
                words = _Words(data, bounds)
                start = words.starts(width)
                column = batch.column(3).slice(at, to - at)
                known = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(to - at), np.asarray(column.value_lengths().fill_null(0)))
                doc = words.doc[start]
                keep = np.isin(_text.pair(words.least(width, length)[start], doc.astype(np.uint64)), _text.pair(known, owner.astype(np.uint64)))
                start, doc = start[keep], doc[keep]
                size = np.bincount(words.doc, minlength=to - at)
                begin = np.cumsum(size) - size
                found = np.frombuffer(b"".join(words.digests(start, start + width)), np.int64).reshape(-1, 2)
                take = pa.array(doc + at)
                columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array((start - begin[doc]).astype(np.int32)), pa.array(found[:, 0]), pa.array(found[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "at", "w0", "w1"])

    return run


def _cut(width: int, texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, starts, copy = (batch.column(i) for i in range(4))
            kept, removed, size, spans = [], [], [], []
            for text, at, all_of_it in zip(texts, starts, copy.to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                words = raw.split()  # of bytes: \x20\x09-\x0D
                gone = np.zeros(len(words), bool)
                if all_of_it:
                    gone[:] = True
                elif at.is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    where = at.values.to_numpy()
                    where = where[where + width <= len(words)]
                    edge[where] += 1  # starts are distinct, but ends are too
                    edge[where + width] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                size.append(len(words))
                removed.append(int(gone.sum()))
                change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"first": int(a), "last": int(b)} for a, b in zip(change[::2], change[1::2], strict=True)])
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array([k.decode() if texts_too else "" for k in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"],
            )

    return run


def removals(rows: DataFrame, row: str, width: int = WINDOW) -> DataFrame:
    """Of rows with numbers, per row with anything to remove: row, copy (all of its words go) and starts of repeated windows."""
    _store.ship(rows.sparkSession)
    rows = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    shorter = lengths(width)[:-1] or [width]
    names = [f"l{k}" for k in range(len(shorter))]
    prints = _store.written(rows.mapInArrow(_levels(width, shorter), f"row bigint, doc_id bigint, whole binary, levels array<struct<{','.join(n + ':bigint' for n in names)}>>"))
    firsts = prints.groupBy("whole").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("whole", "first")
    firsts = _store.written(firsts)  # so that the join may split a hot group of copies
    copies = _store.written(prints.join(firsts, "whole").where("doc_id > first").select("row"))
    found = copies.select("row", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy"))
    # One level after the other: choices that more than one document has go on.
    alive = prints.join(copies, "row", "left_anti").select("row", "doc_id", F.inline("levels"))
    shared = []
    for name in names:
        own = _store.written(alive.groupBy(name).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select(name))
        shared.append(own)
        if not own.limit(1).count():  # no candidates survive
            return _store.written(found)
        alive = alive.join(own, name)
    candidates = alive.groupBy("row").agg(F.collect_set(names[-1]).alias("known"))
    candidates = _store.written(candidates)
    _store.forget(prints, firsts, *shared)
    windows = _store.written(rows.join(candidates, "row").select("row", "doc_id", "text", "known").mapInArrow(_windows(width, shorter[-1]), "row bigint, doc_id bigint, at int, w0 bigint, w1 bigint"))
    _store.forget(candidates)
    first = _store.written(windows.groupBy("w0", "w1").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w0", "w1", "first"))
    later = windows.join(first, ["w0", "w1"]).where("doc_id > first").groupBy("row").agg(F.array_sort(F.collect_set("at")).alias("starts"))
    found = _store.written(found.unionByName(later.select("row", "starts", F.lit(False).alias("copy"))))
    _store.forget(copies, windows, first)
    return found


def dedup(docs: DataFrame, width: int = WINDOW, texts_too: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, spans of removed words [first, last) and the kept text, if wanted."""
    rows, row = _store.numbered(docs.select("doc_id", "text"))
    found = removals(rows, row, width).withColumnRenamed("row", row)
    joined = rows.join(found, row, "left").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), "starts", F.coalesce("copy", F.lit(False)).alias("copy"))
    return joined.mapInArrow(_cut(width, texts_too), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<first:bigint,last:bigint>>, kept string")


def report(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """The digest per document: doc_id, n_words, n_removed, kept_sha256."""
    return dedup(docs, width, texts_too=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
