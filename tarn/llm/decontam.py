"""Benchmark decontamination with a distributed positional inverted index.

The index of the training texts is a table, sharded by document and stored once: each shard has a dictionary of its
words, and for every word the ascending positions of all its occurrences. A first pass over the dictionaries counts how
often the benchmark's terms occur in all shards together. Each window of the benchmark is then looked up from its
rarest term to its commonest: the positions of the rarest, less its offset in the window, are the candidates, which
are intersected with the offset-adjusted posting lists of the other terms. With slop 0 that is the exact phrase; with
slop > 0 each term may be up to slop words away from its place (proximity).

Words are compared as words, byte for byte. The benchmark is read in blocks of bounded size: one block at a time is on
the driver and broadcast, and its matches are written before the next; every block reads the one stored index.

Defined cases: a null or empty text has no words, and is returned with zeros; benchmark rows with a null item_id
or without words match nothing; rows that share an item_id count as one item; each row of the documents is judged and
returned for itself, also where its doc_id is null or repeated; other columns are ignored; with an empty benchmark
nothing is hit; an empty table gives an empty result. A document or item may be of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import _store, _text

WINDOW = 10
#: How far a term of a proximity match may be from its place.
NEAR = 2
#: Words of the benchmark that are sent to the workers at once, at most.
BLOCK_WORDS = 2_000_000

#: Bytes of texts in a shard of the index (a shard holds one text at least, of any length).
SHARD_BYTES = 1 << 20

_INDEX = "rows array<bigint>, doc_ids array<bigint>, sizes binary, words binary, word_ends binary, counts binary, positions binary"
_MATCHES = "row bigint, doc_id bigint, n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<bigint>, near array<bigint>"


class _Phrases:
    """The benchmark's windows as term numbers, by length."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        rows = pa.array([t for _, t in items], pa.large_string())
        ids, self.width = np.array([i for i, _ in items], np.int64), width
        _, _, data, bounds = next(_text.chunks(rows, 1 << 62), (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        doc, term, words = _text.word_codes(data, bounds, _text.ALNUM, _text.FOLD_ASCII)
        self.vocabulary = words.cast(pa.large_binary())
        size = np.bincount(doc, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        begin = np.cumsum(size) - size
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({min(width, int(s)) for s in size if s}):
            own = np.flatnonzero(size >= width if length == width else size == length)
            starts = np.concatenate([begin[i] + np.arange(size[i] - length + 1) for i in own])
            grams = term[starts[:, None] + np.arange(length)].astype(np.int64)
            both = np.unique(np.column_stack([grams, np.repeat(ids[own], size[own] - length + 1)]), axis=0)
            self.by_length[length] = both[:, :-1].astype(np.int32), both[:, -1], np.zeros(0, np.int8)

    def ordered(self, frequency: np.ndarray) -> _Phrases:
        """With the terms of each window from the rarest to the commonest; windows with a term that occurs nowhere go."""
        for length, (grams, item, _) in list(self.by_length.items()):
            some = frequency[grams].min(axis=1) > 0
            self.by_length[length] = grams[some], item[some], np.argsort(frequency[grams[some]], axis=1, kind="stable")
        return self


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _INDEX.split(", ")]
    for batch in batches:
        for at, to, data, bounds in _text.chunks(batch.column(2), SHARD_BYTES):
            doc, word, words = _text.word_codes(data, bounds, _text.ALNUM, _text.FOLD_ASCII)
            word = word.astype(np.uint16) if len(words) <= 1 << 16 else word
            counts = np.bincount(word, minlength=len(words)).astype(np.int32)
            lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            blobs = [np.bincount(doc, minlength=to - at).astype(np.int64), b"".join(words.to_pylist()), np.cumsum(lengths), counts, np.argsort(word, kind="stable").astype(np.int32 if len(word) < 1 << 31 else np.int64)]
            listed = [pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), batch.column(k).slice(at, to - at)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*listed, *(pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in blobs)], names=names)


def _terms(shard: dict, vocabulary: pa.Array) -> np.ndarray:
    """The term number of each word of a shard's dictionary, -1 for those that no benchmark text has."""
    ends = np.frombuffer(shard["word_ends"], np.int64)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(shard["words"])])
    return pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _frequencies(sent):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value.vocabulary
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for shard in batch.to_pylist():
                term, counts = _terms(shard, vocabulary), np.frombuffer(shard["counts"], np.int32)
                total[term[term >= 0]] += counts[term >= 0]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["term", "n"])

    return run


def _lookup(sent, slops: tuple[int, ...], rest: int = 1 << 21):  # noqa: ANN001, ANN202
    """Matches of each row of the shards: spans and items of the first slop, items of the second one if there is one."""

    def matches(phrases: _Phrases, slop: int, counts: np.ndarray, keys: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        begin = np.cumsum(counts) - counts
        for length, (grams, item, order) in phrases.by_length.items():
            rows = np.flatnonzero(counts[grams].min(axis=1) > 0) if len(grams) else []
            if not len(rows):
                continue
            rarest = order[rows, 0]
            seeds = grams[rows, rarest]
            lists = counts[seeds]
            cuts = np.searchsorted(np.cumsum(lists), np.arange(rest, int(lists.sum()) + rest, rest), "left") + 1
            for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True):
                lo, hi = int(lo), min(int(hi), len(rows))
                if lo >= hi:
                    continue
                of = np.repeat(np.arange(lo, hi), lists[lo:hi])
                within = np.arange(len(of)) - np.repeat(np.cumsum(lists[lo:hi]) - lists[lo:hi], lists[lo:hi])
                seed = keys[begin[seeds[of]] + within] - seeds[of] * span
                for shift in range(-slop, slop + 1):
                    own, place = of, seed - rarest[of] + shift
                    where = seed
                    for k in range(1, length):
                        offset = order[rows[own], k]
                        want = grams[rows[own], offset].astype(np.int64) * span + place + offset
                        found = np.searchsorted(keys, want - slop)
                        keep = keys[np.minimum(found, len(keys) - 1)] <= want + slop
                        keep &= found < len(keys)
                        own, place, where = own[keep], place[keep], where[keep]
                        if not len(own):
                            break
                    if len(own):
                        yield place, where, length, item[rows[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        gap = phrases.width + 2 * max(slops) + 1  # between texts, so that no match crosses from one to the next
        for batch in batches:
            for shard in batch.to_pylist():
                size, all_counts = np.frombuffer(shard["sizes"], np.int64), np.frombuffer(shard["counts"], np.int32).astype(np.int64)
                total = int(all_counts.sum())
                positions = np.frombuffer(shard["positions"], np.int32 if total and len(shard["positions"]) // total == 4 else np.int64)
                starts = np.cumsum(size) - size
                term = _terms(shard, phrases.vocabulary)
                known = np.flatnonzero(term >= 0)
                known = known[np.argsort(term[known])]
                counts = np.zeros(len(phrases.vocabulary), np.int64)
                counts[term[known]] = all_counts[known]
                lists = (np.cumsum(all_counts) - all_counts)[known]
                n = all_counts[known]
                at = positions[np.repeat(lists - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].astype(np.int64)
                span = total + (len(size) + 2) * gap
                keys = np.repeat(term[known], n) * span + at + np.searchsorted(starts, at, "right") * gap
                shifted = starts + (np.arange(len(size)) + 1) * gap
                edge, pairs = np.zeros(total + 1, np.int32), [[] for _ in slops]
                for which, slop in enumerate(slops):
                    for place, where, length, item in matches(phrases, slop, counts, keys, span) if len(keys) else ():
                        doc = np.searchsorted(shifted, where, "right") - 1
                        pairs[which].append(np.unique(np.column_stack([doc, item]), axis=0))
                        if which == 0:
                            place = place - (doc + 1) * gap
                            np.add.at(edge, np.maximum(place - slop, starts[doc]), 1)
                            np.add.at(edge, np.minimum(place + length + slop, starts[doc] + size[doc]), -1)
                covered = np.cumsum(edge) > 0
                covered[-1:] = False
                begins = np.concatenate([[False], covered])
                begins[starts[size > 0]] = False  # a run ends where its text ends
                change = np.flatnonzero(covered & ~begins[:-1])
                runs: list[list[dict]] = [[] for _ in size]
                if len(change):
                    stops = np.flatnonzero(~covered | np.isin(np.arange(len(covered)), starts[size > 0]))
                    ends = stops[np.searchsorted(stops, change, "right")]
                    for lo, hi, d in zip(change.tolist(), ends.tolist(), (np.searchsorted(starts, change, "right") - 1).tolist(), strict=True):
                        runs[d].append({"first": lo - int(starts[d]), "last": hi - int(starts[d])})
                lists = []
                for own in pairs:
                    items: list[list[int]] = [[] for _ in size]
                    for d, i in np.unique(np.concatenate(own), axis=0) if own else ():
                        items[d].append(int(i))
                    lists.append(items)
                kinds = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.int64())
                columns = [pa.array(shard["rows"], pa.int64()), pa.array(shard["doc_ids"], pa.int64()), pa.array(size), pa.array(runs, kinds[0]), pa.array(lists[0], kinds[1]), pa.array(lists[-1], kinds[1])]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _MATCHES.split(", ")])

    return run


def build_index(docs: DataFrame, row: str | None = None) -> DataFrame:
    """The stored index: a row for each shard, with its rows, doc_ids and lengths, its words, and count and ascending positions of every posting list.

    row: a column of numbers by which rows are told apart; without it they are numbered here.
    """
    _store.ship(docs.sparkSession)
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _store.written(rows.mapInArrow(_indexer, _INDEX))


def _blocks(benchmark: DataFrame, width: int, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of no more than block_words words (or twice as many characters); longer items come in pieces that share width - 1 words."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    block, size, most = [], 0, max(2 * block_words, 1)
    for r in items.toLocalIterator():
        parts = [r["text"]]
        if len(parts[0]) > most:
            places = [m.span() for m in re.finditer("[0-9A-Za-z\u0080-\U0010FFFF]+", parts[0])]
            step = max(1, block_words - width + 1)
            parts = [parts[0][places[i][0] : places[min(i + step + width - 1, len(places)) - 1][1]] for i in range(0, max(1, len(places) - width + 1), step)] if places else []
        for text in parts:
            if block and size + len(text) > most:
                yield block
                block, size = [], 0
            block.append((r["item_id"], text))
            size += len(text)
    yield block


def _looked_up(index: DataFrame, block: list[tuple[int, str]], width: int, slops: tuple[int, ...]):  # noqa: ANN202
    """Matches of all rows with one block of the benchmark, and what was broadcast for them."""
    context, phrases = index.sparkSession.sparkContext, _Phrases(block, width)
    sent = context.broadcast(phrases)
    counted = index.select("words", "word_ends", "counts").mapInArrow(_frequencies(sent), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sent.destroy()
    frequency = np.zeros(len(phrases.vocabulary), np.int64)
    for r in counted:  # no more than the block has terms
        frequency[r["term"]] = r["n"]
    sent = context.broadcast(phrases.ordered(frequency))
    return index.mapInArrow(_lookup(sent, slops), _MATCHES), sent


def matches(index: DataFrame, benchmark: DataFrame, width: int = WINDOW, slops: tuple[int, ...] = (0,), block_words: int = BLOCK_WORDS) -> DataFrame:
    """Of each row of the index: row, doc_id, n_words, spans of matched words [first, last) and items with a matching window by the first slop, and `near`, items by the last slop."""
    blocks = _blocks(benchmark, width, block_words)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return _looked_up(index, block, width, slops)[0]
    parts = None
    while block is not None:
        found, sent = _looked_up(index, block, width, slops)
        part = _store.written(found.where(F.size("items") + F.size("near") > 0))
        sent.destroy()
        parts = part if parts is None else parts.unionByName(part)
        block, following = following, next(blocks, None)
    ends = lambda name: F.array_sort(F.flatten(F.collect_list(F.col("spans")[name]))).alias(name)
    every = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
    merged = parts.groupBy("row").agg(ends("first"), ends("last"), every("items"), every("near")).select("row", _runs(F.col("first"), F.col("last")).alias("spans"), "items", "near")
    rows = index.select("rows", "doc_ids", "sizes").mapInArrow(_lengths, "row bigint, doc_id bigint, n_words bigint")
    kinds = dict(merged.dtypes)
    return rows.join(merged, "row", "left").select("row", "doc_id", "n_words", *(F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("spans", "items", "near")))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(shard["rows"], pa.int64()), pa.array(shard["doc_ids"], pa.int64()), pa.array(np.frombuffer(shard["sizes"], np.int64))], names=["row", "doc_id", "n_words"])


def find(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row: doc_id, n_words, spans of matched words [first, last) and the items with a matching window."""
    return matches(build_index(docs), benchmark, width, (slop,), block_words).select("doc_id", "n_words", "spans", "items")


def _runs(first: Column, last: Column) -> Column:
    """Spans that touch or overlap as one, from their sorted starts and their sorted ends: a run ends where as many spans have ended as have begun."""
    begins = F.filter(first, lambda x, i: (i == 0) | (F.get(last, i - 1) < x))
    ends = F.filter(last, lambda x, i: (i == F.size(last) - 1) | (x < F.get(first, i + 1)))
    return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def covered(spans: str | F.Column) -> F.Column:
    """How many words sorted spans cover, overlaps once."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["last"]).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("bigint"), x["last"] - F.greatest(acc["end"], x["first"]))).alias("n"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, near: int = NEAR) -> DataFrame:
    """The digest per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; n_near: items with a window whose words are all within `near` of their places."""
    hit = matches(build_index(docs), benchmark, width, (0, near))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    digest = hit.select("doc_id", "n_words", covered("spans").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), F.size("near").cast("bigint").alias("n_near"))
    return digest.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows that hold a window of the benchmark; all columns are kept, and each row is judged on its own text."""
    rows, row = _store.numbered(docs)
    index = build_index(rows, row)
    hit = _store.written(matches(index, benchmark, width, (0,), block_words).where(F.size("items") > 0).select(F.col("row").alias(row)))
    _store.forget(index)
    return rows.join(hit, row, "left_anti").select(*docs.columns)
