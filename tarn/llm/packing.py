"""Best-fit packing of documents into fixed-length sequences, improved by a swap-based local search.

Documents are tokenised, ended by one separator token, and cut only when longer than a sequence: into pieces of
exactly the capacity, but for the first one, which takes the remainder. Pieces are dealt evenly over partitions;
each partition packs its own by best fit and then lets the local search exchange pieces one for one, two for one,
or move them, between underfull bins, always increasing the sum of squared fills, until bins run empty. What is
left in loosely filled bins of all partitions is packed once more in far fewer partitions.

Defined cases: a null or empty text is the separator alone; repeated rows are packed each for itself; a document
without doc_id keeps a null doc_id; other columns are ignored; an empty table gives no sequence. The text of a
special token is that special token's id, as the tokenizer's own file says.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import _store

CAPACITY = 1024
SEPARATOR = 2
#: Pieces that one task packs.
PIECES_PER_TASK = 20_000
#: Bins with more free tokens than this are opened again in the second round.
LOOSE = 16

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PLACED = _PIECES + ", sequence_id bigint, offset bigint, free int"


#: A run of so much white space goes to the vocabulary's own tokenizer: the faster one backs up within runs, on a bounded stack.
_LONG_RUN = 512
_WHITE_RUN = re.compile(r"\s{%d}" % _LONG_RUN)


@functools.lru_cache(maxsize=2)
def _encoder(name: str):
    """Encodes as the vocabulary file of that name does. Ranks of the same vocabulary are used, which is faster.

    Both give the same ids; only the look-ahead after white space needs a stack, so long runs of it take the slower way.
    """
    import public_tokenizers
    import tiktoken

    @functools.cache
    def whole():  # noqa: ANN202  loaded where a text needs it
        from tokenizers import Tokenizer

        return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": len(ranks)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")")

    def encode(text: str) -> np.ndarray:
        if len(text) >= _LONG_RUN and _WHITE_RUN.search(text):
            return np.array(whole().encode(text, add_special_tokens=False).ids, np.uint32)
        if "<|" not in text:
            return np.array(plain.encode_ordinary(text), np.uint32)
        ids: list[int] = []
        for part in cut.split(text):
            ids += [special[part]] if part in special else plain.encode_ordinary(part)
        return np.array(ids, np.uint32)

    return encode


def _tokenise(name: str, capacity: int, separator: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(name)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.append(encode(text.as_py() or ""), np.uint32(separator)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].astype(np.int64)] if keep_ids else [])))
                columns = list(zip(*rows, strict=True)) or [()] * (5 + keep_ids)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*(x.split()[0] for x in _PIECES.split(", ")), *(["ids"] if keep_ids else [])])

    return run


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document, with their ids if wanted."""
    _store.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_tokenise(tokenizer, capacity, separator, keep_ids), _PIECES + (", ids array<bigint>" if keep_ids else ""))


class Bins:
    """Bins of integer sizes. squares() is the sum of squared fills, which every accepted exchange increases."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.fill = capacity, [], []

    def best_fit(self, sizes: list[int]) -> None:
        """Largest first, each into the fullest bin that has room."""
        open_bins: list[tuple[int, int]] = []  # (free, bin)
        for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            size = sizes[item]
            at = bisect_left(open_bins, (size, -1))
            if at < len(open_bins):
                free, b = open_bins.pop(at)
            else:
                free, b = self.capacity, len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append((size, item))
            self.fill[b] += size
            if free > size:
                insort(open_bins, (free - size, b))

    def squares(self) -> int:
        return sum(f * f for f in self.fill)

    def local_search(self) -> None:
        """Exchanges between underfull bins until none increases the squares: the emptiest bins give first and run empty.

        An exchange takes one piece out of a bin into another, for nothing (a move), for one smaller piece or for two.
        For every sum that a bin can give back, a heap knows the emptiest bin that has it, so one look-up finds a
        piece's best exchange among all bins.
        """
        self._tops = np.full(self.capacity + 1, -1, np.int64)  # most room of a bin that can give this sum back
        self._heaps: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(self.capacity + 1)]
        under = [b for b in range(len(self.items)) if 0 < self.fill[b] < self.capacity]
        for b in under:
            self._offer(b)
        changed = len(under) > 1
        while changed:
            changed = False
            for source in sorted(under, key=lambda b: (self.fill[b], b)):
                while 0 < self.fill[source] < self.capacity and self._improve(source):
                    changed = True

    def _gives(self, b: int) -> dict[int, tuple[int, ...]]:
        """What a bin can give back by sum: nothing, a piece or two."""
        sizes = sorted({s for s, _ in self.items[b]})
        twice = {s for s in sizes if sum(x[0] == s for x in self.items[b]) > 1}
        out: dict[int, tuple[int, ...]] = {0: ()}
        for i, s in enumerate(sizes):
            for t in sizes[i:]:
                if s + t < self.capacity and (s != t or s in twice):
                    out.setdefault(s + t, (s, t))
        return out | {s: (s,) for s in sizes}

    def _offer(self, b: int) -> None:
        free = self.capacity - self.fill[b]
        if 0 < free < self.capacity:
            for total, gives in self._gives(b).items():
                heappush(self._heaps[total], (-free, b, gives))
                self._tops[total] = max(self._tops[total], free)

    def _top(self, total: int, source: int) -> tuple[int, tuple[int, ...]] | None:
        """The emptiest bin but the source that gives this sum back; entries that no longer hold go."""
        heap, aside, found = self._heaps[total], [], None
        while heap:
            free, b, gives = heap[0]
            if -free != self.capacity - self.fill[b] or not self._has(b, gives):
                heappop(heap)
            elif b == source:
                aside.append(heappop(heap))
            else:
                found = b, gives
                break
        for x in aside:
            heappush(heap, x)
        self._tops[total] = -heap[0][0] if heap else -1
        return found

    def _has(self, b: int, gives: tuple[int, ...]) -> bool:
        own = [s for s, _ in self.items[b]]
        return all(own.count(s) >= gives.count(s) for s in set(gives))

    def _improve(self, source: int) -> bool:
        for x in sorted(self.items[source], reverse=True):
            for total in np.flatnonzero(self._tops[: x[0]] >= x[0] - np.arange(x[0])).tolist():
                found = self._top(total, source)
                if found is None:
                    continue
                target, gives = found
                gain = x[0] - total
                if gain <= self.capacity - self.fill[target] and self.fill[target] + gain > self.fill[source]:
                    self._swap(source, x, target, gives)
                    return True
        return False

    def _swap(self, source: int, x: tuple[int, int], target: int, gives: tuple[int, ...]) -> None:
        back = []
        for s in gives:
            back.append(next(y for y in self.items[target] if y[0] == s and y not in back))
        self.items[source].remove(x)
        for y in back:
            self.items[target].remove(y)
        self.items[source] += back
        self.items[target].append(x)
        gain = x[0] - sum(gives)
        self.fill[source] -= gain
        self.fill[target] += gain
        self._offer(source)
        self._offer(target)


def _pack(capacity: int, numbers_from: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).select([0, 1, 2, 3, 4])
        rows = rows.take(np.lexsort([rows.column(c).fill_null(-1).to_numpy() for c in (4, 1, 0, 3)])).combine_chunks()
        size = rows.column(3).to_numpy()
        bin_of, offset, free = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.zeros(len(size), np.int32)
        full = np.flatnonzero(size >= capacity)
        bin_of[full] = np.arange(len(full))
        rest = np.flatnonzero(size < capacity)
        bins = Bins(capacity)
        bins.best_fit(size[rest].tolist())
        bins.local_search()
        number = len(full)
        for items, fill in zip(bins.items, bins.fill, strict=True):
            at = 0
            for s, i in sorted(items, key=lambda x: (-x[0], x[1])):
                bin_of[rest[i]], offset[rest[i]], free[rest[i]] = number, at, capacity - fill
                at += s
            number += 1
        part = TaskContext.get().partitionId()
        yield from rows.append_column("sequence_id", pa.array(bin_of + (numbers_from + part << 32))).append_column("offset", pa.array(offset)).append_column("free", pa.array(free)).to_batches()

    return run


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, separator: int = SEPARATOR, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Where each piece goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = _store.written(pieces(docs, tokenizer, capacity, separator))
    n = cut.count()
    tasks = max(1, -(-n // pieces_per_task), min(docs.sparkSession.sparkContext.defaultParallelism, n // 2000))
    placed = cut.repartition(tasks).mapInArrow(_pack(capacity, 0), _PLACED)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if tasks == 1:
        return placed.select(columns)
    placed = _store.written(placed)
    loose = placed.where(F.col("free") > LOOSE)
    again = max(1, -(-loose.count() // pieces_per_task))
    second = loose.select(*columns[:5]).repartition(again).mapInArrow(_pack(capacity, tasks), _PLACED)
    return placed.where(F.col("free") <= LOOSE).select(columns).unionByName(second.select(columns))
