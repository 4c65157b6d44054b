"""Vectorised word splitting and hashing over Arrow string buffers.

Everything works on the UTF-8 bytes of a whole Arrow column at once: a byte class decides what belongs to a
word, and a rolling polynomial hash gives each word 64 bits. Separators are ASCII, so byte positions of words
are well defined for any UTF-8 text. Rows that are null count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is one chunk, whose words are still hashed piecewise.
CHUNK_BYTES = 1 << 21
PIECE_BYTES = 1 << 18

_WHITE = np.ones(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words separated by white space \x20\x09-\x0D.
NON_SPACE = _WHITE
_ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _ALNUM[_lo : _hi + 1] = True
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z were lower-cased.
ALNUM = _ALNUM
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
#: Lower-cases A-Z alone.
FOLD_ASCII = _FOLD

_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_S29, _S32 = np.uint64(29), np.uint64(32)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = x ^ (x >> _S32)
    x *= _M1
    x ^= x >> _S29
    x *= _M2
    x ^= x >> _S32
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a followed by b."""
    x = a * _M3
    x += (b ^ (b >> _S32)) * _M1
    x ^= x >> _S29
    x *= _M2
    x ^= x >> _S32
    return x


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column: first row, end, their bytes and the bounds of each row in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, to, raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def spans(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words end where rows end."""
    inside = is_word[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    return first, last, np.searchsorted(bounds, first, "right") - 1


def hash_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and may not overlap, except that ends may come earlier."""
    values = _BYTE_VALUES if fold is None else _BYTE_VALUES[fold]
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        base = int(first[at])
        to = max(at + 1, int(np.searchsorted(first, base + PIECE_BYTES, "left")))
        stop = int(last[at:to].max())
        power, inverse = _power_table(_BASE, stop - base + 1), _power_table(_BASE_INVERSE, stop - base + 1)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(values[data[base:stop]] * power[: stop - base], out=sums[1:])
        out[at:to] = (sums[last[at:to] - base] - sums[first[at:to] - base]) * inverse[first[at:to] - base]
        at = to
    return mix(out)


def word_codes(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row of every word, its number in a dictionary, and the dictionary: equal numbers are equal words, byte for byte."""
    first, last, row = spans(data, bounds, is_word)
    raw = data[is_word[data]]
    if fold is not None:
        raw = fold[raw]
    ends = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first, out=ends[1:])
    kind, offsets = (pa.binary(), ends.astype(np.int32)) if ends[-1] < 1 << 31 else (pa.large_binary(), ends)
    coded = pa.Array.from_buffers(kind, len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    return row, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hash_words(words: list[str], fold: np.ndarray | None = None) -> np.ndarray:
    """The same hashes for words on the driver."""
    raw = [w.encode() for w in words]
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=bounds[1:])
    return hash_spans(np.frombuffer(b"".join(raw), np.uint8), bounds[:-1], bounds[1:], fold)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of width items from each item on, by doubling the length; windows past the end are left out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size = hashes, 1
    while 2 * size <= width:
        level = pair(level[:-size], level[size:])
        size *= 2
    if size < width:
        gap = width - size
        level = pair(level[: len(level) - gap], level[gap:])
    return level[:n]


def sliding(values: np.ndarray, width: int, how: np.ufunc) -> np.ndarray:
    """how (minimum or maximum) over width items from each item on, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    level, size = values, 1
    while 2 * size <= width:
        level = how(level[:-size], level[size:])
        size *= 2
    if size < width:
        gap = width - size
        level = how(level[: len(level) - gap], level[gap:])
    return level[:n]
