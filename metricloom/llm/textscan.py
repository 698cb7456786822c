"""Vectorised scanning of Arrow string columns.

All texts of a small slice of a batch are looked at as one byte buffer: separators are
ASCII, so words can be found with a 256-entry table whatever the language, and every word
gets a 64-bit hash from one running sum.  No Python object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: Bytes of words that are split on white space only, and of words made of a-z, 0-9 and non-ASCII.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit over all 64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, 1 << 21), _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.multiply.accumulate(step)
    return have


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts after one another, and len+1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose texts take about `limit` bytes (a longer text stands alone)."""
    _returning(SCANNING)
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, at = buffer_of(batch.column(batch.schema.get_field_index(column)))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
                yield batch.slice(begin, end - begin)
                begin = end
    finally:
        _returning(RESTING)
        release()


def _returning(size: int) -> None:
    """From now on arrays of `size` bytes or more go back to the system as soon as they are freed (a Python worker
    lives on after its task, beside others and their JVM); smaller ones are reused, which is faster."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, size)  # M_MMAP_THRESHOLD, which rises by itself if it isn't set
        libc.mallopt(-1, 4 * size)  # M_TRIM_THRESHOLD


SCANNING, RESTING = 32 << 20, 1 << 20
_returning(RESTING)
pa.set_memory_pool(pa.system_memory_pool())


def release() -> None:
    """Gives freed memory back to the system."""
    _powers.update({k: v[: 1 << 16].copy() for k, v in _powers.items() if len(v) > 1 << 22})
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Words:
    """Words of a buffer: start and end byte, hash, and `first[d]:first[d + 1]` for text d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True):
        inside = table[data]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        edges = offsets[(offsets < len(data))]
        before[edges] = False
        if len(data):
            after[-1] = False
            after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.hash = span_hash(data, self.start, self.end) if hashed else None


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes give equal hashes wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _power("up", len(data))[: len(data)], out=total[1:])
    own = (total[end] - total[start]) * _power("down", len(data) + 1)[start]
    return mix(own + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k hashes that follow one another (len - k + 1 of them, over all texts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out + hashes[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct k-word shingles, sorted by text, then hash.

    A text of fewer than k words has one, its whole sequence; one without words has none."""
    n_docs = len(words.count)
    every = window_hash(words.hash, k)
    at = np.arange(len(every))
    inside = words.doc[: len(every)] == words.doc[k - 1 : k - 1 + len(every)] if len(every) else np.zeros(0, bool)
    doc, value = words.doc[at[inside]], every[inside]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        extra = np.array([int(window_hash(words.hash[words.first[d] : words.first[d + 1]], int(words.count[d]))[0]) ^ int(words.count[d]) for d in short], np.uint64)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, extra])
    shift = np.uint64(max(1, n_docs.bit_length()))
    order = np.argsort((doc.astype(np.uint64) << (np.uint64(64) - shift)) | (value >> shift))
    doc, value = doc[order], value[order]
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        doc, value = doc[new], value[new]
    assert not len(doc) or doc[-1] < n_docs
    return doc, value


def code_points(data: np.ndarray) -> np.ndarray:
    """True where a byte starts a code point."""
    return (data & 0xC0) != 0x80


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of `values` (one for each byte) over each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offsets])


def line_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of every line; a text has one more line than newlines."""
    breaks = np.flatnonzero(data == 10)
    # A text's end comes before a newline at the same byte, which is the next text's.
    key = np.sort(np.concatenate([2 * at[1:], 2 * breaks + 1]))
    end = key >> 1
    begin = np.zeros_like(end)
    begin[1:] = end[:-1] + (key[:-1] & 1)
    doc = np.zeros(len(end), np.int64)
    doc[1:] = np.cumsum((key[:-1] & 1) == 0)
    return begin, end, doc
