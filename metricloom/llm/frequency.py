"""How often tokens occur in the whole corpus, in two forms of bounded size.

`Survey.repeated` is a bitmap over hashed tokens: a clear bit means that a token occurs once in
the whole corpus, so no two sets can share it.  `Survey.rank` orders tokens by frequency: 0 for
all but the `hot` most frequent.  Both only steer a search (which tokens to look at first, which
lookups must be empty); results are exact for any state of either.

Counts cover every token.  Tasks sort and count their own tokens first; what is shuffled is a few
packed runs for each task and shard, two bytes a token, so that a token in a third of all texts
is one entry for each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .storage import cut

FLUSH = 3 << 20  # tokens that a task holds
SHARD_TOKENS = 2 << 20
HOT_FROM = 16


@dataclass
class Survey:
    bits: int
    bitmap: np.ndarray  # packed
    hot: np.ndarray  # 32-bit keys, sorted
    hot_rank: np.ndarray  # 1 for the rarest of them

    def repeated(self, tokens: np.ndarray) -> np.ndarray:
        at = tokens >> np.uint64(64 - self.bits)
        return (self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def __post_init__(self):
        self.width = 32 - min(20, max(1, len(self.hot).bit_length()))
        self.edge = np.searchsorted(self.hot, np.arange(1 << (32 - self.width), dtype=np.int64) << self.width).astype(np.int32)
        self.hot = np.append(self.hot, np.uint32(0xFFFFFFFF))

    def rank(self, tokens: np.ndarray) -> np.ndarray:
        key = (tokens >> np.uint64(32)).astype(np.uint32)
        at = self.edge[key >> np.uint32(self.width)]  # hashes are even, so the key is a few places on, if anywhere
        on = np.flatnonzero(self.hot[at] < key)
        while len(on):
            at[on] += 1
            on = on[self.hot[at[on]] < key[on]]
        at = np.minimum(at, len(self.hot) - 2)
        return np.where(self.hot[at] == key, self.hot_rank[at], 0).astype(np.int64) if len(self.hot_rank) else np.zeros(len(tokens), np.int64)


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct 32-bit keys as 16-bit steps; 65535 is a step without a key."""
    step = np.diff(keys.astype(np.int64), prepend=-1)
    jumps = step // 65535
    out = np.full(len(keys) + int(jumps.sum()), 65535, np.uint16)
    out[np.cumsum(jumps + 1) - 1] = step - jumps * 65535
    return out.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    step = np.frombuffer(blob, np.uint16).astype(np.int64)
    return (np.cumsum(step) - 1)[step < 65535]


def volume(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shard_bits(n_tokens: int, least: int = 5) -> int:
    return max(least, int(n_tokens // SHARD_TOKENS).bit_length())


def survey(docs: DataFrame, tokens_of: Callable[[np.ndarray, np.ndarray], np.ndarray], n_tokens: int, bits: int, hot: int = 1 << 20) -> Survey:
    """docs has the column text; tokens_of gives the 64-bit tokens of a slice's buffer."""
    cuts = shard_bits(n_tokens)
    width = 32 - cuts

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            keys = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, times = keys[first], np.diff(np.concatenate([first, [len(keys)]]))
            edge = np.searchsorted(keys, np.arange((1 << cuts) + 1, dtype=np.int64) << width)
            rows = [(s, keys[a:b], times[a:b]) for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
            many = [np.flatnonzero(t > 1) for _, _, t in rows]
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _, _ in rows], pa.int32()), pa.array([pack(k - (s << width)) for s, k, _ in rows], pa.binary()), pa.array([m.astype(np.uint32).tobytes() + t[m].astype(np.uint32).tobytes() for (_, _, t), m in zip(rows, many, strict=True)], pa.binary())],
                ["shard", "keys", "many"],
            )

        for part in ts.slices(batches, "text"):
            keys = (tokens_of(*ts.buffer_of(part.column(0))) >> np.uint64(32)).astype(np.int64)
            if len(keys):
                held.append(keys)
                n += len(keys)
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    section = bits - cuts

    def merge(table: pa.Table) -> pa.Table:
        keys = [unpack(x.as_buffer()) for x in table.column("keys")]
        times = [np.ones(len(k), np.int64) for k in keys]
        for t, m in zip(times, table.column("many"), strict=True):
            at, n = np.frombuffer(m.as_buffer(), np.uint32).reshape(2, -1)
            t[at] = n
        every, n = np.concatenate(keys), np.concatenate(times)
        del keys, times
        order = np.argsort(every, kind="stable")
        every, n = every[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        every, n = every[first], np.add.reduceat(n, first)
        flags = np.zeros(1 << section, bool)
        flags[every[n > 1] >> (width - section)] = True
        shard = table.column("shard")[0].as_py()
        top = n >= HOT_FROM
        hist = np.bincount(np.log2(n[top]).astype(np.int64), minlength=64)
        return pa.table({"shard": pa.array([shard], pa.int32()), "bitmap": [np.packbits(flags, bitorder="little").tobytes()], "keys": [(every[top] + (shard << width)).astype(np.uint32).tobytes()], "n": [n[top].astype(np.int64).tobytes()], "hist": [hist.tolist()]})

    merged = cut(docs.select("text").mapInArrow(gather, "shard int, keys binary, many binary").groupBy("shard").applyInArrow(merge, "shard int, bitmap binary, keys binary, n binary, hist array<long>"))
    bitmap, hist = np.zeros((1 << cuts, max(1, 1 << section >> 3)), np.uint8), np.zeros(64, np.int64)
    # One job: what comes is the bitmap's size, and below at most `hot` keys.
    for shard, flags, h in zip(*merged.select("shard", "bitmap", "hist").toArrow().columns, strict=True):
        bitmap[shard.as_py()] = np.frombuffer(flags.as_buffer(), np.uint8)
        hist += np.array(h.as_py())
    above = np.cumsum(hist[::-1])[::-1]
    level = int(np.argmax(above <= hot))  # counts from 2 ** level on fit

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                k, t = np.frombuffer(k.as_buffer(), np.uint32), np.frombuffer(t.as_buffer(), np.int64)
                kept = t >= 1 << level
                yield pa.RecordBatch.from_arrays([pa.array([k[kept].tobytes()], pa.binary()), pa.array([t[kept].tobytes()], pa.binary())], ["keys", "n"])

    keys, n = [], []
    for k, t in zip(*merged.select("keys", "n").mapInArrow(frequent, "keys binary, n binary").toArrow().columns, strict=True):
        keys.append(np.frombuffer(k.as_buffer(), np.uint32))
        n.append(np.frombuffer(t.as_buffer(), np.int64))
    key, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, n))
    rank = np.empty(len(key), np.int64)
    rank[np.lexsort((key, count))] = np.arange(1, len(key) + 1)
    order = np.argsort(key)
    return Survey(bits, bitmap.ravel(), key[order].astype(np.uint32), rank[order].astype(np.int32))
