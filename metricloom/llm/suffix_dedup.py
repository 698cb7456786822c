"""Suffix-array dedup: removing bytes of every LENGTH-byte string that starts twice or more.

Sorting all suffixes of a corpus column by column would take as many passes over it as the longest
text has bytes.  Here the collection is cut so that a column-wise construction has few rounds:

1. Every LENGTH-byte window has an anchor, its leftmost K-byte string of least hash.  Windows of
   equal bytes have equal anchors at equal places, so only windows of one anchor string need to be
   compared.  Consecutive windows of one anchor form a region (under 2 LENGTH bytes).
2. (anchor, region) hashes are counted over the corpus, 40 bytes for about every 190 of text.  A
   region that occurs twice is repeated as a whole.  An anchor with several regions is contested.
3. The regions of contested anchors are read again (which anchors: a bitmap of fixed size) and
   each shard builds the order of its regions' suffixes column by column: a round inserts one
   byte before each region's suffix; the new order is a stable sort of the old by these bytes (which
   are the collection's Burrows-Wheeler transform), and the common prefix of neighbours is one
   more than the least between their old places.  Regions stand aligned at their anchors, so
   there are fewer than 2 LENGTH rounds, and one array of bytes, order and prefixes is read and
   written in sequence each round.  A suffix that shares LENGTH bytes with a neighbour is repeated.
4. The repeated intervals of each document are joined to it, merged and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .frequency import volume
from .storage import cut

LENGTH, K = 400, 16
BITS = 27
SLICE = 1 << 19
FLUSH = 1 << 17  # regions that a task holds
TEXT_FLUSH = 2 << 20
SHARD = 1 << 16  # regions

REGION = np.dtype([("anchor", "<u8"), ("region", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("begin", "<i8"), ("span", "<i4"), ("off", "<i4")])

COLUMNS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` keys that follow one another."""
    n = len(key)
    if n < width:
        return key[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(key.dtype).max, key.dtype)
    padded[:n] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def regions(data: np.ndarray, at: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The regions of a slice: REGION rows (doc: index of the text; begin: in it) and where each begins in data."""
    n = len(data)
    empty = np.zeros(0, REGION), np.zeros(0, np.int64)
    if n < length:
        return empty
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(ts._LETTER[data] * ts._power("up", n)[:n], out=total[1:])
    down = ts._power("down", n + 1)
    value = total[k:] - total[:-k]
    value *= down[: n - k + 1]
    value = ts.mix(value)
    low = np.uint64(max(1, n.bit_length()))
    anchor = _least((value >> low << low) | np.arange(n - k + 1, dtype=np.uint64), length - k + 1)
    place = (anchor & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    left = np.diff(at)
    usable = np.flatnonzero(left >= length)
    if not len(usable):
        return empty
    many = left[usable] - length + 1
    start = np.repeat(at[usable] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    doc = np.repeat(usable, many)
    place = place[start]
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    begin, stop = start[head], start[np.concatenate([head[1:], [len(start)]]) - 1]
    out = np.empty(len(head), REGION)
    out["span"], out["off"] = stop - begin, place[head] - begin
    # Least hashes are small ones: they are mixed again, to be dealt evenly.
    out["anchor"] = ts.mix(value[place[head]] ^ np.uint64(0x2545F4914F6CDD1D))
    own = (total[stop + length] - total[begin]) * down[begin]
    out["region"] = ts.mix(own ^ ts.mix(out["span"].astype(np.uint64) << np.uint64(32) | out["off"].astype(np.uint64)))
    out["doc"], out["begin"] = doc[head], begin - at[doc[head]]
    return out, begin


def _read(part: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, at = ts.buffer_of(part.column(2))
    found, begin = regions(data, at, length)
    of = found["doc"].copy()
    found["doc"] = part.column(0).to_numpy(zero_copy_only=False)[of]
    found["text"] = part.column(1).to_numpy(zero_copy_only=False)[of]
    return data, found, begin


def _edges(anchor: np.ndarray, cuts: int) -> list[tuple[int, int, int]]:
    edge = np.searchsorted((anchor >> np.uint64(64 - cuts)).astype(np.int64), np.arange((1 << cuts) + 1))
    return [(s, a, b) for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]


def count_regions(docs: DataFrame, cuts: int, length: int) -> DataFrame:
    """Intervals of regions that occur twice (doc, text_hash, low, high), and per shard a bitmap of
    contested anchors (bitmap not null)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            every = np.concatenate(held)
            every = every[np.argsort(every["anchor"])]
            rows = _edges(every["anchor"], cuts)
            return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in rows], pa.int32()), pa.array([every[a:b].tobytes() for _, a, b in rows], pa.binary())], ["shard", "rows"])

        for part in ts.slices(batches, "text", SLICE):
            _, found, _ = _read(part, length)
            if len(found):
                held.append(found)
                n += len(found)
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def count(pdf):
        import pandas as pd

        x = np.frombuffer(b"".join(pdf["rows"]), REGION)
        x = x[np.lexsort((x["region"], x["anchor"]))]
        new_anchor = np.concatenate([[True], x["anchor"][1:] != x["anchor"][:-1]])
        new = new_anchor | np.concatenate([[True], x["region"][1:] != x["region"][:-1]])
        head = np.flatnonzero(new)
        times = np.diff(np.concatenate([head, [len(x)]]))
        full = x[np.repeat(times > 1, times)]
        of = np.cumsum(new_anchor)[head] - 1
        kinds, alone = np.bincount(of), np.bincount(of, weights=times == 1)
        contested = x["anchor"][np.flatnonzero(new_anchor)][(kinds > 1) & (alone > 0)]
        section = BITS - cuts
        flags = np.zeros(1 << section, bool)
        flags[((contested >> np.uint64(64 - BITS)) & np.uint64((1 << section) - 1)).astype(np.int64)] = True
        rows = pd.DataFrame({"shard": pdf["shard"].iloc[0], "doc": full["doc"], "text_hash": full["text"], "low": full["begin"], "high": full["begin"] + full["span"] + length, "bitmap": None})
        return pd.concat([rows, pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "doc": [0], "text_hash": [0], "low": [0], "high": [0], "bitmap": [np.packbits(flags, bitorder="little").tobytes()]})])

    return docs.mapInArrow(gather, "shard int, rows binary").groupBy("shard").applyInPandas(count, "shard int, doc long, text_hash long, low long, high long, bitmap binary")


@dataclass
class Collection:
    """Aligned regions: bytes, and for each its group (anchor), the place of its anchor in `data`,
    and the columns [left, right) that it has, its anchor being in column 0."""

    data: np.ndarray
    group: np.ndarray
    zero: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def repeated(self, length: int) -> Iterator[tuple[int, np.ndarray]]:
        """(column, regions whose `length` bytes from there another region of the group has too)."""
        if not len(self.group):
            return
        by_right = np.argsort(-self.right, kind="stable")
        enters = self.right[by_right]
        order, common, taken = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for column in range(int(self.right.max()) - 1, int(self.left.min()) - 1, -1):
            upto = int(np.searchsorted(-enters, -(column + 1), "right"))
            if upto > taken:  # their empty suffixes come first in their groups
                order = np.concatenate([by_right[taken:upto], order])
                common = np.concatenate([np.zeros(upto - taken, np.int64), common])
                place = np.argsort(self.group[order], kind="stable")
                order, common = order[place], common[place]
                taken = upto
            stays = self.left[order] <= column
            if not stays.all():  # the common prefix over those that leave is the least of all
                kept = np.flatnonzero(stays)
                if not len(kept):
                    order, common = order[:0], common[:0]
                    continue
                common = np.minimum.reduceat(common[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
                order = order[kept]
            key = (self.group[order] << 8) | self.data[self.zero[order] + column]
            place = np.argsort(key, kind="stable")
            same = np.concatenate([[False], key[place[1:]] == key[place[:-1]]])
            fresh = np.zeros(len(order), np.int64)
            near = np.flatnonzero(same)
            begin, end = place[near - 1] + 1, place[near] + 1
            step = end - begin == 1
            fresh[near[step]] = common[begin[step]] + 1
            wide = np.flatnonzero(~step)
            if len(wide):
                bounds = np.stack([begin[wide], end[wide]], 1).ravel()
                padded = np.concatenate([common, [np.iinfo(np.int64).max]])
                fresh[near[wide]] = np.minimum.reduceat(padded, bounds)[::2] + 1
            order, common = order[place], fresh
            hit = common >= length
            if hit.any():
                hit[:-1] |= hit[1:]
                yield column, order[hit]


def contested(docs: DataFrame, bitmap: np.ndarray, cuts: int, length: int) -> DataFrame:
    """Repeated intervals (doc, text_hash, low, high) of regions that compete for an anchor."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, metas, texts, held = sent.value, [], [], 0

        def flush():
            meta, text = np.concatenate(metas), np.concatenate(texts)
            size = meta["span"].astype(np.int64) + length
            first = np.cumsum(size) - size
            order = np.lexsort((meta["region"], meta["anchor"]))
            order = order[np.concatenate([[True], (np.diff(meta["anchor"][order]) != 0) | (np.diff(meta["region"][order]) != 0)])]
            meta, first, size = meta[order], first[order], size[order]
            rows = _edges(meta["anchor"], cuts)
            bytes_ = [text[ragged(first[a:b], size[a:b])].tobytes() for _, a, b in rows]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in rows], pa.int32()), pa.array([meta[a:b].tobytes() for _, a, b in rows], pa.binary()), pa.array(bytes_, pa.binary())], ["shard", "meta", "bytes"])

        for part in ts.slices(batches, "text", SLICE):
            data, found, begin = _read(part, length)
            at = (found["anchor"] >> np.uint64(64 - BITS)).astype(np.int64)
            own = np.flatnonzero((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if len(own):
                size = found["span"][own].astype(np.int64) + length
                metas.append(found[own])
                texts.append(data[ragged(begin[own], size)])
                held += int(size.sum())
            if held >= TEXT_FLUSH:
                yield flush()
                metas, texts, held = [], [], 0
        if held:
            yield flush()

    def build(pdf):
        import pandas as pd

        meta = np.frombuffer(b"".join(pdf["meta"]), REGION)
        data = np.frombuffer(b"".join(pdf["bytes"]), np.uint8)
        size = meta["span"].astype(np.int64) + length
        first = np.cumsum(size) - size
        order = np.lexsort((meta["region"], meta["anchor"]))
        order = order[np.concatenate([[True], (np.diff(meta["anchor"][order]) != 0) | (np.diff(meta["region"][order]) != 0)])]
        _, group, times = np.unique(meta["anchor"][order], return_inverse=True, return_counts=True)
        order = order[times[group] > 1]
        meta, first, size = meta[order], first[order], size[order]
        _, group = np.unique(meta["anchor"], return_inverse=True)
        off = meta["off"].astype(np.int64)
        # Columns fall, so a region's repeated starts are runs that grow to the left.
        last, high, runs = np.full(len(meta), np.iinfo(np.int64).max), np.zeros(len(meta), np.int64), []
        for column, hit in Collection(data, group, first + off, -off, size - off).repeated(length):
            fresh = hit[last[hit] != column + 1]
            done = fresh[last[fresh] < np.iinfo(np.int64).max]
            if len(done):
                runs.append(np.stack([done, last[done], high[done]]))
            high[fresh] = column + length
            last[hit] = column
        done = np.flatnonzero(last < np.iinfo(np.int64).max)
        who, low, upto = np.concatenate([*runs, np.stack([done, last[done], high[done]])], 1)
        at = meta["begin"][who] + off[who]
        return pd.DataFrame({"doc": meta["doc"][who], "text_hash": meta["text"][who], "low": at + low, "high": at + upto})

    return docs.mapInArrow(gather, "shard int, meta binary, bytes binary").groupBy("shard").applyInPandas(build, "doc long, text_hash long, low long, high long")


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices first[i], ..., first[i] + size[i] - 1 for each i in turn."""
    out = np.repeat(first - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def merge_spans(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that the intervals cover (touching ones are one run)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(low.tolist(), high.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def repeated_intervals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, text_hash, low and high (bytes) of repeated strings; they may overlap.  docs: doc, text_hash, text."""
    cuts = max(5, int(volume(docs) // 190 // SHARD).bit_length())
    counted = cut(count_regions(docs, cuts, length))
    bitmap = np.zeros((1 << cuts, 1 << (BITS - cuts) >> 3), np.uint8)
    for shard, flags in zip(*counted.where("bitmap is not null").select("shard", "bitmap").toArrow().columns, strict=True):
        bitmap[shard.as_py()] = np.frombuffer(flags.as_buffer(), np.uint8)
    return counted.where("bitmap is null").select("doc", "text_hash", "low", "high").unionAll(contested(docs, bitmap.ravel(), cuts, length))


def dedup(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = False) -> DataFrame:
    """The columns of docs, n_bytes, n_removed, n_spans and kept_sha256; with keep_bytes, kept too.

    `text` is what is left, as UTF-8 (U+FFFD where a cut goes through a character); `kept` is its bytes.

    Texts are UTF-8 bytes; a null text is empty; texts under `length` bytes lose nothing.  Strings
    are judged on the input, within one text too, where they may overlap.  Rows equal in doc_id
    and text are repeats of each other, as any equal texts are.  Input columns with an output's
    name are replaced; an empty table gives an empty result."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    docs = docs.drop(*names[:-1], "kept", "_d", "_t", "_spans")
    key = {"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_t": F.xxhash64("text")}
    keyed = docs.withColumns(key)
    spans = repeated_intervals(keyed.select(F.col("_d").alias("doc"), F.col("_t").alias("text_hash"), F.col("text").cast("string").alias("text")), length)
    spans = spans.groupBy(F.col("doc").alias("_d"), F.col("text_hash").alias("_t")).agg(F.collect_set(F.struct("low", "high")).alias("_spans"))
    met = keyed.join(spans, ["_d", "_t"], "left").drop("_d", "_t").select(*docs.columns, F.col("_spans.low").alias("_low"), F.col("_spans.high").alias("_high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            texts = column("text").cast(pa.binary())
            for text, low, high in zip(texts, column("_low").to_pylist(), column("_high").to_pylist(), strict=True):
                raw = text.as_py() or b""
                runs = merge_spans(np.array(low), np.array(high)) if low else []
                digest, kept, at = hashlib.sha256(), [], 0
                for a, b in [*runs, (len(raw), len(raw))]:
                    digest.update(raw[at:a])
                    kept.append(raw[at:a])
                    at = b
                left = b"".join(kept)
                rows.append((len(raw), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), left.decode("utf-8", "replace"), left))
            own = [c for c in batch.schema.names if c not in ("text", "_low", "_high")]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            arrays = [*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:5]), *([pa.array(cols[5], pa.binary())] if keep_bytes else [])]
            yield pa.RecordBatch.from_arrays([*(column(c) for c in own), *arrays], [*own, *names, *(["kept"] if keep_bytes else [])])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return met.mapInArrow(run, kinds + COLUMNS + (", kept binary" if keep_bytes else ""))
