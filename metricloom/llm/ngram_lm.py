"""Quality classifier: an interpolated modified Kneser-Ney word bigram model of trusted text.

Words are runs of other than white space without ASCII case; a character of three bytes or more is
a word of its own, so that scripts without spaces have words too.  A word that the trusted text has
once is unknown, as is one that it hasn't; an unknown word costs its unigram or bigram and the log of
how many different ones there were.

With d what is taken off counts, c the count of a bigram, t(v) how often v stands first, k(w) after
how many different words w stands, T the number of different bigrams and n the number of words,
    p1(w) = (k - d(k)) / T + g1 / (n + 1),   p(w | v) = (c - d(c)) / t(v) + g(v) p1(w),
where g1 and g(v) are what was taken off.  So the log probability of a text is the sum of log p1(w)
and log g(v) of its words, and of log(p / (g(v) p1(w))) of those of its bigrams that were seen.

1. Bigrams of the trusted documents are counted in each task, then in shards of their first words
   (`_count`); continuation counts k go to the shards of the second words, are summed there, and
   go back to those that asked (`_heads`).
2. What the HOT most frequent bigrams and words add is sent to all tasks; which other bigrams were
   seen, and which words are known, are bitmaps of fixed size.
3. All texts are read; hot terms are summed at once, and the other terms are asked of the shards,
   four bytes and the place of its text for each (`_ask`, `_answer`): a join of all counts, whatever
   their number, with the texts.  Sums go back to the chunk of texts that they are of.
4. A document is rejected if its perplexity (by word) is above the language's threshold, a quantile of
   those of trusted documents that the model was not trained on (one in HELD_OUT, by hash of doc_id),
   or of those of all languages together where a language has none.

All counts are of all trusted documents and all texts are whole.  A task holds a text at about 100 times its
bytes, besides FLUSH terms; a shard's counts don't grow with the corpus, as there are more shards, and
what is asked of a shard is split in slots.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frequency
from . import textscan as ts
from .frequency import Survey, shard_bits, survey, volume
from .storage import cut

QUANTILE = 0.98  # chosen on the labels of sf0.1, see README
HELD_OUT = 4
SENT_IDS = 2_000_000  # ids or scores that are sent to all executors; with more, they are joined
WORD_BITS = 27  # the bitmaps' addresses
ID_BITS = 48  # of a word's and a bigram's hash
HOT = {"pair": 1 << 20, "first": 1 << 19, "word": 1 << 19}
FLUSH = 1 << 20  # bigrams that a task holds, counted or asked for
FLUSH_TEXTS = 1 << 16
SLOT = 4 << 30  # bytes of text whose questions one slot of a shard gets, for each 32 shards

SEEN, HEADS, REPLY, ASK, BASE = range(5)
ROWS = "lang string, shard int, slot int, kind int, source long, body binary"
NAMES = ["lang", "shard", "slot", "kind", "source", "body"]
BINS = 256 + 64


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that all their labels call good and none calls toxic."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("doc_id")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    n = ids.count()
    return docs.join(F.broadcast(ids) if n <= SENT_IDS else ids, "doc_id", "left_semi")


def _language(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_lang", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("none")))


def _discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more."""
    if not (n1 and n2):
        return np.array([0.0, 0.5, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0])
    return np.clip(d, [0, 0.01, 0.01, 0.01], [0, 1, 2, 3])


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word."""
    inside, follows = ts.NON_SPACE[data], ~ts.code_points(data)
    lead = np.maximum.accumulate(np.where(follows, 0, np.arange(len(data)))) if len(data) else np.zeros(0, np.int64)
    wide = data[lead] >= 0xE0
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    new = first[:-1].copy()
    new[1:] |= ~inside[:-1] | (~follows[1:] & (wide[1:] | wide[:-1]))
    last = first[1:].copy()
    last[:-1] |= ~inside[1:] | new[1:]
    return np.flatnonzero(inside & new), np.flatnonzero(inside & last) + 1


def _salts(lang: str) -> tuple[np.uint64, np.uint64, np.uint64]:
    """A language's salt, and its hashes of a text's edge and of an unknown word."""
    salt = np.frombuffer(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64)
    edge, unknown = (ts.mix(salt ^ np.uint64(k))[0] >> np.uint64(64 - ID_BITS) for k in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D))
    return salt[0], edge, unknown


def _pairs(langs: list[str], column: pa.Array, known: Survey) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and second word of every bigram of some texts, its text, and whether the second is unknown."""
    data, at = ts.buffer_of(column)
    begin, end = words(data, at)
    first = np.searchsorted(begin, at)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    hashed = ts.span_hash(ts.LOWER[data], begin, end)
    salts = {x: _salts(x) for x in set(langs)}
    salt, edge, unknown = (np.array([salts[x][i] for x in langs], np.uint64) for i in range(3))
    new = ~known.repeated(hashed)
    ids = np.where(new, unknown[doc], ts.mix(hashed ^ salt[doc]) >> np.uint64(64 - ID_BITS))
    return np.insert(ids, first[:-1], edge), np.insert(ids, first[1:], edge), np.insert(doc, first[1:], np.arange(n)), np.insert(new, first[1:], False)


def _pair_id(v: np.ndarray, w: np.ndarray, cuts: int) -> np.ndarray:
    """A hash of (v, w) that starts with the shard of v."""
    low = np.uint64(ID_BITS - cuts)
    return (v >> low << low) | (ts.mix(v * np.uint64(0x9E3779B97F4A7C15) + w) >> np.uint64(64 - ID_BITS + cuts))


def _pack(*arrays: np.ndarray) -> bytes:
    """Unsigned integers, each array in as many bytes as its largest value needs, byte after byte, which
    compresses best; other arrays as they are."""
    out = []
    for a in arrays:
        if a.dtype.kind == "f":
            out.append((len(a), 0, a.astype("<f8").tobytes()))
        else:
            size = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
            out.append((len(a), size, a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()))
    return np.array([x[:2] for x in out], "<i8").tobytes() + b"".join(x[2] for x in out)


def _unpack(body: bytes | pa.Buffer, n: int) -> list[np.ndarray]:
    body = memoryview(body)
    out, at = [], 16 * n
    for length, size in np.frombuffer(body, "<i8", 2 * n).reshape(n, 2).tolist():
        if size:
            x = np.zeros((length, 8), np.uint8)
            x[:, :size] = np.frombuffer(body, np.uint8, length * size, at).reshape(size, length).T
            out.append(x.view("<u8").ravel())
        else:
            out.append(np.frombuffer(body, "<f8", length, at))
        at += length * (size or 8)
    return out


def _edges(ids: np.ndarray, cuts: int) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of each shard that sorted ids have."""
    edge = np.searchsorted(ids, np.arange((1 << cuts) + 1, dtype=np.uint64) << np.uint64(ID_BITS - cuts))
    return [(s, a, b) for s, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if b > a]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], NAMES)


def _rows(table: pa.Table) -> list[tuple]:
    """(slot, kind, source, body) in order of kind and source."""
    slot, kind, source = (table.column(c).to_pylist() for c in ("slot", "kind", "source"))
    bodies = [x.as_buffer() for x in table.column("body")]
    return sorted(zip(slot, kind, source, bodies, strict=True), key=lambda r: r[1:3])


def _bins(x: np.ndarray) -> np.ndarray:
    """How many values there are of 0 to 255, then of 256 to 511, 512 to 1023 and so on."""
    x = x.astype(np.int64)
    return np.bincount(np.where(x < 256, x, 248 + np.log2(np.maximum(x, 1)).astype(np.int64)), minlength=BINS)


def _level(hist: np.ndarray, most: int) -> int:
    """The least value from which on there are at most `most`."""
    above = np.cumsum(hist[::-1])[::-1]
    at = max(1, int(np.argmax(above <= most)))
    return at if at < 256 else 1 << (at - 248)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _summed(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, v))
    v, w, c = v[order], w[order], c[order].astype(np.uint64)
    head = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])) if len(v) else np.zeros(0, np.int64)
    return v[head], w[head], np.add.reduceat(c, head) if len(head) else c


def _count(docs: DataFrame, known, cuts: int) -> DataFrame:
    """ROWS and hist.  SEEN: each shard's bigrams (first words, how many each has, second words, counts), and
    as hist the counts of counts, of how often words stand first, and of unknown words.  HEADS (source: the
    asking shard): second words and how many different first ones each has there."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        n = 0

        def flush():
            rows = []
            for lang, parts in sorted(held.items()):
                v, w = (np.concatenate([p[i] for p in parts]) for i in range(2))
                v, w, c = _summed(v, w, np.ones(len(v), np.uint64))
                rows += [(lang, s, 0, SEEN, 0, _pack(v[a:b], w[a:b], c[a:b])) for s, a, b in _edges(v, cuts)]
            return _batch(rows)

        for part in ts.slices(batches, "text"):
            langs = part.column(0).to_pylist()
            v, w, doc, _ = _pairs(langs, part.column(1), known.value)
            of = np.array(langs, object)[doc] if len(set(langs)) > 1 else None
            for lang in set(langs):
                own = slice(None) if of is None else of == lang
                held.setdefault(lang, []).append((v[own], w[own]))
            n += len(v)
            if n >= FLUSH:
                yield flush()
                held, n = {}, 0
        if n:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        lang, shard = table.column("lang")[0].as_py(), table.column("shard")[0].as_py()
        v, w, c = _summed(*(np.concatenate(x) for x in zip(*(_unpack(r[3], 3) for r in _rows(table)), strict=True)))
        head = _runs(v)
        times = np.diff(np.append(head, len(v)))
        extra = [int((w == _salts(lang)[2]) @ c), len(v)]
        heads, k = np.unique(w, return_counts=True)
        rows = [(lang, shard, 0, SEEN, 0, _pack(v[head], times, w, c))]
        rows += [(lang, s, 0, HEADS, shard, _pack(heads[a:b], k[a:b])) for s, a, b in _edges(heads, cuts)]
        hist = [[*_bins(c).tolist(), *_bins(np.add.reduceat(c, head)).tolist(), *extra]] + [None] * (len(rows) - 1)
        marks = np.unique((_pair_id(v, w, cuts) >> np.uint64(ID_BITS - WORD_BITS)) & np.uint64((1 << max(0, WORD_BITS - cuts)) - 1))
        got = pa.Table.from_batches([_batch(rows)]).append_column("hist", pa.array(hist, pa.list_(pa.int64())))
        return got.append_column("marks", pa.array([frequency.pack(marks.astype(np.int64))] + [None] * (len(rows) - 1), pa.binary()))

    packed = docs.select("_lang", "text").mapInArrow(emit, ROWS)
    return cut(packed.groupBy("lang", "shard").applyInArrow(merge, ROWS + ", hist array<long>, marks binary"))


def _heads(counted: DataFrame) -> DataFrame:
    """ROWS and hist.  HEADS: each shard's words and their k (hist: counts of k).  REPLY (source: the shard that
    the words are of): the k of the words that the shard has told of, in their order."""

    def merge(table: pa.Table) -> pa.Table:
        lang, shard = table.column("lang")[0].as_py(), table.column("shard")[0].as_py()
        asked = [(source, *_unpack(body, 2)) for _, _, source, body in _rows(table)]
        w, which = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True)
        k = np.bincount(which, weights=np.concatenate([x[2] for x in asked])).astype(np.uint64)
        rows = [(lang, shard, 0, HEADS, 0, _pack(w, k))] + [(lang, source, 0, REPLY, shard, _pack(k[np.searchsorted(w, own)])) for source, own, _ in asked]
        return pa.Table.from_batches([_batch(rows)]).append_column("hist", pa.array([_bins(k).tolist() + [len(w)]] + [None] * (len(rows) - 1), pa.list_(pa.int64())))

    return cut(counted.where(F.col("kind") == HEADS).drop("hist", "marks").groupBy("lang", "shard").applyInArrow(merge, ROWS + ", hist array<long>"))


@dataclass
class Rates:
    """What a language's counts are turned into probabilities with."""

    d2: np.ndarray
    d1: np.ndarray
    pairs: float  # different bigrams
    rest: float  # g1 / (n + 1)
    unknown: float  # the log of how many different unknown words there were, and one

    def word(self, k: np.ndarray) -> np.ndarray:
        return np.log((k - self.d1[np.minimum(k, 3).astype(np.int64)]) / self.pairs + self.rest)


def _rates(counted: DataFrame, heads: DataFrame) -> tuple[dict[str, Rates], list[np.ndarray]]:
    """Of each language; and how many bigrams and words of each count there are, in all languages."""
    total = lambda rows: {r["lang"]: np.array(r["x"]) for r in rows.where("hist is not null").select("lang", F.posexplode("hist")).groupBy("lang", "pos").agg(F.sum("col").alias("col")).groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "col"))), lambda p: p["col"]).alias("x")).collect()}
    pairs, singles = total(counted), total(heads)
    out, found = {}, [np.zeros(BINS, np.int64) for _ in range(3)]
    for lang, x in pairs.items():
        k = singles[lang]
        d2, d1 = _discounts(*x[1:5].tolist()), _discounts(*k[1:5].tolist())
        taken = d1[1] * k[1] + d1[2] * k[2] + d1[3] * k[3:BINS].sum()
        out[lang] = Rates(d2, d1, float(x[-1]), float(taken / x[-1] / (k[-1] + 1)), float(np.log(x[-2] + 1)))
        for all_, own in zip(found, (x[:BINS], x[BINS : 2 * BINS], k[:BINS]), strict=True):
            all_ += own
    return out, found


def _contexts(times: np.ndarray, c: np.ndarray, rates: Rates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """t and g of first words that have `times` bigrams each, and (c - d) / t of all bigrams."""
    head = np.cumsum(times) - times
    off = rates.d2[np.minimum(c, 3).astype(np.int64)]
    t = np.add.reduceat(c.astype(np.float64), head.astype(np.int64))
    return t, np.add.reduceat(off, head.astype(np.int64)) / t, (c - off) / np.repeat(t, times.astype(np.int64))


class Table:
    """Values by sorted hash."""

    def __init__(self, key: np.ndarray, value: np.ndarray, bits: int = 18):
        order = np.argsort(key)
        self.key, self.value, self.low = np.append(key[order], np.uint64((1 << 64) - 1)), np.append(value[order].astype(np.float32), np.float32(0)), np.uint64(ID_BITS - bits)
        self.edge = np.searchsorted(self.key[:-1], np.arange(1 << bits, dtype=np.uint64) << self.low).astype(np.int32)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value (0 if not)."""
        at = self.edge[(key >> self.low).astype(np.int64)]
        on = np.flatnonzero(self.key[at] < key)
        while len(on):
            at[on] += 1
            on = on[self.key[at[on]] < key[on]]
        hit = self.key[at] == key
        return hit, np.where(hit, self.value[at], np.float32(0))


@dataclass
class Sent:
    """What every task gets: of fixed size, whatever the corpus."""

    known: Survey
    seen: np.ndarray  # bitmap of bigrams
    pair: Table
    first: Table
    word: Table
    rates: dict[str, Rates]


def _sent(counted: DataFrame, heads: DataFrame, known: Survey, cuts: int) -> Sent:
    rates, hists = _rates(counted, heads)
    level = {name: _level(h, HOT[name]) for name, h in zip(("pair", "first", "word"), hists, strict=True)}

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, kind, body in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(5), strict=True):
                if kind == HEADS:
                    w, k = _unpack(body.as_buffer(), 2)
                    own = k >= level["word"]
                    rows.append((lang, 0, 0, HEADS, 0, _pack(w[own], k[own])))
                else:
                    v, times, w, c = _unpack(body.as_buffer(), 4)
                    t, g, p = _contexts(times, c, rates[lang])
                    own, pair = t >= level["first"], c >= level["pair"]
                    of = np.repeat(np.arange(len(v)), times.astype(np.int64))
                    rows.append((lang, 0, 0, SEEN, 0, _pack(v[own], np.log(g[own]), v[of][pair], w[pair], p[pair] / g[of][pair])))
            yield _batch(rows)

    both = counted.where(F.col("kind") == SEEN).select(*NAMES).unionAll(heads.where(F.col("kind") == HEADS).select(*NAMES))
    word, first, pair = [], [], []
    # One job; at most HOT terms come.
    for lang, kind, body in zip(*both.mapInArrow(hot, ROWS).select("lang", "kind", "body").toArrow().columns, strict=True):
        if kind.as_py() == HEADS:
            w, k = _unpack(body.as_buffer(), 2)
            word.append((w, rates[lang.as_py()].word(k)))
        else:
            v, g, *rest = _unpack(body.as_buffer(), 5)
            first.append((v, g))
            pair.append(rest)
    every = lambda parts, n: [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64)] * n
    words_, firsts, (v, w, ratio) = Table(*every(word, 2)), Table(*every(first, 2)), every(pair, 3)
    hit, log_p = words_.find(w)  # a bigram whose second word isn't hot is asked for
    pairs = Table(_pair_id(v, w, cuts)[hit], np.log1p(ratio[hit] / np.exp(log_p[hit])), 20)

    section = 1 << max(0, WORD_BITS - cuts)

    def flags(table: pa.Table) -> pa.Table:
        on = np.zeros(section, bool)
        for x in table.column("marks"):
            on[frequency.unpack(bytes(x.as_py()))] = True
        return pa.table({"shard": table.column("shard")[:1], "flags": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    seen = np.zeros((1 << cuts, max(1, section >> 3)), np.uint8)
    for shard, on in zip(*counted.where("marks is not null").select("shard", "marks").groupBy("shard").applyInArrow(flags, "shard int, flags binary").toArrow().columns, strict=True):
        seen[shard.as_py()] = np.frombuffer(on.as_buffer(), np.uint8)
    return Sent(known, seen.ravel(), pairs, firsts, words_, rates)


def _ask(docs: DataFrame, sent, cuts: int, slots: int) -> DataFrame:
    """ROWS.  BASE: a chunk's (source's) texts of a language, with what hot terms give and the number of their
    bigrams.  ASK: hashes (steps, sorted) and places of texts of a shard's bigrams, first and second words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Sent = sent.value
        chunk, texts, asked, n, m = (TaskContext.get().partitionId() << 32), [], [], 0, 0

        def flush():
            rows, slot = [], int(ts.mix(np.array([chunk], np.uint64))[0])
            langs = np.concatenate([t[0] for t in texts])
            key, base, count = (np.concatenate([t[i] for t in texts]) for i in (1, 2, 3))
            for lang in sorted(set(langs.tolist())):
                own = np.flatnonzero(langs == lang)
                rows.append((lang, slot % (1 << cuts), slot // (1 << cuts) % slots, BASE, chunk, _pack(own.astype(np.uint64), key[own], count[own], base[own])))
                found: dict[int, list] = {}
                for i in range(3):
                    ids, doc = (np.concatenate([a[i][j] for a in asked]) for j in range(2))
                    mine = langs[doc] == lang if len(own) < len(langs) else slice(None)
                    ids, doc = ids[mine], doc[mine]
                    order = np.argsort(ids)
                    ids, doc = ids[order], doc[order]
                    for s, a, b in _edges(ids, cuts):
                        found.setdefault(s, [np.zeros(0, np.uint64)] * 6)[2 * i : 2 * i + 2] = np.diff(ids[a:b], prepend=np.uint64(s) << np.uint64(ID_BITS - cuts)), doc[a:b].astype(np.uint64)
                rows += [(lang, s, slot // (1 << cuts) % slots, ASK, chunk, _pack(*arrays)) for s, arrays in found.items()]
            return _batch(rows)

        for part in ts.slices(batches, "text"):
            langs = part.column(0).to_pylist()
            v, w, doc, new = _pairs(langs, part.column(2), x.known)
            pair = _pair_id(v, w, cuts)
            at = pair >> np.uint64(ID_BITS - WORD_BITS)
            maybe = np.flatnonzero((x.seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            unknown = np.array([x.rates[lang].unknown for lang in langs])
            total = -np.bincount(doc, weights=new, minlength=len(langs)) * unknown
            ask = []
            for table, ids, of in ((x.pair, pair[maybe], doc[maybe]), (x.first, v, doc), (x.word, w, doc)):
                hit, value = table.find(ids)
                total += np.bincount(of, weights=value, minlength=len(langs))
                ask.append((ids[~hit], of[~hit] + m))
                n += len(ask[-1][0])
            texts.append((np.array(langs, object), part.column(1).to_numpy(zero_copy_only=False).view(np.uint64), total, np.bincount(doc, minlength=len(langs)).astype(np.uint64)))
            asked.append(ask)
            m += len(langs)
            if n >= FLUSH or m >= FLUSH_TEXTS:
                yield flush()
                chunk, texts, asked, n, m = chunk + 1, [], [], 0, 0
        if texts:
            yield flush()

    return docs.select("_lang", "_key", "text").mapInArrow(run, ROWS)


def _answer(rows: DataFrame, rates: dict[str, Rates], cuts: int) -> DataFrame:
    """_lang, _key, total (log probability) and n of every text; rows: SEEN, HEADS, REPLY (in every slot), ASK and BASE."""

    def answer(table: pa.Table) -> pa.Table:
        lang, shard = table.column("lang")[0].as_py(), table.column("shard")[0].as_py()
        own, rows = rates[lang], _rows(table)
        out = [(lang, 0, 0, BASE, source, bytes(body)) for _, kind, source, body in rows if kind == BASE]
        tables = [(np.zeros(0, np.uint64), np.zeros(0), none) for none in (0.0, 0.0, float(np.log(own.rest)))]
        for _, kind, _, body in rows:
            if kind == SEEN:
                v, times, w, c = _unpack(body, 4)
                heads, which = np.unique(w, return_inverse=True)
                k = np.concatenate([_unpack(r[3], 1)[0] for r in rows if r[1] == REPLY])
                _, g, p = _contexts(times, c, own)
                of = np.repeat(np.arange(len(v)), times.astype(np.int64))
                value = np.log1p(p / (g[of] * np.exp(own.word(k))[which]))
                ids = _pair_id(v[of], w, cuts)
                order = np.argsort(ids)
                tables[0], tables[1] = (ids[order], value[order], 0.0), (v, np.log(g), 0.0)
            elif kind == HEADS:
                w, k = _unpack(body, 2)
                tables[2] = w, own.word(k), tables[2][2]
        for _, kind, source, body in rows:
            if kind == ASK:
                asked, total = _unpack(body, 6), []
                for i, (key, value, none) in enumerate(tables):
                    ids = np.cumsum(asked[2 * i]) + (np.uint64(shard) << np.uint64(ID_BITS - cuts))
                    at = np.searchsorted(key, ids)
                    hit = np.append(key, np.uint64((1 << 64) - 1))[at] == ids
                    total.append(np.where(hit, np.append(value, none)[at], none))
                doc, which = np.unique(np.concatenate(asked[1::2]), return_inverse=True)
                out.append((lang, 0, 0, REPLY, source, _pack(doc, np.bincount(which, weights=np.concatenate(total)))))
        return pa.Table.from_batches([_batch(out)])

    def add(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        doc, key, n, base = _unpack(next(r[3] for r in rows if r[1] == BASE), 4)
        total = base.copy()
        for _, kind, _, body in rows:
            if kind == REPLY:
                own, more = _unpack(body, 2)
                total[np.searchsorted(doc, own)] += more
        return pa.table({"_lang": pa.array([table.column("lang")[0].as_py()] * len(doc)), "_key": key.view(np.int64), "total": np.round(total, 4), "n": n.astype(np.int64)})

    sums = rows.groupBy("lang", "shard", "slot").applyInArrow(answer, ROWS)
    added = sums.groupBy("lang", "source").applyInArrow(add, "_lang string, _key long, total double, n long")
    return added.groupBy("_lang", "_key").agg(F.min("total").alias("total"), F.min("n").alias("n"))


def _limits(costs: DataFrame, languages: list[str], quantile: float) -> dict[str, float]:
    """Each language's threshold, from _lang and cost of held-out documents: of n, the one of rank
    (n + 1) quantile (split conformal: a document like them exceeds it no more often than 1 - quantile)."""
    costs = cut(costs)
    n = {r["_lang"]: r["n"] for r in costs.rollup("_lang").agg(F.count("cost").alias("n")).collect() if r["n"]}
    part = {x: (min(m, math.ceil((m + 1) * quantile)) - 0.5) / m for x, m in n.items()}
    every = sorted(set(part.values()))
    rows = costs.rollup("_lang").agg(F.percentile_approx("cost", F.array(*map(F.lit, every)), F.lit(10000)).alias("q")).collect() if every else []
    found = {r["_lang"]: math.exp(r["q"][every.index(part[r["_lang"]])]) for r in rows if r["_lang"] in n}
    return {x: found.get(x, found.get(None, np.inf)) for x in languages}


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The columns of docs and perplexity, threshold and kept (input columns of these names are replaced).

    A null or empty text has no perplexity and isn't kept.  A null language is one of its own.  A
    language without trusted text has no model: its documents have no perplexity and are kept
    unless empty.  Equal rows give equal rows (and count as often as they stand in the table when
    the model is trained); an empty table gives an empty result."""
    docs = _language(docs.drop("perplexity", "threshold", "kept", "_lang")).withColumn("_key", F.xxhash64("text"))
    spark = docs.sparkSession
    trusted = _only(docs.select("doc_id", "_lang", "_key", "text").where("length(text) > 0"), cut(trusted_ids(labels)))
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(HELD_OUT)) == 0
    train = trusted.where(~held_out)
    size = volume(train)
    names = [x for x in docs.columns if x not in ("_lang", "_key")]
    none = F.lit(None).cast("double")
    if not size:
        return docs.select(*names, none.alias("perplexity"), none.alias("threshold"), F.coalesce(F.length("text") > 0, F.lit(False)).alias("kept"))
    cuts = shard_bits(size // 6)

    def hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ts.span_hash(ts.LOWER[data], *words(data, at))

    known = survey(train.select("text"), hashes, size // 6, WORD_BITS, 0)
    context = spark.sparkContext
    sent = context.broadcast(known)
    counted = _count(train, sent, cuts)
    sent.destroy()
    heads = _heads(counted)
    model = _sent(counted, heads, known, cuts)
    rates, languages = model.rates, sorted(model.rates)
    sent = context.broadcast(model)
    del model, known
    scored = docs.where((F.length("text") > 0) & F.col("_lang").isin(languages))
    slots = 1 + volume(scored) // (SLOT << (cuts - 5))
    every = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<int>"))
    model_rows = counted.where(F.col("kind") == SEEN).select(*NAMES).unionAll(heads.select(*NAMES)).withColumn("slot", every).select(*NAMES)
    totals = cut(_answer(model_rows.unionAll(_ask(scored, sent, cuts, slots)), rates, cuts))
    sent.destroy()
    sent_totals = F.broadcast(totals) if totals.count() <= SENT_IDS else totals
    cost = -F.col("total") / F.col("n")
    limits = _limits(trusted.where(held_out).join(sent_totals, ["_lang", "_key"]).select("_lang", cost.alias("cost")), languages, quantile)
    thresholds = spark.createDataFrame([(x, y) for x, y in limits.items() if np.isfinite(y)], "_lang string, threshold double")
    out = docs.join(sent_totals, ["_lang", "_key"], "left").join(F.broadcast(thresholds), "_lang", "left").withColumn("perplexity", F.when(F.col("total").isNotNull(), F.exp(F.least(cost, F.lit(700.0)))))
    kept = (F.length("text") > 0) & (F.col("perplexity").isNull() | F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select(*names, "perplexity", "threshold", F.coalesce(kept, F.lit(False)).alias("kept"))
