"""Exact Jaccard joins of token sets, for shingles of documents and words of lines.

1. Tokens are ordered: those that occur once in the corpus first (they can't be shared and are
   never posted), then by rarity (frequency.py).  Sets of similarity t or more share a token among
   the first n - ceil(t n) + 1 of each, so each set is posted under these (prefix filter).
2. In a posting list pairs are left out by size (length filter), by place (positional filter), by
   how many of their tokens occur elsewhere at all, and by signatures of 128 or 256 bits: bit h holds the
   parity of a set's tokens of hash h, so signatures differ in no more bits than sets in tokens.
   Where only the first similar set counts (lines), each set of a dense list is compared with the first
   that it may be similar to, and with the others before it only if that one isn't (`later`).
   Where all links count (documents) and CLUSTER or more sets of a list may be similar to one, that is
   their leader, and they are compared with it only, and with the sets outside.
3. Pairs are verified on whole sets, and a member's differences to its leader are kept.
4. Members that the leader did not settle are compared with the leader's group by what is known:
   with A(x) = leader - x and B(x) = x - leader,
       |x & z| = |leader| - |A(x)| - |A(z)| + |A(x) & A(z)| + |B(x) & B(z)|,
   so only the small differences are matched.  1 - J is a metric: members nearer to the leader
   than x's distance less 1 - t are skipped unseen.  Both sides go in blocks, so that no task
   holds a whole group.

Sets are known by a 64-bit hash of their tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .frequency import Survey
from .storage import cut

CLUSTER = 24  # sets of a list that may be similar to one, from which it leads them
WINDOW = 2048  # longer lists are looked through for leaders first
TRIES = 8
CELLS = 1 << 18  # pairs that are looked at together
X_BLOCK, Z_BLOCK = 256, 1024
TOKENS = 1 << 18  # of either side of a block of whole sets
GROUPS = 500_000  # groups whose sizes are sent to all tasks; with more, they are joined
SPARSE = 8  # pairs for each entry of a list, above which it is dense
SMALL, FIRSTS = 32, 256  # first ones of a long list that are tried, together and in all


def posting(signs: int) -> np.dtype:
    """A posting with a signature of 64 * signs bits."""
    return np.dtype([("word", "<u8"), ("set", "<u8"), ("rank", "<u4"), ("n", "<u4"), ("place", "<u4"), ("shared", "<u4"), ("sign", "<u8", (signs,))])


def to_bytes(x: np.ndarray) -> bytes:
    """Field after field, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(x[f]).tobytes() for f in x.dtype.names)


def from_bytes(blob: bytes | pa.Buffer, dtype: np.dtype) -> np.ndarray:
    blob = memoryview(blob)
    n, at = len(blob) // dtype.itemsize, 0
    out = np.empty(n, dtype)
    for f in dtype.names:
        size = n * dtype[f].itemsize
        out[f] = np.frombuffer(blob[at : at + size], dtype[f].base).reshape(out[f].shape)
        at += size
    return out


def blobs(table: pa.Table, name: str) -> list[pa.Buffer]:
    """A binary column's values, without copies."""
    return [x.as_buffer() for x in table.column(name)]


def least_overlap(a, b, num: int, den: int):
    """The smallest overlap at which sets of sizes a and b have similarity num / den."""
    return -(-num * (a + b) // (num + den))


def postings(of: np.ndarray, token: np.ndarray, n: np.ndarray, ids: np.ndarray, rank: np.ndarray | None, known: Survey, num: int, den: int, signs: int = 4) -> np.ndarray:
    """Prefix postings of sets: of (sorted) tells each token's set; n, ids and rank are by set.

    The set of least rank leads a long list; without rank, that with the fewest tokens of its own."""
    common = known.repeated(token)
    shared = np.bincount(of[common], minlength=len(n))
    sign = np.zeros((len(n), signs), np.uint64)
    if len(of):
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        h = ts.mix(token ^ np.uint64(0xA0761D6478BD642F))
        bit, part = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) & np.uint64(signs - 1)
        for w in range(signs):
            sign[of[starts], w] = np.bitwise_xor.reduceat(np.where(part == w, bit, np.uint64(0)), starts)
    able = common & (den * shared >= num * n)[of]
    of, token = of[able], token[able]
    order = _by_rank(of, known.rank(token))
    of, token = of[order], token[order]
    place = _within(of) + (n - shared)[of]
    kept = place < n[of] - (-(-num * n[of] // den)) + 1
    of = of[kept]
    out = np.empty(len(of), posting(signs))
    out["word"], out["set"], out["n"], out["place"], out["shared"] = token[kept], ids[of], n[of], place[kept], shared[of]
    out["sign"] = sign[of]
    out["rank"] = np.clip((n - shared)[of] if rank is None else rank[of], 0, 0xFFFFFFFF)
    return out


def _within(of: np.ndarray) -> np.ndarray:
    """Each entry's place among those of its set; of is sorted."""
    head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return np.arange(len(of)) - np.repeat(head, np.diff(np.concatenate([head, [len(of)]])))


def _by_rank(of: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order of a set's tokens by rank, equal ranks as they stand; of is sorted."""
    within = _within(of)
    if len(of) and (of[-1] >= 1 << 21 or within.max() >= 1 << 21):
        return np.lexsort((rank, of))
    return np.argsort((of << 42) | (rank << 21) | within)  # no two are equal, so any sort will do


def distinct(x: np.ndarray) -> np.ndarray:
    """One posting for each (word, set), of its least rank, in order of word."""
    key = ts.mix(x["word"] ^ ts.mix(x["set"] + np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    word, sets = x["word"][order], x["set"][order]
    same = (word[1:] == word[:-1]) & (sets[1:] == sets[:-1])
    if (same != (np.diff(key[order]) == 0)).any():  # two keys met
        order = np.lexsort((x["set"], x["word"]))
        word, sets = x["word"][order], x["set"][order]
        same = (word[1:] == word[:-1]) & (sets[1:] == sets[:-1])
    if not len(x):
        return x
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    rank = np.minimum.reduceat(x["rank"][order], head)
    x = x[order[head]]
    x["rank"] = rank
    return x[np.argsort(x["word"])]


def _listed(x: np.ndarray) -> np.ndarray:
    """Postings (in order of word) in order of word, then n, then rank."""
    word = np.concatenate([[0], np.cumsum(x["word"][1:] != x["word"][:-1])]) if len(x) else np.zeros(0, np.int64)
    if len(x) >= 1 << 22 or len(x) and x["n"].max() >= 1 << 21:
        return x[np.lexsort((x["rank"], x["n"], word))]
    return x[np.argsort((word.astype(np.int64) << 41) | (x["n"].astype(np.int64) << 20) | (x["rank"] >> 12).astype(np.int64))]


def packed(entries: np.ndarray, key: np.ndarray, cuts: int) -> dict[int, bytes]:
    """Entries (sorted by key, 64 bits) of each shard, as bytes."""
    edge = np.searchsorted((key >> np.uint64(64 - cuts)).astype(np.int64), np.arange((1 << cuts) + 1))
    return {s: to_bytes(entries[a:b]) for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a}


def both_packed(first: dict[int, bytes], second: dict[int, bytes]) -> list[pa.Array]:
    shards = sorted(first.keys() | second.keys())
    return [pa.array(shards, pa.int32()), *(pa.array([x.get(s, b"") for s in shards], pa.binary()) for x in (first, second))]


class Lists:
    """Posting lists of a shard, and the filters for pairs of their entries."""

    def __init__(self, x: np.ndarray, num: int, den: int):
        x = _listed(distinct(x))
        self.num, self.den, self.set, self.sign, self.rank = num, den, x["set"], np.ascontiguousarray(x["sign"]), x["rank"].astype(np.int64)
        n, place, shared = (x[k].astype(np.int64) for k in ("n", "place", "shared"))
        self.n, self.before, self.after = n, place - n + shared, n - place  # common tokens before this place, all from it on
        self.word = x["word"]
        self.head = np.flatnonzero(np.concatenate([[True], x["word"][1:] != x["word"][:-1]])) if len(x) else np.zeros(0, np.int64)
        self.size = np.diff(np.concatenate([self.head, [len(x)]]))

    def may(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether entries i and j (of one list, as arrays) can be similar."""
        n, m = self.n[i], self.n[j]
        need = least_overlap(n, m, self.num, self.den)
        good = np.minimum(self.before[i], self.before[j]) + np.minimum(self.after[i], self.after[j]) >= need
        good &= np.minimum(n, m) >= need
        at = np.flatnonzero(good)
        differ = np.bitwise_count(self.sign[i[at]] ^ self.sign[j[at]]).sum(1)
        good[at] = differ <= (n + m - 2 * need)[at]
        return good

    def within(self, entries: np.ndarray, of: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs of entries of one list that can be similar; entries rise by list (of), then by n."""
        key = of * (1 << 33) + self.n[entries]
        stop = np.searchsorted(key, of * (1 << 33) + self.n[entries] * self.den // self.num, "right")
        times = np.maximum(stop - np.arange(len(entries)) - 1, 0)
        total, a = np.cumsum(times), 0
        while a < len(entries):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CELLS, "right")))
            t = times[a:b]
            i = np.repeat(np.arange(a, b), t)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(t) - t, t)
            i, j = entries[i], entries[j]
            yield np.stack([i, j])[:, self.may(i, j)]
            a = b

    def firsts(self, k: int) -> np.ndarray:
        """(entry, the first entry by rank that it may be similar to) of list k, for those that have one among
        the FIRSTS first."""
        own = np.arange(self.head[k], self.head[k] + self.size[k])
        own = own[np.lexsort((self.set[own], self.rank[own]))]
        partner = np.full(len(own), -1)
        for a in range(0, min(FIRSTS, len(own)), SMALL):
            lead, left = np.arange(a, min(a + SMALL, len(own))), np.flatnonzero(partner < 0)
            left = left[left > a]
            step = CELLS // SMALL
            for c in range(0, len(left), step):
                x = left[c : c + step]
                i, j = np.repeat(x, len(lead)), np.tile(lead, len(x))
                hit = (j < i).reshape(len(x), -1)
                hit[hit] = self.may(own[i[hit.ravel()]], own[j[hit.ravel()]])
                some = hit.any(1)
                partner[x[some]] = a + hit[some].argmax(1)
        at = np.flatnonzero(partner >= 0)
        return np.stack([own[at], own[partner[at]]])

    def met_first(self, pairs: np.ndarray) -> np.ndarray:
        """(entry, the first by rank of those it is paired with that rank before it)."""
        i, j = pairs
        late = (self.rank[i] > self.rank[j]) | ((self.rank[i] == self.rank[j]) & (self.set[i] > self.set[j]))
        i, j = np.where(late, i, j), np.where(late, j, i)
        order = np.lexsort((self.set[j], self.rank[j], i))
        i, j = i[order], j[order]
        new = np.ones(len(i), bool)
        new[1:] = i[1:] != i[:-1]
        return np.stack([i, j])[:, new]

    def earliest(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of entries to compare, and the entries of dense lists, whose pairs with first ones are
        among them and whose other pairs `later` gives."""
        pairs, dense = [np.zeros((2, 0), np.int64)], np.zeros(len(self.size), bool)
        for k in np.flatnonzero(self.size > WINDOW):
            found = self.firsts(k)
            dense[k] = found.shape[1] >= self.size[k] >> 3
            if not dense[k]:  # its first ones are like few others, but these may be like one another
                parts, held = [np.zeros((2, 0), np.int64)], 0
                for part in self.within(np.arange(self.head[k], self.head[k] + self.size[k]), np.full(self.size[k], k)):
                    parts.append(part)
                    held += part.shape[1]
                    if held > SPARSE * self.size[k]:
                        dense[k], parts = True, [self.met_first(np.concatenate(parts, 1))]
                        held = parts[0].shape[1]
                found = np.concatenate(parts, 1)
                found = self.met_first(found) if dense[k] else found
            pairs.append(found)
        lists = np.flatnonzero((self.size > 1) & (self.size <= WINDOW))
        group = np.cumsum(self.size[lists] ** 2) // (CELLS * 4)
        for some in np.split(lists, np.flatnonzero(np.diff(group)) + 1):
            size = self.size[some]
            entries = np.repeat(self.head[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            found = np.concatenate([np.zeros((2, 0), np.int64), *self.within(entries, np.repeat(some, size))], 1)
            which = np.searchsorted(self.head, found[0], "right") - 1
            many = np.bincount(which, minlength=len(self.head)) > SPARSE * self.size
            at = many[which]
            pairs.append(found[:, ~at])
            if at.any():
                dense |= many
                pairs.append(self.met_first(found[:, at]))
        return np.concatenate(pairs, 1), np.flatnonzero(np.repeat(dense, self.size))

    def cluster(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one list: those that stay, and (member, leader) of its clusters; a cluster's
        other pairs are left out."""
        entries, at = np.unique(pairs, return_inverse=True)
        at = at.reshape(2, -1)
        u, v = np.concatenate([at[0], at[1]]), np.concatenate([at[1], at[0]])
        order = np.argsort(u, kind="stable")
        v, first = v[order], np.searchsorted(u[order], np.arange(len(entries) + 1))
        own, led = np.full(len(entries), -1), [np.zeros((2, 0), np.int64)]
        degree = np.diff(first)
        for e in np.lexsort((self.set[entries], self.rank[entries])):
            if own[e] >= 0 or degree[e] < CLUSTER:
                continue
            near = v[first[e] : first[e + 1]]
            near = near[own[near] < 0]
            if len(near) >= CLUSTER:
                own[near] = own[e] = e
                led.append(np.stack([entries[near], np.full(len(near), entries[e])]))
        stays = (own[at[0]] < 0) | (own[at[0]] != own[at[1]])
        return pairs[:, stays], np.concatenate(led, 1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Entries to compare: (i, j) as they are, and (member, leader)."""
        plain, led = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
        lists = np.flatnonzero((self.size > 1) & (self.size <= WINDOW))
        entries = np.repeat(self.head[lists] - (np.cumsum(self.size[lists]) - self.size[lists]), self.size[lists]) + np.arange(int(self.size[lists].sum()))
        parts = [(entries, np.repeat(lists, self.size[lists]))]
        for k in np.flatnonzero(self.size > WINDOW):
            left = np.arange(self.head[k], self.head[k] + self.size[k])
            tried, misses = np.zeros(self.size[k], bool), 0
            while len(left) > 1 and misses < TRIES and not tried.all():
                pick = int(np.argmin(np.where(tried, np.iinfo(np.int64).max, self.rank[left])))
                near = self.may(np.full(len(left), left[pick]), left)
                near[pick] = False
                if near.sum() < CLUSTER:
                    tried[pick] = True
                    misses += 1
                    continue
                members, leader = left[near], left[pick]
                rest = ~near
                rest[pick] = False
                left, tried, misses = left[rest], tried[rest], 0
                led.append(np.stack([members, np.full(len(members), leader)]))
                step = max(1, CELLS // max(1, len(left)))
                for a in range(0, len(members), step):
                    i, j = np.repeat(members[a : a + step], len(left)), np.tile(left, len(members[a : a + step]))
                    plain.append(np.stack([i, j])[:, self.may(i, j)])
            parts.append((left, np.full(len(left), k)))
        for entries, of in parts:
            found = np.concatenate([np.zeros((2, 0), np.int64), *self.within(entries, of)], 1)
            which = np.searchsorted(self.head, found[0], "right") - 1
            dense = np.bincount(which, minlength=len(self.head)) > CLUSTER * CLUSTER
            plain.append(found[:, ~dense[which]])
            for k in np.flatnonzero(dense):
                kept, own = self.cluster(found[:, which == k])
                plain.append(kept)
                led.append(own)
        return np.concatenate(plain, 1), np.concatenate(led, 1)


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[new], b[new]], 1).view(np.int64)


def candidates(x: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one shard's postings: pairs of sets to compare (a < b), and (member, leader)."""
    lists = Lists(x, num, den)
    (i, j), (m, leader) = lists.pairs()
    a, b = lists.set[i], lists.set[j]
    return _distinct_pairs(np.minimum(a, b), np.maximum(a, b)), _distinct_pairs(lists.set[m], lists.set[leader])


ENTRY = "word long, set long, rank long, n long, before long, after long, sign binary"


def first_candidates(x: np.ndarray, num: int, den: int) -> tuple[np.ndarray, pa.RecordBatch]:
    """Of one shard's postings: pairs of sets to compare (a < b), and the dense lists' entries as rows of ENTRY."""
    lists = Lists(x, num, den)
    (i, j), own = lists.earliest()
    a, b = lists.set[i], lists.set[j]
    width = lists.sign.shape[1] * 8
    sign = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(own), [None, pa.py_buffer(np.ascontiguousarray(lists.sign[own]))]).cast(pa.binary())
    columns = [lists.word[own].view(np.int64), lists.set[own].view(np.int64), lists.rank[own], lists.n[own], lists.before[own], lists.after[own]]
    return _distinct_pairs(np.minimum(a, b), np.maximum(a, b)), pa.RecordBatch.from_arrays([*map(pa.array, columns), sign], [c.split()[0] for c in ENTRY.split(", ")])


def _sent(per: DataFrame) -> DataFrame:
    """A small row for each group: sent to all tasks if there are few, so that no group's rows must meet."""
    per = cut(per)
    return F.broadcast(per) if per.count() <= GROUPS else per


def overlaps(of: np.ndarray, token: np.ndarray, first: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many tokens the sets i and j (as arrays) have in common.  Set k's are token[first[k]:][:n[k]], and of is k there."""
    _, code = np.unique(token, return_inverse=True)
    width = len(token) + 1
    held, out = np.sort(of * width + code), np.empty(len(i), np.int64)
    total, a = np.cumsum(n[i]), 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CELLS, "right")))
        t = n[i[a:b]]
        at = np.arange(int(t.sum())) + np.repeat(first[i[a:b]] - (np.cumsum(t) - t), t)
        asked = np.repeat(j[a:b], t) * width + code[at]
        place = np.minimum(np.searchsorted(held, asked), len(held) - 1)
        out[a:b] = np.bincount(np.repeat(np.arange(b - a), t), weights=held[place] == asked, minlength=b - a)
        a = b
    return out


def later(entries: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """id of each set of the entries with `out` that is similar to one of their lists of an earlier key.

    Lists meet in blocks, so that no task holds all of a long one.  Whole sets are compared there and only
    the ids leave it: the pairs of a group of near copies are as many as its square, in each list it shares.
    entries: ENTRY and out; sets: id, key (doc, text_hash, number, id), n, tokens."""
    size = lambda which, block: F.ceil(F.greatest(F.count_if(which) / block, F.sum(F.when(which, F.col("n")).otherwise(0)) / TOKENS)).cast("int")
    per = entries.groupBy("word").agg(size(F.col("out"), X_BLOCK).alias("xb"), size(F.lit(True), Z_BLOCK).alias("zb")).where("xb > 0")
    whole = sets.select(F.col("id").alias("set"), "key.doc", "key.text_hash", "key.number", "tokens")
    met = entries.drop("rank").join(_sent(per), "word").join(whole, "set")
    block = lambda seed, n: F.pmod(F.xxhash64("set", F.lit(seed)), F.col(n)).cast("int")
    x = met.where("out").withColumns({"i": block(1, "xb"), "j": F.explode(F.sequence(F.lit(0), F.col("zb") - 1)), "side": F.lit(True)})
    z = met.withColumns({"j": block(2, "zb"), "i": F.explode(F.sequence(F.lit(0), F.col("xb") - 1)), "side": F.lit(False)})

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint64).reshape(len(side), -1)
        sets, n, before, after, *key = (table.column(c).to_numpy() for c in ("set", "n", "before", "after", "number", "text_hash", "doc"))
        token = np.concatenate([c.flatten().to_numpy() for c in table.column("tokens").chunks])
        first, of, place = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n), np.empty(len(n), np.int64)
        place[np.lexsort((sets, *key))] = np.arange(len(n))
        left, right, gone = np.flatnonzero(side), np.flatnonzero(~side), np.zeros(len(n), bool)
        right, a = right[np.argsort(place[right])], 0  # more are similar to the first ones
        while a < len(right) and len(left):
            step = max(1, (CELLS >> 4) // len(left))
            j, i = np.repeat(right[a : a + step], len(left)), np.tile(left, len(right[a : a + step]))
            need = least_overlap(n[i], n[j], num, den)
            good = (place[j] < place[i]) & (sets[i] != sets[j]) & (np.minimum(n[i], n[j]) >= need)
            good &= np.minimum(before[i], before[j]) + np.minimum(after[i], after[j]) >= need
            i, j, need = i[good], j[good], need[good]
            near = np.bitwise_count(sign[i] ^ sign[j]).sum(1) <= n[i] + n[j] - 2 * need
            i, j, need = i[near], j[near], need[near]
            if len(i):
                gone[i[overlaps(of, token, first, n, i, j) >= need]] = True
                left = left[~gone[left]]
            a += step
        return pa.table({"id": sets[gone]})

    both = x.drop("xb", "zb", "out").unionByName(z.drop("xb", "zb", "out"))
    return both.repartition("word", "i", "j").groupBy("word", "i", "j").applyInArrow(run, "id long").distinct()


def verify(found: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b (keys), a_n, b_n, overlap, linked, led, and for led pairs lack (b - a) and more (a - b).

    sets: id, key, n, tokens."""
    x, y = (sets.select(F.col("id").alias(k), F.col("key").alias(f"{k}_key"), F.col("n").alias(f"{k}_n"), F.col("tokens").alias(f"{k}_set")) for k in "ab")
    met = found.join(x, "a").join(y, "b").withColumns({"lack": F.array_except("b_set", "a_set"), "more": F.array_except("a_set", "b_set")})
    met = met.withColumn("overlap", F.col("b_n") - F.size("lack")).withColumn("linked", F.col("overlap") * (num + den) >= num * (F.col("a_n") + F.col("b_n")))
    none = F.array().cast("array<bigint>")
    return cut(met.where("linked or led").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), "a_n", "b_n", "overlap", "linked", "led", *(F.when(F.col("led"), F.col(c)).otherwise(none).alias(c) for c in ("lack", "more"))))


def compare_block(x: list[tuple], z: list[tuple], leader_n: int, num: int, den: int) -> list[tuple]:
    """Links between x and z (both: key, n, A, B), from the differences to their leader."""

    def flat(rows):
        size = np.array([len(r[2]) + len(r[3]) for r in rows], np.int64)
        # A's and B's tokens must not meet: B's are turned over.
        tokens = np.concatenate([np.concatenate([np.asarray(r[2], np.int64), ~np.asarray(r[3], np.int64) ^ 0x55AA]) for r in rows])
        return np.repeat(np.arange(len(rows)), size), tokens

    (xo, xt), (zo, zt) = flat(x), flat(z)
    order = np.argsort(zt, kind="stable")
    zo, zt = zo[order], zt[order]
    low, high = np.searchsorted(zt, xt, "left"), np.searchsorted(zt, xt, "right")
    times = high - low
    at = np.repeat(low, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    both = np.bincount(np.repeat(xo, times) * len(z) + zo[at], minlength=len(x) * len(z)).reshape(len(x), len(z))
    xn, zn = np.array([r[1] for r in x]), np.array([r[1] for r in z])
    xa, za = np.array([len(r[2]) for r in x]), np.array([len(r[2]) for r in z])
    overlap = leader_n - xa[:, None] - za[None] + both
    i, j = np.nonzero((num + den) * overlap >= num * (xn[:, None] + zn[None]))
    return [(x[a][0], z[b][0]) for a, b in zip(i.tolist(), j.tolist(), strict=True) if x[a][0] != z[b][0]]


def unsettled(led: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of the members with `out`, to any member of a group they share (step 4).

    led: a (member), b (leader), a_n, b_n, overlap, lack, more, part, out; members of equal part
    needn't be linked."""
    far = 1 - F.col("overlap") / (F.col("a_n") + F.col("b_n") - F.col("overlap"))
    led = cut(led.select("a", "b", "a_n", "b_n", "lack", "more", "part", "out", far.alias("far")))
    per = led.groupBy("b").agg(F.sum(F.col("out").cast("long")).alias("n_out"), F.count(F.lit(1)).alias("n_all"), F.min(F.when(F.col("out"), F.col("far"))).alias("nearest")).where("n_out > 0 and n_all > 1")
    per = per.withColumns({"xb": F.ceil(F.col("n_out") / X_BLOCK).cast("int"), "zb": F.ceil(F.col("n_all") / Z_BLOCK).cast("int")})
    met = led.join(_sent(per), "b")
    block = lambda seed, n: F.pmod(F.xxhash64("a", F.lit(seed)), F.col(n)).cast("int")
    reach = 1 - num / den + 1e-9
    x = met.where("out").withColumns({"i": block(1, "xb"), "j": F.explode(F.sequence(F.lit(0), F.col("zb") - 1)), "side": F.lit(0)})
    z = met.where(F.col("far") >= F.col("nearest") - reach).withColumns({"j": block(2, "zb"), "i": F.explode(F.sequence(F.lit(0), F.col("xb") - 1)), "side": F.lit(1)})
    columns = ["b", "b_n", "a", "a_n", "lack", "more", "far", "part", "i", "j", "side"]

    def run(pdf):
        import pandas as pd

        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        take = lambda d: list(zip(d.a.tolist(), d.a_n.tolist(), d.lack, d.more, strict=True))
        out, z, z_far, z_part = [], take(right), right.far.to_numpy(), right.part.to_numpy()
        for (part, _), own in left.groupby(["part", left.far // 0.02]):
            fit = np.flatnonzero((z_far >= own.far.min() - reach) & (z_far <= own.far.max() + reach) & (z_part != part))
            if len(fit):
                out += compare_block(take(own), [z[k] for k in fit], int(pdf.b_n.iloc[0]), num, den)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    # Without this exchange the join's, by b alone, would serve, and one task would get all blocks.
    return x.select(*columns).unionByName(z.select(*columns)).repartition("b", "i", "j").groupBy("b", "i", "j").applyInPandas(run, "a long, b long")
