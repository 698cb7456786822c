"""SentencePiece encoding and decoding, with segmentations sampled without replacement.

A text's segmentations are the paths of a lattice whose edges are vocabulary pieces (and byte
pieces for characters that the vocabulary lacks).  Gumbel top-k: give every path its log
probability plus Gumbel noise, and the k largest are k distinct samples.  They are found without
listing paths, by A-star search on perturbed bounds: a node of the search is a prefix of a
segmentation, its bound is the maximum of the noise over all paths that go on from it, and that
maximum is drawn top-down (a child keeps its parent's maximum with its conditional probability;
the other children's maxima are Gumbels cut off below it).  The best open node is taken, its path
completed, and the children that the path passed by become open.

Conditional probabilities come from backward sums over the lattice.  Pieces hold spaces only as a
run at their start and never cross a newline, so the lattice is a chain of small ones, one for each
chunk (a run of spaces and what follows up to the next); equal chunks of a slice share theirs, and all texts of a slice step through them together in numpy.  All noise is a hash
of the row's key, the place in the text and the number of the sample: results don't depend on
how rows are batched.

A literal U+2581 is written as bytes, so that decoding gives every text back exactly; `round_trip` of every
sample says whether it did.  A task holds a text at about 500 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE = 1 << 19
NEAR = 36.74  # the largest -log(-log(u)) that _uniform can give
SPACE = 0x20

SAMPLES = "sample int, ids array<int>, n_pieces long, log_prob double, score double, inclusion double, round_trip boolean"


@dataclass
class Vocabulary:
    """The pieces as a trie over code points; node 0 is none.  Small: it goes along with the task."""

    first: np.ndarray  # by code point: node, or 0
    step_key: np.ndarray  # node << 21 | code point, in one of the two slots of its hash
    step_node: np.ndarray
    piece: np.ndarray  # by node: id, or -1
    log_prob: np.ndarray  # by id
    byte_id: np.ndarray  # by byte
    byte_log_prob: float
    spelled: list[bytes]  # by id
    size: np.ndarray  # bytes, by id

    @classmethod
    def load(cls, model: str = MODEL, offset: float = 10.0) -> Vocabulary:
        """A merge model ranks its pieces; rank r gets a probability in proportion to 1 / (r + offset).

        Pieces without a rank (a score of -1e9: single spaces and runs of them) come after the last."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        n = p.get_piece_size()
        byte_id, spelled, weight, usable, unranked = np.zeros(256, np.int64), [b""] * n, np.zeros(n), [], []
        for i in range(n):
            text = p.id_to_piece(i)
            if p.is_byte(i):
                byte_id[int(text[3:5], 16)] = i
                spelled[i] = bytes([int(text[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                spelled[i] = text.replace("▁", " ").encode()
                usable.append((i, text.replace("▁", " ")))
                if p.get_score(i) > -1e8:
                    weight[i] = 1 / (offset - p.get_score(i) if p.get_score(i) <= 0 else offset)
                else:
                    unranked.append(i)
        lowest = 1 / weight[weight > 0].min() if weight.any() else offset
        weight[unranked] = 1 / (lowest + np.arange(1, len(unranked) + 1))
        log_prob = np.log(np.maximum(weight / weight.sum(), 1e-300))
        nodes: dict[str, int] = {"": 0}
        steps: dict[int, int] = {}
        own = [-1]
        for i, text in usable:
            for j in range(1, len(text) + 1):
                if text[:j] not in nodes:
                    nodes[text[:j]] = len(own)
                    steps[nodes[text[: j - 1]] << 21 | ord(text[j - 1])] = len(own)
                    own.append(-1)
            own[nodes[text]] = i
        first = np.zeros(0x110000, np.int32)
        for key, node in steps.items():
            if key < 1 << 21:
                first[key] = node
        key = np.array(sorted(steps), np.int64)
        return cls(first, *_slots(key, np.array([steps[k] for k in key.tolist()], np.int32)), np.array(own, np.int32), log_prob, byte_id, float(log_prob[weight > 0].min()) - 1.0, spelled, np.array([len(x) for x in spelled]))


    def __post_init__(self):
        self.letters = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.begin = np.cumsum(self.size) - self.size

    def same(self, ids: np.ndarray, n: np.ndarray, data: np.ndarray, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whether each run of n ids spells a space and then the text of docs (data, at: all texts)."""
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        mine = np.diff(total[np.concatenate([[0], np.cumsum(n)])])
        want = at[docs + 1] - at[docs] + 1
        out = mine == want
        first = np.cumsum(mine) - mine
        got = self.letters[np.repeat(self.begin[ids] - total[:-1], size) + np.arange(total[-1])]
        fit = np.flatnonzero(out)
        steps = np.arange(int(want[fit].sum() - len(fit))) - np.repeat(np.cumsum(want[fit] - 1) - (want[fit] - 1), want[fit] - 1)
        differ = got[np.repeat(first[fit] + 1, want[fit] - 1) + steps] != data[np.repeat(at[docs[fit]], want[fit] - 1) + steps]
        out[fit] = got[first[fit]] == SPACE
        out[np.repeat(fit, want[fit] - 1)[differ]] = False
        return out

    def step(self, key: np.ndarray) -> np.ndarray:
        """The node that each (node, code point) leads to, or 0."""
        place = _slot(key, len(self.step_key), 0)
        state = np.where(self.step_key[place] == key, self.step_node[place], 0)
        missed = np.flatnonzero(state == 0)
        place = _slot(key[missed], len(self.step_key), 1)
        state[missed] = np.where(self.step_key[place] == key[missed], self.step_node[place], 0)
        return state


def _slot(key: np.ndarray, size: int, which: int) -> np.ndarray:
    factor = np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[which])
    return ((key.view(np.uint64) * factor) >> np.uint64(64 - size.bit_length() + 1)).view(np.int64)


def _slots(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key in its first or second slot, so that two looks find it (cuckoo hashing)."""
    size = 1 << int(len(key) * 8).bit_length()
    both = np.stack([_slot(key, size, 0), _slot(key, size, 1)], 1).tolist()
    owner: dict[int, int] = {}
    for i in range(len(key)):
        j, side = i, 0
        for _ in range(500):
            slot = both[j][side]
            j, owner[slot] = owner.get(slot, -1), j
            if j < 0:
                break
            side = 1 - both[j].index(slot) if both[j][0] != both[j][1] else 0
        else:
            raise ValueError("no place for a step; enlarge the table")
    keys, nodes = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    for slot, i in owner.items():
        keys[slot], nodes[slot] = key[i], node[i]
    return keys, nodes


@dataclass
class Lattice:
    """Nodes of all distinct chunks after one another (a chunk of n characters has n + 1); edges in
    order of what is left of the chunk, then of their start, the longest first.  `upto` sums a node's
    edge probabilities."""

    source: np.ndarray
    begin: np.ndarray  # by node: its first edge
    stop: np.ndarray  # by node: the edge after its last
    to: np.ndarray
    piece: np.ndarray  # -1: the character's bytes
    log_cond: np.ndarray
    upto: np.ndarray
    point: np.ndarray  # by node: its character, 0 at a chunk's end
    last: np.ndarray  # by node: whether it is a chunk's end

    @classmethod
    def build(cls, points: np.ndarray, size: np.ndarray, v: Vocabulary) -> Lattice:
        """points: the characters of all chunks; size: of each chunk."""
        n_chunks, n = len(size), len(points)
        chunk = np.repeat(np.arange(n_chunks), size)
        stop = np.cumsum(size)[chunk]
        node_of = np.arange(n) + chunk
        starts, lengths, pieces = [], [], []
        at, state = np.arange(n), v.first[points]
        alone = np.zeros(n, bool)
        for length in range(1, 1 << 10):
            hit = state > 0
            at, state = at[hit], state[hit]
            if not len(at):
                break
            own = v.piece[state]
            full = own >= 0
            starts.append(at[full])
            lengths.append(np.full(int(full.sum()), length, np.int64))
            pieces.append(own[full])
            if length == 1:
                alone[at[full]] = True
            more = at + length < stop[at]
            at, state = at[more], state[more].astype(np.int64)
            state = v.step(state << 21 | points[at + length])
        spelled = np.flatnonzero(~alone)
        starts.append(spelled)
        lengths.append(np.ones(len(spelled), np.int64))
        pieces.append(np.full(len(spelled), -1, np.int32))
        start, length, piece = (np.concatenate(x) for x in (starts, lengths, pieces))
        n_bytes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        log_prob = np.where(piece >= 0, v.log_prob[piece], v.byte_log_prob * n_bytes[start])
        # Backward sums, all chunks together, by the number of characters that are left.
        left = (stop - np.arange(n))[start]
        order = np.argsort((left * (n + 1) + start) * 1024 + (1023 - np.minimum(length, 1023)))
        start, length, piece, log_prob, left = start[order], length[order], piece[order], log_prob[order], left[order]
        source, to = node_of[start], node_of[start] + length
        beta = np.zeros(n + n_chunks)
        value = np.empty(len(start))
        bounds = np.searchsorted(left, np.arange(1, (left[-1] if len(left) else 0) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            x = log_prob[a:b] + beta[to[a:b]]
            heads = np.flatnonzero(np.concatenate([[True], source[a + 1 : b] != source[a : b - 1]]))
            top = np.maximum.reduceat(x, heads)
            times = np.diff(np.concatenate([heads, [b - a]]))
            total = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, times)), heads))
            beta[source[a + heads]] = total
            value[a:b] = x - np.repeat(total, times)
        begin, stop_ = np.zeros(n + n_chunks, np.int64), np.zeros(n + n_chunks, np.int64)
        heads = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]])) if len(source) else np.zeros(0, np.int64)
        begin[source[heads]], stop_[source[heads]] = heads, np.concatenate([heads[1:], [len(source)]])
        running = np.concatenate([[0.0], np.cumsum(np.exp(value))])
        point = np.zeros(n + n_chunks, np.int64)
        point[node_of] = points
        last = np.zeros(n + n_chunks, bool)
        last[np.cumsum(size) + np.arange(n_chunks)] = True
        return cls(source, begin, stop_, to, piece, value, running[1:] - running[begin[source]], point, last)


def _uniform(key: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """In (0, 1), from a row's key, a place and what the number is for."""
    h = ts.mix(key ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


@dataclass
class Path:
    """Decisions of many texts, sorted by text, then place: the edge taken at each."""

    doc: np.ndarray
    place: np.ndarray  # of the node in its text
    edge: np.ndarray


class Texts:
    """The texts of a slice (each with a space before it) as chunks of one shared lattice."""

    def __init__(self, texts: list[str], keys: np.ndarray, v: Vocabulary):
        self.v, self.keys, self.n = v, keys, len(texts)
        points = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.length = np.array([len(t) + 1 for t in texts], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        new = points == SPACE
        new[1:] &= points[:-1] != SPACE
        new |= points == 10
        new[1:] |= points[:-1] == 10
        new[self.offset[:-1]] = True
        self.start = np.flatnonzero(new)
        end = np.concatenate([self.start[1:], [len(points)]])
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(ts.mix(points.astype(np.uint64)) * ts._power("up", len(points))[: len(points)], out=total[1:])
        value = ts.mix((total[end] - total[self.start]) * ts._power("down", len(points) + 1)[self.start] + (end - self.start).astype(np.uint64))
        _, one, which = np.unique(value, return_index=True, return_inverse=True)
        size = (end - self.start)[one]
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.lattice = Lattice.build(points[np.repeat(self.start[one], size) + inner], size, v)
        self.node = (np.cumsum(size + 1) - (size + 1))[which]  # by chunk: its first node
        self.chunk_doc = np.repeat(np.arange(self.n), np.diff(np.searchsorted(self.start, self.offset)))

    def complete(self, chunk: np.ndarray, node: np.ndarray, salt: int) -> Path:
        """From each (chunk, node), the rest of the chunk, drawn from the conditional probabilities."""
        x = self.lattice
        docs, places, edges = [], [], []
        key, origin = self.keys[self.chunk_doc], self.offset[self.chunk_doc]
        live = ~x.last[node]
        chunk, node = chunk[live], node[live]
        while len(chunk):
            place = self.start[chunk] + node - self.node[chunk] - origin[chunk]
            u = _uniform(key[chunk], place, salt)
            edge, stop = x.begin[node], x.stop[node] - 1
            on = np.flatnonzero((u > x.upto[edge]) & (edge < stop))
            while len(on):
                edge[on] += 1
                on = on[(u[on] > x.upto[edge[on]]) & (edge[on] < stop[on])]
            docs.append(self.chunk_doc[chunk])
            places.append(place)
            edges.append(edge)
            node = x.to[edge]
            live = ~x.last[node]
            chunk, node = chunk[live], node[live]
        doc, place, edge = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (docs, places, edges))
        order = np.argsort(self.offset[doc] + place, kind="stable")
        return Path(doc[order], place[order], edge[order])

    def siblings(self, path: Path, top: np.ndarray, above: np.ndarray, salt: int, keep: int) -> tuple:
        """The best children that each text's path passed by: (doc, bound, place, edge), `keep` a text.

        top: the maximum that the path has; above: log probability of what comes before the path."""
        x = self.lattice
        own = x.log_cond[path.edge]
        before = np.cumsum(own) - own
        head = np.flatnonzero(np.concatenate([[True], path.doc[1:] != path.doc[:-1]])) if len(path.doc) else np.zeros(0, np.int64)
        before = before - np.repeat(before[head], np.diff(np.concatenate([head, [len(path.doc)]]))) + above[path.doc]
        worst = np.full(self.n, np.inf)
        for reach in (8.0, None):
            # A bound is at most NEAR above its child's log probability: first a few decisions give
            # each text `keep` bounds, then only children that could still beat the least are drawn.
            least = above - reach if reach else np.where(worst < np.inf, worst, -np.inf) - NEAR
            rows = np.flatnonzero(before >= least[path.doc])
            node = x.source[path.edge[rows]]
            times = x.stop[node] - x.begin[node]
            row = np.repeat(np.arange(len(rows)), times)
            edge = np.repeat(x.begin[node], times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            row = rows[row]
            doc, at = path.doc[row], before[row] + x.log_cond[edge]
            other = (edge != path.edge[row]) & (at >= least[doc])
            row, edge, doc, at = row[other], edge[other], doc[other], at[other]
            # A Gumbel of location `at` cut off below `top`: -log(e^-top + e^-at E), E exponential.
            e = -np.log(_uniform(self.keys[doc] + x.piece[edge].astype(np.uint64) * np.uint64(0xD1342543DE82EF95), path.place[row], salt))
            loose = at - np.log(e)
            if not reach:
                may = loose >= np.where(worst < np.inf, worst, -np.inf)[doc]
                row, edge, doc, loose = row[may], edge[may], doc[may], loose[may]
            bound = -np.logaddexp(-top[doc], -loose)
            order = np.lexsort((edge, -bound, doc))
            nth = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
            best = order[nth < keep]
            worst = np.full(self.n, np.inf)
            np.minimum.at(worst, doc[best], bound[best])
            worst[np.bincount(doc[best], minlength=self.n) < keep] = np.inf
        return doc[best], bound[best], path.place[row[best]], edge[best]

    def sample(self, k: int) -> Iterator[tuple]:
        """For each sample: texts that have it, log probability, perturbed score, and their paths."""
        x, docs = self.lattice, np.arange(self.n)
        top = -np.log(-np.log(_uniform(self.keys, np.zeros(self.n), 1)))
        chunks = np.arange(len(self.start))
        path = self.complete(chunks, self.node.copy(), 2)
        zero = np.zeros(self.n)
        queue = self.siblings(path, top, zero, 3, k)
        made = [(docs, top, path)]
        for nth in range(1, k + 1):
            doc, bound, place, edge, parent = (*queue, np.zeros(len(queue[0]), np.int64)) if nth == 1 else queue
            order = np.lexsort((parent, edge, place, -bound, doc))
            doc, bound, place, edge, parent = (a[order] for a in (doc, bound, place, edge, parent))
            first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
            if nth == k or not len(doc):
                made.append((doc[first], bound[first], None))
                break
            d, t, p, e, who = (a[first] for a in (doc, bound, place, edge, parent))
            # The parent's decisions before the place, the child taken, then the rest drawn anew.
            own = np.full(self.n, -1)
            own[d] = np.arange(len(d))
            kept = []
            for m, (_, _, earlier) in enumerate(made):
                mine = own[earlier.doc]
                ok = (mine >= 0) & (who[mine] == m) & (earlier.place < p[mine])
                kept.append((earlier.doc[ok], earlier.place[ok], earlier.edge[ok]))
            prefix = Path(*(np.concatenate([q[i] for q in kept]) for i in range(3)))
            chunk = np.searchsorted(self.start, self.offset[d] + p, "right") - 1
            later = np.flatnonzero((own[self.chunk_doc] >= 0) & (self.start > self.offset[self.chunk_doc] + np.where(own[self.chunk_doc] >= 0, p[own[self.chunk_doc]], 0)))
            rest = self.complete(np.concatenate([chunk, later]), np.concatenate([x.to[e], self.node[later]]), 2 + 2 * nth)
            above = np.zeros(self.n)
            np.add.at(above, prefix.doc, x.log_cond[prefix.edge])
            above[d] += x.log_cond[e]
            bounds = np.full(self.n, np.inf)
            bounds[d] = t
            fresh = self.siblings(rest, bounds, above, 3 + 2 * nth, k)
            whole = Path(*(np.concatenate([getattr(prefix, f), y, getattr(rest, f)]) for f, y in (("doc", d), ("place", p), ("edge", e))))
            order = np.argsort(self.offset[whole.doc] + whole.place, kind="stable")
            made.append((d, t, Path(whole.doc[order], whole.place[order], whole.edge[order])))
            queue = tuple(np.concatenate([a[~first], b]) for a, b in zip((doc, bound, place, edge, parent), (*fresh, np.full(len(fresh[0]), len(made) - 1)), strict=True))
        threshold = np.full(self.n, -np.inf)
        if made[-1][2] is None:
            threshold[made[-1][0]] = np.round(made[-1][1], 9)
        for d, t, path in made:
            if path is None:
                continue
            log_prob = np.zeros(self.n)
            np.add.at(log_prob, path.doc, x.log_cond[path.edge])
            # Sums depend on a slice's other texts in their last digits.
            log_prob, t = np.round(log_prob, 9), np.round(t, 9)
            with np.errstate(over="ignore"):
                inclusion = -np.expm1(-np.exp(log_prob[d] - threshold[d]))
            yield d, log_prob[d], t, inclusion, path

    def ids(self, path: Path) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a path, and how many each text has."""
        x, v = self.lattice, self.v
        piece = x.piece[path.edge].astype(np.int64)
        spelled = np.flatnonzero(piece < 0)
        if not len(spelled):
            return piece.astype(np.int32), np.bincount(path.doc, minlength=self.n)
        points = x.point[x.source[path.edge[spelled]]]
        kinds, which = np.unique(points, return_inverse=True)
        raw = [v.byte_id[list(chr(p).encode("utf-8", "surrogatepass"))] for p in kinds.tolist()]
        times = np.ones(len(piece), np.int64)
        times[spelled] = np.array([len(r) for r in raw])[which]
        out = np.repeat(piece, times)
        at = (np.cumsum(times) - times)[spelled]
        for j in range(4):
            has = np.array([len(r) > j for r in raw])[which]
            out[at[has] + j] = np.array([r[j] if len(r) > j else 0 for r in raw])[which[has]]
        return out.astype(np.int32), np.bincount(path.doc, weights=times, minlength=self.n).astype(np.int64)


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit key of each row from its id; null counts as an id of its own."""
    value = ids.cast(pa.int64()).fill_null(-(1 << 63) + 7).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return ts.mix(value + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def sample(docs: DataFrame, k: int = 2, seed: int = 11, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Up to k rows for each row of docs: doc_id and SAMPLES.

    `sample` counts from 0 in order of score, the perturbed log probability; `inclusion` is the
    probability that the segmentation is among the k, given the (k+1)th score (1 if there is none).
    A text with fewer than k segmentations gives all it has.  A null text counts as empty: its
    segmentations are those of the space that encoding puts before every text.  Rows of equal key
    and text give equal samples.  Other columns are left out; an empty table gives an empty result."""
    v = Vocabulary.load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "text", SLICE):
            texts = [t or "" for t in part.column(1).to_pylist()]
            data, at = ts.buffer_of(part.column(1))
            x = Texts(texts, row_keys(part.column(0), seed), v)
            for nth, (d, log_prob, score, inclusion, path) in enumerate(x.sample(k)):
                ids, n = x.ids(path)
                n = n[d]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(np.full(len(d), nth), pa.int32()), lists, pa.array(n), pa.array(log_prob), pa.array(score), pa.array(inclusion), pa.array(v.same(ids, n, data, at, d))], ["doc_id", "sample", "ids", "n_pieces", "log_prob", "score", "inclusion", "round_trip"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id long, {SAMPLES}")


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", out: str = "ids") -> DataFrame:
    """docs and `out`, the ids of the model's own (deterministic) segmentation; a null text counts as empty.

    The library reads U+2581 as a space, so such a character is encoded as its bytes apart."""
    kept = docs.drop(out)
    raw = open(model, "rb").read()
    loaded = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        if not loaded:
            loaded["p"] = sentencepiece.SentencePieceProcessor(model_proto=raw)
        p = loaded["p"]
        mark = [p.piece_to_id(f"<0x{b:02X}>") for b in "▁".encode()]
        for batch in batches:
            ids = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                parts = (t or "").split("▁")
                one = p.encode(parts[0])
                for more in parts[1:]:
                    # The library puts a space before every text; it is taken off again after a mark.
                    tail = p.encode("\n" + more)[2:] if more else []
                    one += mark + tail
                ids.append(one)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, out])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return kept.mapInArrow(run, f"{kinds}`{out}` array<int>")


def decode(rows: DataFrame, ids: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """rows and `out`, the text that `ids` stand for (null for null); the inverse of `sample` and `encode`."""
    kept, spelled = rows.drop(out), Vocabulary.load(model).spelled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else b"".join([spelled[i] for i in x]).decode("utf-8", "replace") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            texts = [t[1:] if t and t[0] == " " else t for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return kept.mapInArrow(run, f"{kinds}`{out}` string")
