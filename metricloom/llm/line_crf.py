"""Quality rules by labelling the lines of a text with a linear-chain conditional random field.

Each line with a word gets features of its own (length, symbols, capitals, repeats, ...); the
field scores a sequence of labels by features and by neighbouring labels; Viterbi decoding marks
each line as content or boilerplate.  A text stays if enough of its words are in content lines.

The weights are fitted here by gradient ascent on lines of at most `sample` labelled documents,
those of smallest hash; a line's training label is its document's quality.  Without labels of
both kinds PRIOR is used as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts

SAMPLE = 2000
CONTENT_SHARE = 0.5
WINDOW = 8

FEATURES = ("bias", "words", "word length", "symbols", "capitals", "digits", "exclamations", "bars", "same word again", "repeated line", "ends a sentence", "in repeated windows", "short")
#: Weights for boilerplate before any fitting.
PRIOR = (-2.0, 0.0, 0.0, 3.0, 3.0, 1.0, 3.0, 3.0, 3.0, 1.5, -0.5, 3.0, 0.2)

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"

_SYMBOL, _UPPER, _DIGIT, _STOP = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[[*b"#*$%&|<>"]] = True
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_STOP[[*b".!?:;"]] = True


@dataclass
class Lines:
    """Counts of each text, and the lines with a word: their text, words and features."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    doc: np.ndarray
    words: np.ndarray
    features: np.ndarray


def _again(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: equal to an earlier one of its text; equal to any other one of its text."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    same = np.zeros(len(d) + 1, bool)
    same[1:-1] = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    later, either = np.zeros(len(d), bool), np.zeros(len(d), bool)
    later[order], either[order] = same[:-1], same[:-1] | same[1:]
    return later, either


def read_lines(data: np.ndarray, at: np.ndarray) -> Lines:
    words = ts.Words(data, at, ts.NON_SPACE)
    n_docs = len(at) - 1
    begin, end, line_doc = ts.line_bounds(data, at)
    total = lambda flag: np.concatenate([[0], np.cumsum(flag)])
    of_line = np.searchsorted(end, words.start, "right")
    n_line = np.bincount(of_line, minlength=len(end))
    full = n_line > 0
    repeated = np.zeros(len(end), bool)
    repeated[full], _ = _again(line_doc[full], ts.span_hash(data, begin[full], end[full]))
    windows = ts.window_hash(words.hash, WINDOW)
    inside = np.flatnonzero(words.doc[: len(windows)] == words.doc[WINDOW - 1 : WINDOW - 1 + len(windows)]) if len(windows) else np.zeros(0, np.int64)
    _, twice = _again(words.doc[inside], windows[inside])
    change = np.zeros(len(words.hash) + WINDOW + 1, np.int64)
    np.add.at(change, inside[twice], 1)
    np.add.at(change, inside[twice] + WINDOW, -1)
    covered = np.cumsum(change)[: len(words.hash)] > 0
    next_same = np.zeros(len(words.hash), bool)
    next_same[1:] = (words.hash[1:] == words.hash[:-1]) & (of_line[1:] == of_line[:-1])
    points = ts.code_points(data)
    count = {k: (lambda c: c[end] - c[begin])(total(f[data])) for k, f in (("symbols", _SYMBOL), ("capitals", _UPPER), ("digits", _DIGIT))}
    single = {k: (lambda c: c[end] - c[begin])(total(data == ord(k))) for k in "!|"}
    chars = (lambda c: c[end] - c[begin])(total(points & ts.NON_SPACE[data]))
    w = np.maximum(n_line, 1)
    by_word = lambda flag: np.bincount(of_line, weights=flag, minlength=len(end)) / w
    last = np.zeros(len(end), np.int64)
    last[of_line] = words.end - 1  # the last word of a line is written last
    closes = _STOP[data[last]] if len(data) else np.zeros(len(end), bool)
    columns = [np.ones(len(end)), np.minimum(np.log1p(n_line) / 3, 3), np.minimum(chars / w / 10, 3), *(np.minimum(x, 3.0) for x in (count["symbols"] / w, count["capitals"] / np.maximum(chars, 1), count["digits"] / np.maximum(chars, 1), single["!"] / w, single["|"] / w, by_word(next_same))), repeated, closes, by_word(covered), n_line < 3]
    features = np.stack([np.asarray(c, np.float64)[full] for c in columns], 1)
    return Lines(words.count.astype(np.int64), ts.per_text(points & ts.NON_SPACE[data], at), ts.per_text(_SYMBOL[data], at), np.bincount(line_doc[repeated], minlength=n_docs), np.bincount(words.doc[covered], minlength=n_docs), line_doc[full], n_line[full], features)


class Chain:
    """The field: weights of features for boilerplate (content has 0), `follow[from, to]` and `first`."""

    def __init__(self, weights=PRIOR, follow=((0.5, -0.5), (-0.5, 0.5)), first=(0.0, 0.0)):
        self.weights, self.follow, self.first = np.array(weights, float), np.array(follow, float), np.array(first, float)

    def _steps(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines of a text stand together: where each text's lines begin, longest text first, and how many it has."""
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([begin, [len(doc)]]))
        order = np.argsort(-n, kind="stable")
        return begin[order], n[order]

    def viterbi(self, features: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """1 for each line that the best sequence of its text calls boilerplate; ties go to content."""
        label = np.zeros(len(doc), np.int8)
        if not len(doc):
            return label
        score = features @ self.weights
        begin, n = self._steps(doc)
        live = np.searchsorted(-n, -np.arange(n[0]), "left")  # texts with more than t lines
        best = np.tile(self.first, (len(n), 1)) + np.stack([np.zeros(len(n)), score[begin]], 1)
        back = np.zeros((len(doc), 2), np.int8)
        for t in range(1, n[0]):
            k = live[t]
            at = begin[:k] + t
            ways = best[:k, :, None] + self.follow[None]
            back[at] = ways[:, 1] > ways[:, 0]
            best[:k] = ways.max(1)
            best[:k, 1] += score[at]
        now = (best[:, 1] > best[:, 0]).astype(np.int8)
        for t in range(n[0] - 1, -1, -1):
            k = live[t]
            at = begin[:k] + t
            label[at] = now[:k]
            now[:k] = back[at, now[:k]]
        return label

    def fit(self, features: np.ndarray, doc: np.ndarray, label: np.ndarray, rounds: int = 80, rate: float = 0.15, shrink: float = 1e-3) -> Chain:
        """Gradient ascent (Adam) on the mean log-likelihood of the label sequences."""
        begin, n = self._steps(doc)
        live = np.searchsorted(-n, -np.arange(n[0]), "left")
        lines, y = len(doc), label.astype(int)
        follows = np.zeros((2, 2))
        inner = np.flatnonzero(doc[1:] == doc[:-1])
        np.add.at(follows, (y[inner], y[inner + 1]), 1)
        starts = np.bincount(y[begin], minlength=2)
        moment = [np.zeros(len(self.weights) + 6), np.zeros(len(self.weights) + 6)]
        lse = lambda a, b: np.logaddexp(a, b)
        for step in range(1, rounds + 1):
            emit = np.stack([np.zeros(lines), features @ self.weights], 1)
            ahead, behind = np.zeros((lines, 2)), np.zeros((lines, 2))
            ahead[begin] = self.first + emit[begin]
            for t in range(1, n[0]):
                at = begin[: live[t]] + t
                for j in (0, 1):
                    ahead[at, j] = lse(ahead[at - 1, 0] + self.follow[0, j], ahead[at - 1, 1] + self.follow[1, j]) + emit[at, j]
            for t in range(n[0] - 2, -1, -1):
                at = begin[: live[t + 1]] + t
                for i in (0, 1):
                    behind[at, i] = lse(self.follow[i, 0] + emit[at + 1, 0] + behind[at + 1, 0], self.follow[i, 1] + emit[at + 1, 1] + behind[at + 1, 1])
            z = lse(ahead[:, 0] + behind[:, 0], ahead[:, 1] + behind[:, 1])
            p = np.exp(ahead + behind - z[:, None])
            pair = np.array([[np.exp(ahead[inner, i] + self.follow[i, j] + emit[inner + 1, j] + behind[inner + 1, j] - z[inner]).sum() for j in (0, 1)] for i in (0, 1)])
            slope = np.concatenate([features.T @ (y - p[:, 1]), (follows - pair).ravel(), starts - p[begin].sum(0)]) / lines
            theta = np.concatenate([self.weights, self.follow.ravel(), self.first])
            slope -= shrink * theta
            moment[0] = 0.9 * moment[0] + 0.1 * slope
            moment[1] = 0.99 * moment[1] + 0.01 * slope**2
            theta = theta + rate * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-9)
            k = len(self.weights)
            self.weights, self.follow, self.first = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :]
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """A field fitted on the whole texts of at most `sample` labelled documents, those of least hash of doc_id
    (bounded, so they are read by the driver); of rows that share a doc_id or a label, any may be among them,
    but the same ones each time."""
    chosen = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("text")).limit(sample).toPandas()
    if rows.empty or rows.quality.nunique() < 2:
        return Chain()
    data, at = ts.buffer_of(pa.array(rows.text))
    lines = read_lines(data, at)
    return Chain().fit(lines.features, lines.doc, (rows.quality.to_numpy()[lines.doc] == 0))


def judge(docs: DataFrame, chain: Chain, share: float = CONTENT_SHARE) -> DataFrame:
    """The columns of docs and those in COLUMNS (an input column of such a name is replaced).

    A null or empty text, or one of white space, has no words; it fails the base rules and isn't
    kept.  Every row is judged by itself: equal rows give equal rows, an empty table an empty one."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "text"):
            x = read_lines(*ts.buffer_of(part.column(part.schema.get_field_index("text"))))
            content = chain.viterbi(x.features, x.doc) == 0
            of_words = np.bincount(x.doc[content], weights=x.words[content], minlength=part.num_rows) / np.maximum(x.n_words, 1)
            failed = (x.n_words < 20) | (100 * x.n_repeat_words > 30 * x.n_words)
            own = [x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, failed, ~failed & (of_words >= share), of_words]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c) for c in own)], [*part.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, {COLUMNS}")
