"""Line dedup by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased); a line is removed if an earlier line, by
(doc_id, text, line number), has Jaccard similarity NUM / DEN or more with it.

1. Lines of equal sets are one class, known by a 64-bit hash of the set; only its first line can
   stay.  Classes are first merged within each task, so a line that stands in a third of all
   documents costs one row for each task.
2. Classes are joined exactly as set_join.py says: words ordered by rarity over the whole corpus,
   prefix, length and positional filters, whole sets verified.  In a dense posting list each class
   meets the first one it may be similar to; only if that one doesn't remove it, it meets all others
   that stand before it, in blocks that give the removed classes only.  So rows grow with a group of
   near copies, not with its square.
3. A class whose first line has an earlier similar class loses that line too.

A task holds FLUSH classes; a shard's postings grow no further, as there are more shards with more
text.  A text is held whole, at about 60 times its bytes, by the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import set_join
from . import textscan as ts
from .frequency import Survey, shard_bits, survey
from .storage import cut

NUM, DEN = 4, 5
SIGNS = 2
BITS = 27
NULL_ID = -(1 << 63)
FLUSH = 1 << 17  # classes that a task holds before it writes
SENT = 2_000_000  # classes whose ids are sent to all tasks; with more, they are joined


@dataclass
class LineSets:
    """Lines of a slice that have a word; `word` holds each line's distinct words, sorted by hash."""

    doc: np.ndarray
    number: np.ndarray
    id: np.ndarray
    n: np.ndarray
    first: np.ndarray
    word: np.ndarray
    of: np.ndarray

    @classmethod
    def read(cls, data: np.ndarray, at: np.ndarray) -> LineSets:
        words = ts.Words(ts.LOWER[data], at, ts.NON_SPACE)
        begin, end, doc = ts.line_bounds(data, at)
        line = np.repeat(np.arange(len(end)), np.diff(np.searchsorted(words.start, end), prepend=0))
        full = np.flatnonzero(np.bincount(line, minlength=len(end)))
        place = np.zeros(len(end), np.int64)
        place[full] = np.arange(len(full))
        of = place[line].astype(np.uint64)
        shift = np.uint64(max(1, int(len(full)).bit_length()))
        order = np.argsort((of << (np.uint64(64) - shift)) | (words.hash >> shift))
        of, word = of[order].astype(np.int64), words.hash[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (word[1:] != word[:-1])
        of, word = of[new], word[new]
        first = np.searchsorted(of, np.arange(len(full) + 1))
        n = np.diff(first)
        total = np.add.reduceat(ts.mix(word ^ np.uint64(0x5851F42D4C957F2D)), first[:-1]) if len(of) else np.zeros(0, np.uint64)
        number = np.arange(len(end)) - np.searchsorted(doc, doc)
        return cls(doc[full], number[full], ts.mix(total + n.astype(np.uint64)), n, first, word, of)


CLASS = np.dtype([("id", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("number", "<u4"), ("n", "<u4")])


def _firsts(x: np.ndarray) -> np.ndarray:
    """The first line of each class, sorted by class."""
    x = x[np.argsort(x["id"])]
    many = np.zeros(len(x), bool)
    many[1:] = x["id"][1:] == x["id"][:-1]
    many[:-1] |= many[1:]
    at = np.flatnonzero(many)
    own = x[at]
    x[at] = own[np.lexsort((own["number"], own["text"], own["doc"], own["id"]))]
    return x[np.concatenate([[True], x["id"][1:] != x["id"][:-1]])] if len(x) else x


KINDS = f"id long, doc long, text_hash long, number long, size long, a long, b long, {set_join.ENTRY}"


def _scan(docs: DataFrame, sent: Broadcast[Survey], low: int, shift: int, cuts: int, num: int, den: int) -> DataFrame:
    """A row for each class (id, its first line's doc, text_hash and number, and its size), one for each pair
    of classes to compare (a, b), and one for each entry of a dense list (set_join.ENTRY); the other
    columns are null.  A line's rank is its document's place above `low`, in steps of 2 ** shift."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lists, rows, held = sent.value, [], [], 0

        def flush():
            row, every = _firsts(np.concatenate(rows)), set_join.distinct(np.concatenate(lists))
            return pa.RecordBatch.from_arrays(set_join.both_packed(set_join.packed(row, row["id"], cuts), set_join.packed(every, every["word"], cuts)), ["shard", "rows", "postings"])

        for part in ts.slices(batches, "text"):
            x = LineSets.read(*ts.buffer_of(part.column(2)))
            if not len(x.id):
                continue
            row = np.empty(len(x.id), CLASS)
            row["id"], row["number"], row["n"] = x.id, x.number, x.n
            row["doc"] = part.column(0).to_numpy(zero_copy_only=False)[x.doc]
            row["text"] = part.column(1).to_numpy(zero_copy_only=False)[x.doc]
            # One line of each class is posted.
            _, own = np.unique(x.id, return_index=True)
            own.sort()
            new = np.full(len(x.n), -1)
            new[own] = np.arange(len(own))
            mine = new[x.of] >= 0
            rank = np.where(row["doc"][own] < low, 0, (row["doc"][own] - low).view(np.uint64) >> np.uint64(shift)).astype(np.int64)
            rows.append(_firsts(row))
            lists.append(set_join.postings(new[x.of[mine]], x.word[mine], x.n[own], x.id[own], rank, known, num, den, SIGNS))
            held += len(rows[-1])
            if held >= FLUSH:
                yield flush()
                lists, rows, held = [], [], 0
        if rows:
            yield flush()

    names = [c.split()[0] for c in KINDS.split(", ")]

    def find(table: pa.Table) -> pa.Table:
        row = _firsts(np.concatenate([set_join.from_bytes(b, CLASS) for b in set_join.blobs(table, "rows")]))
        pairs, entries = set_join.first_candidates(np.concatenate([set_join.from_bytes(b, set_join.posting(SIGNS)) for b in set_join.blobs(table, "postings")]), num, den)
        one = pa.table({"id": row["id"].view(np.int64), "doc": row["doc"], "text_hash": row["text"], "number": row["number"].astype(np.int64), "size": row["n"].astype(np.int64)})
        every = pa.concat_tables([one, pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}), pa.Table.from_batches([entries])], promote_options="default")
        return every.select(names)

    packed = docs.select("doc", "text_hash", "text").mapInArrow(gather, "shard int, rows binary, postings binary")
    return packed.groupBy("shard").applyInArrow(find, KINDS)


def similar_classes(docs: DataFrame, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """The classes (id, first line) and the lost ones (id): those that are similar to an earlier one.

    docs: doc, text_hash, text."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), *(f(F.when(F.col("doc") != NULL_ID, F.col("doc"))).alias(f.__name__) for f in (F.min, F.max))).first()
    size, low = total["bytes"] or 0, total["min"] or 0
    known = survey(docs.select("text"), lambda data, at: ts.Words(ts.LOWER[data], at, ts.NON_SPACE).hash, size // 6, BITS)
    sent = docs.sparkSession.sparkContext.broadcast(known)
    del known
    scanned = cut(_scan(docs, sent, low, max(0, ((total["max"] or 0) - low).bit_length() - 32), shard_bits(size // 8), num, den))
    sent.destroy()
    classes = scanned.where("id is not null").select("id", F.struct("doc", "text_hash", "number").alias("first"), F.col("size").alias("n"))
    found = cut(scanned.where("a is not null").select("a", "b").distinct())
    entries = scanned.where("word is not null").select(*(c.split()[0] for c in set_join.ENTRY.split(", ")))
    ids = found.select(F.explode(F.array("a", "b")).alias("id")).unionAll(entries.select(F.col("set").alias("id"))).distinct()
    sets = _sets(docs, cut(ids.join(classes, "id")))
    lost = cut(_removed(found, sets, num, den))
    if entries.isEmpty():
        return classes, lost
    open_ = entries.join(lost.select(F.col("id").alias("set"), F.lit(True).alias("gone")), "set", "left").withColumn("out", F.col("gone").isNull()).drop("gone")
    return classes, lost.unionAll(set_join.later(open_, sets, num, den)).distinct()


def _removed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """id of each class that is similar to one of an earlier first line, of the pairs (a, b)."""
    linked = set_join.verify(pairs.withColumn("led", F.lit(False)), sets, num, den).where("linked")
    return linked.select(F.greatest("a", "b")["id"].alias("id")).distinct()


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, key (first line, then id), n and tokens of the wanted classes, read again from their first lines."""
    at = wanted.groupBy("first.doc", "first.text_hash").agg(F.collect_list("id").alias("ids"))
    found = docs.join(F.broadcast(at) if wanted.count() <= SENT else at, ["doc", "text_hash"]).select("text", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "text"):
            x = LineSets.read(*ts.buffer_of(part.column(0)))
            ids = np.array([i for rows in part.column(1).to_pylist() for i in rows], np.int64).view(np.uint64)
            own = np.flatnonzero(np.isin(x.id, ids))
            _, one = np.unique(x.id[own], return_index=True)
            own = own[one]
            if len(own):
                n = x.n[own]
                inner = np.repeat(x.first[own], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(x.id[own].view(np.int64)), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(x.word[inner].view(np.int64)))], ["id", "n", "tokens"])

    key = wanted.select("id", F.struct("first.*", "id").alias("key"))
    return cut(found.mapInArrow(run, "id long, n long, tokens array<long>").dropDuplicates(["id"]).join(key, "id"))


def kept_lines(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc, text_hash and the numbers of the lines that stay, of the documents that keep a line with a word."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    classes, lost = similar_classes(keyed, num, den)
    return classes.join(lost, "id", "left_anti").groupBy("first.doc", "first.text_hash").agg(F.collect_list(F.col("first.number").cast("int")).alias("kept"))


def dedup(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs with the removed lines gone from `text`, and n_lines (with a word) and n_removed.

    Lines without a word are kept as they are, unless the text loses all its others; then the text
    is empty, but its row stays.  A null text stays null, with no lines.  Rows equal in doc_id and
    text are alike: what stays of one stays of all.  A null doc_id comes first.  Input columns
    named n_lines or n_removed are replaced; an empty table gives an empty result."""
    docs = docs.drop("n_lines", "n_removed")
    kept = kept_lines(docs, num, den).select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_text"), F.col("kept").alias("_kept"))
    rows = docs.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "_t": F.xxhash64("text")})
    met = rows.join(kept, (F.col("_d") == F.col("_doc")) & (F.col("_t") == F.col("_text")), "left").drop("_d", "_t", "_doc", "_text")
    lines = F.split("text", "\n", -1)
    full = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    some = F.coalesce("_kept", F.array().cast("array<int>"))
    stays = F.array_join(F.filter(lines, lambda line, i: ~full(line) | F.array_contains(some, i)), "\n")
    counted = met.withColumn("n_lines", F.coalesce(F.size(F.filter(lines, full)), F.lit(0)).cast("long"))
    counted = counted.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
    counted = counted.withColumn("n_removed", F.col("n_lines") - F.size(some))
    text = F.when(F.col("n_removed") == 0, F.col("text")).when(F.size(some) == 0, F.lit("")).otherwise(stays)
    return counted.withColumn("text", text).drop("_kept")
