"""N-gram Jaccard join: documents whose sets of 5-word shingles have similarity NUM / DEN or more.

Documents of equal sets are one class, led by its smallest doc_id.  Classes are joined exactly as
set_join.py says, which uses work done for one set for similar ones: posting lists are skipped by
size and place, and in long lists answers are derived from the leader's.  A member linked to its
leader is connected to all others that are; only members outside the leader's component are looked
at again.  component_id comes from components of the links (components.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import set_join
from . import textscan as ts
from .components import components
from .frequency import Survey, shard_bits, survey, volume
from .storage import cut

NUM, DEN, WORDS = 3, 4, 5
BITS = 27
FLUSH = 1 << 17  # postings that a task holds
SENT = 2_000_000  # documents whose ids are sent to all tasks; with more, they are joined
NULL_ID = -(1 << 63)


def _sets(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle) sorted by text, then each text's size and class."""
    doc, value = ts.shingles(ts.Words(ts.LOWER[data], at, ts.NON_SPACE), words)
    n_docs = len(at) - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    n = np.diff(first)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ts.mix(value ^ np.uint64(0x5851F42D4C957F2D)))])
    return doc, value, n, ts.mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))


ROW = np.dtype([("id", "<u8"), ("doc", "<i8"), ("n", "<u4")])


def _scan(docs: DataFrame, sent: Broadcast[Survey], cuts: int, words: int, num: int, den: int) -> DataFrame:
    """A row for each document (doc, id, n; a null) and one for each pair of classes to compare (a, b, led)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lists, rows, held = sent.value, [], [], 0

        def flush():
            row = np.concatenate(rows)
            row = row[np.argsort(row["id"])]
            every = set_join.distinct(np.concatenate(lists))
            return pa.RecordBatch.from_arrays(set_join.both_packed(set_join.packed(row, row["id"], cuts), set_join.packed(every, every["word"], cuts)), ["shard", "rows", "postings"])

        for part in ts.slices(batches, "text"):
            doc, value, n, ids = _sets(*ts.buffer_of(part.column(1)), words)
            row = np.empty(part.num_rows, ROW)
            row["id"], row["doc"], row["n"] = ids, part.column(0).to_numpy(zero_copy_only=False), n
            rows.append(row)
            lists.append(set_join.postings(doc, value, n, ids, None, known, num, den))
            held += len(lists[-1])
            if held >= FLUSH:
                yield flush()
                lists, rows, held = [], [], 0
        if rows:
            yield flush()

    def find(table: pa.Table) -> pa.Table:
        row = np.concatenate([set_join.from_bytes(b, ROW) for b in set_join.blobs(table, "rows")])
        pairs, led = set_join.candidates(np.concatenate([set_join.from_bytes(b, set_join.posting(4)) for b in set_join.blobs(table, "postings")]), num, den)
        both = np.concatenate([pairs, led])
        one = pa.table({"doc": row["doc"], "id": row["id"].view(np.int64), "n": row["n"].astype(np.int64)})
        two = pa.table({"a": both[:, 0], "b": both[:, 1], "led": np.arange(len(both)) >= len(pairs)})
        return pa.concat_tables([one, two], promote_options="default")

    packed = docs.select("doc", "text").mapInArrow(gather, "shard int, rows binary, postings binary")
    return packed.groupBy("shard").applyInArrow(find, "doc long, id long, n long, a long, b long, led boolean")


def link(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """(rows: doc, id, n) of every document, and links (a, b) between doc_ids of class leaders, enough
    of them that components are right: pairs within a long list whose sets are connected through its
    leader are left out.  docs: doc (not null), text."""
    size = volume(docs)
    known = survey(docs.select("text"), lambda data, at: ts.shingles(ts.Words(ts.LOWER[data], at, ts.NON_SPACE), words)[1], size // 6, BITS)
    sent = docs.sparkSession.sparkContext.broadcast(known)
    del known
    scanned = cut(_scan(docs, sent, shard_bits(size // 15), words, num, den))
    sent.destroy()
    rows = scanned.where("a is null").select("doc", "id", "n")
    found = cut(scanned.where("a is not null").groupBy("a", "b").agg(F.max("led").alias("led")))
    wanted = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    lead = cut(rows.where("n > 0").groupBy("id").agg(F.min("doc").alias("doc"), F.first("n").alias("n")).join(wanted, "id"))
    met = set_join.verify(found, _shingles(docs, lead, words), num, den)
    links = met.where("linked").select("a", "b")
    if met.where("led and not linked").isEmpty():
        return rows, links
    group = components(links)
    part = lambda c: group.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    led = met.where("led").join(part("a"), "a", "left").join(part("b"), "b", "left").withColumns({"part": F.coalesce("a_part", "a"), "leader_part": F.coalesce("b_part", "b")})
    return rows, links.unionAll(set_join.unsettled(led.withColumn("out", F.col("part") != F.col("leader_part")), num, den))


def _shingles(docs: DataFrame, lead: DataFrame, words: int) -> DataFrame:
    """id, key (its doc), n and tokens of the classes in lead, read again from their leading documents."""
    ids = lead.select("doc", "id", "n")
    found = docs.join(F.broadcast(ids) if lead.count() <= SENT else ids, "doc").select("doc", "id", "n", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "text"):
            doc, value, n, ids = _sets(*ts.buffer_of(part.column(3)), words)
            own = np.flatnonzero(ids == part.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            first = np.searchsorted(doc, np.arange(len(n) + 1))
            size = n[own]
            inner = np.repeat(first[own], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(value[inner].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(own)), part.column(0).take(pa.array(own)), part.column(2).take(pa.array(own)), lists], ["id", "key", "n", "tokens"])

    return cut(found.mapInArrow(run, "id long, key long, n long, tokens array<long>").dropDuplicates(["id"]))


def join(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included).

    A-Z are lower-cased; words are separated by white space; a text of fewer than `words` words has
    one shingle, all of it; a null or empty text, or one of white space, has none and is linked
    with nothing.  Equal rows give equal rows; rows of one doc_id and different texts are one node.  A
    null doc_id is a node before all others.  Other columns are left out; an empty table gives an empty result."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    rows, links = link(keyed, words, num, den)
    lead = rows.where("n > 0").groupBy("id").agg(F.min("doc").alias("lead"), F.count(F.lit(1)).alias("copies"))
    group = components(links.unionAll(rows.where("n > 0").groupBy("doc").agg(F.min("id").alias("p"), F.max("id").alias("q")).where("p < q").select("doc", "p", "q").join(lead.select(F.col("id").alias("q"), "lead"), "q").select(F.col("doc").alias("a"), F.col("lead").alias("b"))))
    # Classes of one document, or led by a document that no link names, are their own component.
    named = lead.join(group.withColumnRenamed("node", "lead"), "lead", "left").where("copies > 1 or component is not null").select("id", F.coalesce("component", "lead").alias("component"))
    met = rows.join(named, "id", "left")
    out = F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc"))
    plain = lambda c: F.nullif(c, F.lit(NULL_ID))
    return met.select(plain(F.col("doc")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), plain(out).alias("component_id"))
