"""Tier C without a key: the log is cut by place into segments, which run side by side.

What a segment does depends on the state that the lines before it leave, which nobody knows at first.
So all segments run once as if nothing had come before, and note their state after a few lines and at
the end.  Then each one's first lines run again, from the end of the one before: where the state comes
to equal the noted one, all that follows is the same, the end too.  Segments whose state does not are
run again as a whole.  Once each has begun with the end of the one before, the states are those of a run
line by line, to the bit.

Programs that overwrite what they read, or let it fade like a running average, are through after the
first lines.  Others, such as those that count lines and read the count, are not (`None`): their
meaning is sequential.  Only metrics without keys can be read, so a state is a few values.  Lines with
the same seq are taken by filename and text, so that every run has one order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .interpreter import Machine

LINES = 1 << 16  # of a segment, about
SEGMENTS = 4096  # at most; a longer log has longer ones
FILES = 200  # partitions up to which Spark writes a shuffle without holding rows (spark.shuffle.sort.bypassMergeThreshold)
LEAST = 1 << 13  # lines of a segment where the log has fewer than cores would take
NOTED = (64, 512, 4096)  # lines after which a segment's state is noted
ROUNDS = 3
STATES = 1 << 24  # characters of all segments' states; beyond, the log isn't cut
FIRST = -(1 << 63)  # for a null seq
NOTES = "segment int, place int, seq bigint, state string"  # place: lines so far; negative at the end


def state_of(machine: Machine) -> str:
    """The cells as a text: equal texts are equal states (-0.0 and 0.0 differ, NaNs do not)."""
    return json.dumps(sorted((metric, value) for (metric, _), value in machine.cells.items()))


def restore(machine: Machine, state: str) -> None:
    machine.cells = {(metric, ()): value for metric, value in json.loads(state)}


def cut(lines: DataFrame) -> list[int]:
    """The seqs at which segments after the first begin."""
    n = lines.count()
    parts = min(SEGMENTS, max(-(-n // LINES), min(lines.sparkSession.sparkContext.defaultParallelism, n // LEAST)))
    if parts < 2:
        return []
    at = lines.agg(F.percentile_approx("seq", [k / parts for k in range(1, parts)], 10 * parts)).first()[0]
    return sorted(set(at or []))


def dealt(lines: DataFrame, cuts: list[int], upto: dict[int, int | None] | None = None) -> DataFrame:
    """segment, seq, filename, line: segments whole and in order, several in a partition where they are many.

    upto: only these segments, each up to a seq (None: to its end)."""
    rows = lines.select("seq", "filename", "line")
    if cuts:
        from pyspark.ml.feature import Bucketizer  # a binary search

        inf = float("inf")
        splits = sorted({float(c) for c in cuts})
        placed = rows.withColumn("_at", F.coalesce(F.col("seq").cast("double"), F.lit(-inf)))
        rows = Bucketizer(splits=[-inf, *splits, inf], inputCol="_at", outputCol="_n").transform(placed).select(F.col("_n").cast("int").alias("segment"), "seq", "filename", "line")
    else:
        rows = rows.select(F.lit(0).alias("segment"), "seq", "filename", "line")
    if upto is not None:
        from ..store import local

        wanted = F.broadcast(local(rows.sparkSession, sorted(upto.items()), "_s int, _upto bigint"))
        rows = rows.join(wanted, (F.col("segment") == F.col("_s")) & (F.col("_upto").isNull() | F.col("seq").isNull() | (F.col("seq") <= F.col("_upto")))).drop("_s", "_upto")
    n = len(cuts) + 1
    parts = min(n, max(FILES, n // 8))
    return rows.repartitionById(parts, F.col("segment") % F.lit(parts)).sortWithinPartitions("segment", "seq", "filename", "line")


def walk(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ("segment", "seq", "filename", "line")) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _notes(make: Callable[[], Machine], begun: dict[int, str], known: dict[tuple[int, int], str] | None, longest: int):
    """Runs segments from their states: notes of all of them, or, against known notes, where the state
    first equals one (or, where it doesn't, the end).  A state that is too long is noted as null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, here, place, last, met, out = make(), None, 0, None, False, []

        def note(place: int, state: str) -> None:
            out.append((here, place, FIRST if last is None else last, state if len(state) <= longest else None))

        for segment, seq, filename, line in walk(batches):
            if segment != here:
                if here is not None and not met:
                    note(-place, state_of(machine))
                restore(machine, begun[segment])
                here, place, met = segment, 0, False
            place, last = place + 1, seq
            if met:
                continue
            machine.line(line or "", filename or "")
            if place in NOTED:
                state = state_of(machine)
                met = known is not None and known.get((segment, place)) == state
                if known is None or met:
                    note(place, state)
        if here is not None and not met:
            note(-place, state_of(machine))
        if out:
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["segment", "place", "seq", "state"])

    return run


def states(lines: DataFrame, cuts: list[int], make: Callable[[], Machine], first: str) -> dict[int, str] | None:
    """The state with which each segment begins, `first` that of the first; None if it takes too long
    to find out."""
    n = len(cuts) + 1
    actual = dict.fromkeys(range(n), first)
    if n == 1:
        return actual
    longest = STATES // (n * (len(NOTED) + 1))
    begun: dict[int, str] = {}  # of segments with lines: where the noted run began, or one that met it
    ends: dict[int, str] = {}
    known: dict[tuple[int, int], str] = {}
    upto: dict[int, int | None] = {}  # the last noted seq; None: the segment is short, its first lines are all

    def notes(segments: dict[int, int | None] | None, against: dict | None) -> list:
        own = {k: actual[k] for k in (range(n) if segments is None else segments)}
        return dealt(lines, cuts, segments).mapInArrow(_notes(make, own, against, longest), NOTES).collect()

    def whole(segments: list[int] | None) -> bool:
        for r in (found := notes(segments and dict.fromkeys(segments), None)):
            begun[r.segment] = actual[r.segment]
            if r.place < 0:
                ends[r.segment] = r.state
                if -r.place <= NOTED[-1]:
                    upto[r.segment] = None
            else:
                known[r.segment, r.place] = r.state
                if r.place == NOTED[-1]:
                    upto.setdefault(r.segment, r.seq)
        return all(r.state is not None for r in found)

    def forget(segment: int) -> None:
        for place in NOTED:
            known.pop((segment, place), None)

    def unsettled() -> list[int]:
        for k in range(1, n):
            actual[k] = ends.get(k - 1, actual[k - 1])
        return [k for k in ends if actual[k] != begun[k]]

    if not whole(None):
        return None
    for _ in range(ROUNDS):
        again = set(unsettled())
        if not again:
            return actual
        for r in notes({k: upto[k] for k in again}, known):
            if r.place < 0:
                if upto[r.segment] is not None:
                    continue
                if r.state is None:
                    return None
                ends[r.segment] = r.state  # of another run than the noted one
                forget(r.segment)
            begun[r.segment] = actual[r.segment]
            again.discard(r.segment)
        for k in again:
            forget(k)
        if again and not whole(sorted(again)):
            return None
    return None if unsettled() else actual
