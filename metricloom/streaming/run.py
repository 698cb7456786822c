"""Programs over streams of lines (filename, line, seq)."""

from __future__ import annotations

import hashlib
import signal
import time
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import Options, _compiled, op_stream, run
from ..lang.checker import compile_program
from ..lang.lexer import ProgramError
from ..plans.analysis import analyse
from ..sinks.text import push
from ..sources.lines import load_programs
from ..store import LoadError, check_kinds, gc, infos, local

KEPT = 3  # stores of former batches that stay in the folder

def counters(lines: DataFrame, programs: dict[str, str], options: Options | None = None) -> DataFrame:
    """program, name, labels and value of the counters of tier A programs, as a streaming aggregate
    (update or complete mode).  Increments only add up, so no order is kept and no line is late."""
    options = options or Options()
    compiled = _compiled(programs, options)
    wrong = [p.name for p in compiled if analyse(p).tier != "A"]
    if wrong:
        raise ValueError(f"not order-free: {', '.join(wrong)}")
    ops, _ = op_stream(lines, compiled, options)
    about = [(m.program, m.index, m.name) for p in compiled for m in infos(p)]
    names = F.broadcast(local(lines.sparkSession, about, "program string, metric int, name string"))
    value = F.coalesce(F.col("i").cast("double"), F.col("f"), F.lit(0.0))
    return ops.where("op in ('inc', 'fadd', 'touch')").join(names, ["program", "metric"]).groupBy("program", "name", "labels").agg(F.sum(value).alias("value"))


class Pusher:
    """Pushes a store to targets, (address, format), no more often than every `seconds`; give it to
    StoreStream as on_store.  A target that can't be reached is tried again next time, and counted."""

    def __init__(self, targets: list[tuple[str, Callable[[DataFrame], DataFrame]]], seconds: float = 60.0):
        self.targets, self.seconds, self.last, self.failures = targets, seconds, float("-inf"), 0

    def __call__(self, store: DataFrame, number: int) -> None:
        if time.monotonic() - self.last < self.seconds:
            return
        self.last = time.monotonic()
        for address, form in self.targets:
            try:
                push(form(store.where("kind <> 'text'")), address)
            except OSError:
                self.failures += 1


class StoreStream:
    """A store kept up to date batch by batch, for programs of any tier.

    After each batch the new store is written beside the old one, in `folder`/N with N the batch: a
    batch that is run again after a failure starts from the same store, so none is counted twice.
    The folder is any that Spark's file systems reach; stores older than the last KEPT are deleted.
    collect: seconds between garbage collections (0: after every batch; None: never).

    `counts` holds what the stream has done, by (name, program): batches, programs loaded, unloaded
    and not loaded for an error, and collections."""

    def __init__(self, spark: SparkSession, programs: dict[str, str], folder: str, options: Options | None = None, on_store: Callable[[DataFrame, int], None] | None = None, collect: float | None = None):
        self.spark, self.folder, self.options, self.on_store, self.collect = spark, folder.rstrip("/"), options or Options(), on_store, collect
        self.programs = _compiled(programs, self.options)
        self.marks = {name: _mark(text) for name, text in programs.items()}
        self.counts: Counter[tuple[str, str]] = Counter({("prog_loads_total", name): 1 for name in programs})
        self.collected, self.source, self.asked = float("-inf"), None, False
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = lambda *parts: hadoop.Path("/".join([self.folder, *parts]))
        self._files = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path())

    def reload(self, programs: dict[str, str]) -> list[str]:
        """Other programs from the next batch on: what is wrong with those that aren't taken.

        A program whose text is as before stays as it is.  A wrong one is left out, and its former
        version goes on; one that isn't among them any more ends."""
        before, kept, errors = {p.name: p for p in self.programs}, {}, []
        for name, text in programs.items():
            if self.marks.get(name) == _mark(text) and name in before:
                kept[name] = before[name]
                continue
            try:
                made = compile_program(text, name, self.options.max_pattern, self.options.max_depth)
                check_kinds([m for p in [*kept.values(), *(q for n, q in before.items() if n in programs and n not in kept and n != name), made] for m in infos(p)])
            except (ProgramError, LoadError) as why:
                errors += getattr(why, "errors", [str(why)])
                self.counts["prog_load_errors_total", name] += 1
                if name in before:
                    kept[name] = before[name]
                continue
            kept[name], self.marks[name] = made, _mark(text)
            self.counts["prog_loads_total", name] += 1
        for name in before.keys() - kept.keys():
            del self.marks[name]
            self.counts["prog_unloads_total", name] += 1
        self.programs = list(kept.values())
        return errors

    def follow(self, path: str, on: int | None = signal.SIGHUP) -> None:
        """Programs are read again from a file or folder before the batch after a signal (in the main
        thread only), or after `asked` is set."""
        self.source = path
        if on is not None:
            signal.signal(on, lambda *_: setattr(self, "asked", True))

    def done(self) -> list[int]:
        """Numbers of the batches whose store is whole."""
        found = (x.getPath().getName() for x in self._files.listStatus(self._path()))
        return sorted(int(n) for n in found if n.isdigit() and self._files.exists(self._path(n, "_SUCCESS")))

    def latest(self, before: int | None = None) -> DataFrame | None:
        done = [n for n in self.done() if before is None or n < before]
        return self.spark.read.parquet(f"{self.folder}/{done[-1]}") if done else None

    def step(self, batch: DataFrame, number: int) -> None:
        if self.asked and self.source:
            self.asked = False
            self.reload(load_programs(self.source))
        result = run(batch, self.programs, self.options, self.latest(number))
        store = result.store
        if self.collect is not None and time.monotonic() - self.collected >= self.collect:
            self.collected = time.monotonic()
            store = gc(store, self.options.clock())
            self.counts["collections_total", ""] += 1
        store.write.mode("overwrite").parquet(f"{self.folder}/{number}")
        self.counts["batches_total", ""] += 1
        for old in [n for n in self.done() if n < number][: -KEPT + 1 or None]:
            self._files.delete(self._path(str(old)), True)
        if self.on_store:
            self.on_store(self.latest(), number)

    def start(self, lines: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """every: a trigger interval ("250 milliseconds"); None: all that is there, then end."""
        writer = lines.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _mark(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
