"""Running programs over lines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .lang.checker import MAX_DEPTH, MAX_PATTERN, Program, compile_program
from .operators import segments
from .operators.folds import fold
from .operators.interpreter import Machine
from .operators.lower import lower
from .plans.analysis import Analysis, analyse
from .plans.ops import OP_FIELDS, OPS
from .store import STORE, MetricInfo, as_ops, check_kinds, declared_ops, dress, infos, local, visible

ERROR_METRIC = -1


@dataclass
class Options:
    """Settings of a run; times that programs would take from the clock are parameters."""

    year: int | None = None  # of layouts without one; None: that of `now`
    zone: str = "UTC"  # of layouts without one
    now: dt.datetime | None = None  # stamps ops without a time; None: when the run starts
    max_pattern: int = MAX_PATTERN
    max_depth: int = MAX_DEPTH
    tier: str | None = None  # "C" runs every program row by row

    def clock(self) -> dt.datetime:
        return self.now or dt.datetime.now(dt.UTC)


@dataclass
class Result:
    store: DataFrame
    errors: DataFrame  # program, errors
    ops: DataFrame
    metrics: list[MetricInfo]
    tiers: dict[str, str] = field(default_factory=dict)


def _compiled(programs: dict[str, str] | list[Program], options: Options) -> list[Program]:
    if isinstance(programs, dict):
        return [compile_program(text, name, options.max_pattern, options.max_depth) for name, text in programs.items()]
    return list(programs)


def _columns_ops(lines: DataFrame, programs: list[Program], options: Options, year: int) -> DataFrame:
    """Ops of all programs that need no state: one scan, one array for each line, one explode."""
    df, arrays, shared = lines.withColumn("now", F.lit(options.clock())), [], {}
    for k, p in enumerate(programs):
        df, ops, failed = lower(p, df, k, year, options.zone, shared)
        typed = ops.cast("array<struct<metric:int,labels:array<string>,op:string,i:bigint,f:double,s:string,ts:timestamp,ord:int>>")
        error = F.when(failed, F.array(F.struct(F.lit(ERROR_METRIC).alias("metric"), F.array().cast("array<string>").alias("labels"), F.lit("error").alias("op"), F.lit(1).cast("bigint").alias("i"), F.lit(None).cast("double").alias("f"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("timestamp").alias("ts"), F.lit(0).alias("ord")))).otherwise(F.array().cast(typed_name))
        arrays.append(F.transform(F.concat(typed, error), _tagged(p.name)))
    every = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
    return df.select("seq", F.explode(every).alias("o")).select(*(F.col("seq") if c == "seq" else F.col(f"o.{c}").alias(c) for c, _ in OP_FIELDS))


def _tagged(program: str):
    return lambda o: F.struct(F.lit(program).alias("program"), *(o[c].alias(c) for c in ("metric", "labels", "op", "i", "f", "s", "ts", "ord")))


typed_name = "array<struct<metric:int,labels:array<string>,op:string,i:bigint,f:double,s:string,ts:timestamp,ord:int>>"


def _machine_ops(lines: DataFrame, program: Program, found: Analysis, options: Options, year: int, seed: DataFrame | None) -> DataFrame:
    """Ops of a program with feedback.  Lines stream through in order: of as many partitions as the key
    deals them to, or of segments whose first state is known; else of one partition."""
    now, zone, tracked = options.clock().timestamp(), options.zone, found.read
    cell = ["metric", "labels", "i", "f", "s"]
    kinds = dict(OP_FIELDS)
    former = None
    if seed is not None:  # cells of a former store come before all lines
        former = seed.where((F.col("program") == program.name) & (F.col("op") == "set") & F.col("metric").isin([*tracked]))

    def make() -> Machine:
        return Machine(program, tracked, year, zone, now)

    begun = None
    if found.key is None and not lines.isStreaming and not any(m.keys for m in program.metrics if m.index in tracked):
        first = make()
        for r in former.collect() if former is not None else []:
            first.cells[r.metric, ()] = _value(r.i, r.f, r.s)
        cuts = segments.cut(lines)
        begun = segments.states(lines, cuts, make, segments.state_of(first)) if tracked else dict.fromkeys(range(len(cuts) + 1), "[]")
    if begun is not None:
        rows, columns = segments.dealt(lines, cuts), ("segment", "seq", "filename", "line")
    else:
        columns = ("seq", "filename", "line", *cell)
        kept = lines.select("seq", "filename", "line", *(F.lit(None).cast(kinds[c]).alias(c) for c in cell))
        if former is not None:  # dealt like the lines
            kept = kept.unionByName(former.select("seq", F.lit("").alias("filename"), F.lit(None).cast("string").alias("line"), *cell))
        if found.key is not None:
            x = found.key.pattern.regex.java()
            dealt = F.when(F.col("metric").isNotNull(), F.get("labels", F.lit(0))).when(F.col("line").rlike(x), F.regexp_extract("line", x, found.key.group)).otherwise(F.concat(F.lit("-"), F.pmod("seq", F.lit(1024)).cast("string")))
            rows = kept.withColumn("_key", dealt).repartition("_key").sortWithinPartitions("seq").drop("_key")
        else:
            rows = kept.repartition(1).sortWithinPartitions("seq")
    shape = to_arrow_schema(StructType.fromDDL(OPS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, here = make(), None
        for batch in batches:
            out = []
            for row in segments.walk([batch], columns):
                if begun is not None:
                    segment, seq, filename, line = row
                    if segment != here:
                        segments.restore(machine, begun[segment])
                        here = segment
                else:
                    seq, filename, line, metric, labels, i, f, s = row
                    if metric is not None:
                        machine.cells[metric, tuple(labels)] = _value(i, f, s)
                        continue
                ops, error = machine.line(line or "", filename or "")
                out += [(program.name, m, labels, op, i, f, s, None if t is None else dt.datetime.fromtimestamp(t, dt.UTC), seq, k) for m, labels, op, i, f, s, t, k in ops]
                if error is not None:
                    out.append((program.name, ERROR_METRIC, (), "error", 1, None, None, None, seq, len(ops)))
            made = zip(*out, strict=True) if out else [()] * len(shape)
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(made, shape, strict=True)], schema=shape)

    return rows.mapInArrow(run, OPS)


def _value(i: int | None, f: float | None, s: str | None):
    return i if i is not None else f if f is not None else s


def op_stream(lines: DataFrame, programs: list[Program], options: Options, seed: DataFrame | None = None) -> tuple[DataFrame, dict[str, Analysis]]:
    """All ops of all programs, and how each program was run.  lines: filename, line, seq."""
    year = options.year if options.year is not None else options.clock().year
    found = {p.name: analyse(p) for p in programs}
    direct = [p for p in programs if found[p.name].tier != "C" and options.tier != "C"]
    parts = [_columns_ops(lines, direct, options, year)] if direct else []
    parts += [_machine_ops(lines, p, found[p.name], options, year, seed) for p in programs if p not in direct]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out, found


def run(lines: DataFrame, programs: dict[str, str] | list[Program], options: Options | None = None, previous: DataFrame | None = None) -> Result:
    """Runs programs (name: text) over lines (filename, line, seq) and returns the store.

    `previous` is a former store, whose cells are gone on from where program, type, place in the
    source and keys are the same.  ProgramError tells what is wrong with a program."""
    options = options or Options()
    spark = lines.sparkSession
    compiled = _compiled(programs, options)
    metrics = [m for p in compiled for m in infos(p)]
    check_kinds(metrics)
    seed = as_ops(previous, metrics) if previous is not None else None
    ops, found = op_stream(lines, compiled, options, seed)
    if seed is not None:
        ops = ops.unionByName(seed)
    # Programs are folded together where they need the same of a fold.
    need = {name: (True, True, True, True) if seed is not None else (a.ordered, a.mixed, a.appended, a.timed) for name, a in found.items()}
    real, cells = ops.where(F.col("op") != "error").unionByName(declared_ops(spark, metrics)), None
    for kind in sorted(set(need.values())):
        own = [n for n, k in need.items() if k == kind]
        part = fold(real if len(own) == len(need) else real.where(F.col("program").isin(own)), [m for m in metrics if m.program in own], *kind)
        cells = part if cells is None else cells.unionByName(part)
    store = dress(spark, cells, metrics, options.clock())
    if previous is not None:
        store = _with_histograms(store, previous)
    errors = ops.where(F.col("op") == "error").groupBy("program").agg(F.sum("i").alias("errors"))
    return Result(store, errors, ops, metrics, {n: a.tier for n, a in found.items()})


def stats(lines: DataFrame, result: Result) -> DataFrame:
    """What a run did: name, label and value of lines_total, log_lines_total by file, and
    runtime_errors_total by program (programs without errors too)."""
    spark = lines.sparkSession
    by_file = lines.groupBy("filename").agg(F.count(F.lit(1)).alias("value")).select(F.lit("log_lines_total").alias("name"), F.col("filename").alias("label"), "value")
    programs = local(spark, [(n,) for n in result.tiers], "program string")
    errors = programs.join(result.errors, "program", "left").select(F.lit("runtime_errors_total").alias("name"), F.col("program").alias("label"), F.coalesce("errors", F.lit(0)).cast("bigint").alias("value"))
    total = by_file.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(F.lit("lines_total").alias("name"), F.lit("").alias("label"), "value")
    return total.unionByName(by_file).unionByName(errors)


def _with_histograms(store: DataFrame, previous: DataFrame) -> DataFrame:
    """Histograms of both stores, added up."""
    key = ["program", "source", "labels"]
    old = previous.where(F.col("type") == "Buckets").select(*key, F.col("buckets").alias("_b"), F.col("hist_count").alias("_n"), F.col("hist_sum").alias("_s"))
    met = store.join(old, key, "left")
    both = F.transform(F.arrays_zip("buckets", "_b"), lambda x: F.struct(x["buckets"]["min"].alias("min"), x["buckets"]["max"].alias("max"), (x["buckets"]["count"] + x["_b"]["count"]).alias("count")))
    known = F.col("_n").isNotNull() & (F.col("type") == "Buckets")
    changed = {"buckets": F.when(known, both).otherwise(F.col("buckets")), "hist_count": F.when(known, F.col("hist_count") + F.col("_n")).otherwise(F.col("hist_count")), "hist_sum": F.when(known, F.col("hist_sum") + F.col("_s")).otherwise(F.col("hist_sum"))}
    return met.withColumns(changed).select(*store.columns)


__all__ = ["STORE", "Options", "Result", "compile_program", "op_stream", "run", "stats", "visible"]
