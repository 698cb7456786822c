"""Programs with feedback and no key: segments of the log side by side, against one run line by line."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from metricloom.api import Options, run
from metricloom.lang.checker import MAX_DEPTH, MAX_PATTERN, compile_program
from metricloom.operators import segments
from metricloom.operators.interpreter import Machine
from metricloom.plans.analysis import analyse

NOW = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
OPTIONS = Options(now=NOW, year=2024)
RISES = "gauge last\ncounter up\ncounter down\n/k=(?P<k>\\d+)/ {\n  $k > last {\n    up++\n  } else {\n    down++\n  }\n  last = $k\n}\n"


def straight(text, rows, cells=None):
    """Ops of one run line by line, and the cells that are left."""
    program = compile_program(text, "p", MAX_PATTERN, MAX_DEPTH)
    machine, out = Machine(program, analyse(program).read, 2024, "UTC", NOW.timestamp()), []
    machine.cells |= cells or {}
    for seq, filename, line in sorted(rows):
        ops, error = machine.line(line, filename)
        out += [(m, labels, op, i, repr(f), s, seq, k) for m, labels, op, i, f, s, _, k in ops]
        out += [(-1, (), "error", 1, "None", None, seq, len(ops))] if error else []
    return sorted(out, key=str), machine.cells


def ran(result):
    return sorted(((r.metric, tuple(r.labels), r.op, r.i, repr(r.f), r.s, r.seq, r.ord) for r in result.ops.where("seq >= 0").collect()), key=str)


def table(spark, rows):
    rows = random.Random(5).sample(rows, len(rows))
    return spark.createDataFrame([(f, x, n) for n, f, x in rows], "filename string, line string, seq bigint")


@pytest.fixture
def short(monkeypatch):
    monkeypatch.setattr(segments, "LINES", 9)
    monkeypatch.setattr(segments, "LEAST", 9)
    monkeypatch.setattr(segments, "NOTED", (2, 5))


def test_no_task_has_all_lines(spark):
    lines = spark.range(40_000).select(F.lit("f").alias("filename"), F.concat(F.lit("k="), F.col("id") * 7919 % 101).alias("line"), F.col("id").alias("seq"))
    result = run(lines, {"p": RISES}, OPTIONS)
    most = result.ops.groupBy(F.spark_partition_id()).agg(F.countDistinct("seq").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 20_000
    ks = [n * 7919 % 101 for n in range(40_000)]
    up = sum(k > before for before, k in zip([0, *ks], ks, strict=False))
    assert {r.name: r.int_value for r in result.store.collect()} == {"up": up, "down": 40_000 - up, "last": ks[-1]}


def test_segments_as_line_by_line(spark, short):
    pick = random.Random(1)
    rows = [(n // 2 * 10, f"f{pick.randrange(3)}", pick.choice(["", "k=", f"k={pick.randrange(9)}"])) for n in range(150)]
    expected, _ = straight(RISES, rows)
    result = run(table(spark, rows), {"p": RISES}, OPTIONS)
    assert ran(result) == expected
    assert result.ops.rdd.getNumPartitions() > 8


STATE = "text state\ncounter c by state\n/\\] (?P<type>\\S+) / {\n  c[state]++\n  state = $type\n}\n"


@pytest.mark.parametrize("files", [2, 200])
def test_states_cross_segments(spark, short, monkeypatch, files):
    """Most lines don't match, so that a state lasts over several segments; a former store comes first."""
    monkeypatch.setattr(segments, "FILES", files)  # 2: several segments in a partition
    pick = random.Random(2)
    rows = [(n * 3, "f", f"[{n}] {pick.choice(['click', 'view', 'Größe'])} x" if pick.random() < 0.1 else "nothing") for n in range(200)]
    first = run(table(spark, rows[:60]), {"p": STATE}, OPTIONS).store
    _, cells = straight(STATE, rows[:60])
    expected, _ = straight(STATE, rows[60:], cells)
    result = run(table(spark, rows[60:]), {"p": STATE}, OPTIONS, previous=first)
    assert ran(result) == expected
    assert result.ops.where("seq >= 0").select(F.spark_partition_id()).distinct().count() > 1
    counts = {r.labels[0]: r.int_value for r in result.store.where("name = 'c'").collect()}
    whole, _ = straight(STATE, rows)
    assert counts == {x: sum(op[1] == (x,) and op[2] == "inc" for op in whole) for x in counts}


SEQUENTIAL = {
    "count": "gauge n\ncounter third\n/k=/ {\n  n++\n  n % 3 == 0 {\n    third++\n  }\n}\n",
    "toggle": "gauge on\ncounter c\n/k=\\d/ {\n  on = 1 - on\n  on > 0 {\n    c++\n  }\n}\n",
    "highest": "gauge top\ncounter rises\n/k=(?P<k>\\d+)/ {\n  $k > top {\n    top = $k\n    rises++\n  }\n}\n",
    "appended": "text trail\ncounter c by trail\n/k=(?P<k>\\d)$/ {\n  trail += $k\n  c[trail]++\n}\n",
    "failing": "text state\ncounter c\n/k=(?P<k>\\d*)/ {\n  int(state) > 4 {\n    c++\n  }\n}\n/k=(?P<j>\\d*)/ {\n  state = $j\n}\n",
    "constant": "gauge g\ncounter c\n/k=1/ {\n  g = 1\n}\n/$/ {\n  g == 1 {\n    c++\n  }\n}\n",
}


@pytest.mark.parametrize("name", SEQUENTIAL)
def test_states_that_do_not_settle(spark, short, name):
    pick = random.Random(3)
    rows = [(n, "f", pick.choice(["", "k=", f"k={pick.randrange(9)}", f"k={n}"])) for n in range(120)]
    expected, _ = straight(SEQUENTIAL[name], rows)
    assert ran(run(table(spark, rows), {"p": SEQUENTIAL[name]}, OPTIONS)) == expected


def test_long_states_are_not_gathered(spark, short, monkeypatch):
    monkeypatch.setattr(segments, "STATES", 2000)
    rows = [(n, "f", f"[{n}] {chr(97 + n % 26) * 300} x") for n in range(60)]
    expected, _ = straight(STATE, rows)
    assert ran(run(table(spark, rows), {"p": STATE}, OPTIONS)) == expected


AVERAGE = "gauge avg\n/ k=(?P<k>\\d+) / {\n  avg = 0.5 * $k + 0.5 * avg\n}\n"


@pytest.mark.parametrize("weight", ["0.5", "0.3"])
def test_averages_are_the_same_to_the_bit(spark, monkeypatch, weight):
    """A running average forgets its start within the noted lines; in short segments it doesn't and runs again."""
    text = AVERAGE.replace("0.5 * $k", f"{weight} * $k").replace("0.5 * avg", f"{1 - float(weight)} * avg")
    pick = random.Random(4)
    rows = [(n * n, "f", f"a k={pick.randrange(100)} b") for n in range(1500)]
    expected, cells = straight(text, rows)
    for lines, noted in ((500, (64, 512, 4096)), (400, (100, 300)), (40, (8, 16))):
        monkeypatch.setattr(segments, "LINES", lines)
        monkeypatch.setattr(segments, "NOTED", noted)
        result = run(table(spark, rows), {"p": text}, OPTIONS)
        assert ran(result) == expected
        assert result.ops.select(F.spark_partition_id()).distinct().count() > 1 or lines == 40
        assert [r.float_value for r in result.store.collect()] == [cells[0, ()]]
