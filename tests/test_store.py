"""The store, what is written from it, where lines come from, and streams."""

import datetime as dt
import io
import json
import os
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from metricloom.api import Options, run
from metricloom.functions import gotime
from metricloom.functions.numbers import format_float, format_float_column, parse_base_column, parse_int
from metricloom.sinks import text
from metricloom.store import gc

WHEN = dt.datetime(2021, 3, 5, 6, 7, tzinfo=dt.UTC)
PROGRAM = 'counter hits\ngauge open by host\ntimer lap\ntext word\nhistogram hist by xxx buckets 10, 20\nhidden counter secret\n/hits (\\d+)/ {\n  hits += $1\n  secret++\n}\n/open (\\S+) (\\d+)/ {\n  open[$1] = $2\n}\n/lap (\\d+)/ {\n  lap = $1\n}\n/word (\\w+)/ {\n  word = $1\n}\n/hist (\\d+)/ {\n  hist["bar"] = $1\n}\n'
LOG = 'hits 52\nopen web1.example 52\nopen db.example 61\nlap 123\nword a\nhist 1\nhist 1\nhist 15\nhist 15\nhist 15\nhist 900\nopen x"y" 4\n'


@pytest.fixture(scope="module")
def store(spark):
    from metricloom.sources.lines import from_text

    return run(from_text(spark, LOG), {"prog": PROGRAM}, Options(now=WHEN)).store.cache()


def lines(df):
    return sorted(r["line"] for r in df.collect())


def test_prometheus(store):
    doc = text.document(text.prometheus(store, False))
    assert "# HELP hits defined at prog:1:9-12\n# TYPE hits counter\nhits{} 52\n" in doc
    assert "# TYPE lap gauge\nlap{} 123\n" in doc and "word" not in doc and "secret" not in doc
    assert 'open{host="x\\"y\\""} 4\n' in doc
    assert 'hist_bucket{xxx="bar",le="10"} 2\nhist_bucket{xxx="bar",le="20"} 5\nhist_bucket{xxx="bar",le="+Inf"} 6\nhist_sum{xxx="bar"} 947\nhist_count{xxx="bar"} 6\n' in doc
    assert 'hits{prog="prog"} 52 1614924420000\n' in text.document(text.prometheus(store, True, True))


def test_line_formats(store):
    assert "prog.hits 52 1614924420" in lines(text.graphite(store))
    assert {"prog.open.host.web1_example 52 1614924420", "prog.hist.xxx.bar 947 1614924420", "prog.hist.xxx.bar.bin_10 2 1614924420", "prog.hist.xxx.bar.bin_20 3 1614924420", "prog.hist.xxx.bar.bin_inf 1 1614924420", "prog.hist.xxx.bar.count 6 1614924420"} <= set(lines(text.graphite(store)))
    assert "prefixprog.hits 52 1614924420" in lines(text.graphite(store, "prefix"))
    assert {"prog.hits:52|c", "prog.open.host.web1_example:52|g", "prog.lap:123|ms"} <= set(lines(text.statsd(store)))
    assert {'PUTVAL "node7/metricloom-prog/counter-hits" interval=60 1614924420:52', 'PUTVAL "node7/metricloom-prog/gauge-lap" interval=60 1614924420:123', 'PUTVAL "node7/metricloom-prog/gauge-open-host-web1.example" interval=60 1614924420:52'} <= set(lines(text.collectd(store, "node7")))
    assert {"hits{prog=prog,instance=here} 52", "open{host=web1.example,prog=prog,instance=here} 52", "word{prog=prog,instance=here} a"} <= set(lines(text.varz(store, "here")))


def test_json(store):
    by_name = {m["Name"]: m for m in json.loads(text.json_document(store))}
    assert by_name["hits"]["LabelValues"] == [{"Value": {"Value": 52, "Time": 1614924420000000000}}] and by_name["hits"]["Kind"] == 1
    assert by_name["hist"]["LabelValues"][0]["Value"]["Buckets"] == {"10": 2, "20": 3, "+Inf": 1}
    assert by_name["open"]["LabelValues"][0]["Labels"] == ["db.example"] and "secret" not in by_name
    assert set(json.loads(text.json_by_name(store))) == set(by_name)


def test_push(store):
    server = socket.socket()
    server.bind(("127.0.0.1", 0))
    server.listen()
    got = []

    def serve():
        peer, _ = server.accept()
        with peer, peer.makefile() as f:
            got.extend(f.read().splitlines())

    t = threading.Thread(target=serve)
    t.start()
    n = text.push(text.graphite(store, text_too=False), f"tcp://127.0.0.1:{server.getsockname()[1]}")
    t.join(10)
    server.close()
    assert n == len(got) and "prog.hits 52 1614924420" in got


def test_gc_by_age_and_number(spark, play):
    program = "gauge g by k limit 2\ngauge e by k\n/^(\\d+) (\\w+)$/ {\n  settime($1)\n  g[$2] = 1\n  e[$2] = 1\n  del e[$2] after 1h\n}\n"
    _, _, result = play(program, "100 aa\n200 bb\n5000 cc\n")
    left = {(r["name"], r["labels"][0]) for r in gc(result.store, dt.datetime.fromtimestamp(5100, dt.UTC)).collect()}
    assert left == {("g", "bb"), ("g", "cc"), ("e", "cc")}


def test_a_former_store_is_gone_on_from(spark, play):
    program = "counter c\ngauge g by k\nhistogram h buckets 1, 2\ntext t\n/(\\w+) (\\d+)/ {\n  c++\n  g[$1] += $2\n  h = $2\n  t = $1\n}\n"
    from metricloom.sources.lines import from_text

    options = Options(now=WHEN)
    once = run(from_text(spark, "a 1\nb 2\na 3\nc 4\n"), {"p": program}, options).store
    first = run(from_text(spark, "a 1\nb 2\n"), {"p": program}, options).store
    second = run(from_text(spark, "a 3\nc 4\n"), {"p": program}, options, first).store
    key = lambda s: sorted(map(str, s.select("name", "labels", "int_value", "str_value", "buckets", "hist_count", "hist_sum").collect()))
    assert key(once) == key(second)


def test_float_text(spark):
    values = [0.0, -0.0, 1.0, 37.0, 12.8, 0.1, 0.0001, 0.00001234, 123456.0, 999999.5, 1e6, 123456789.0, 1e21, -2.5, 1.5e-7, float("inf"), float("-inf"), float("nan"), -1e6, 3.14159]
    for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", format_float_column(F.col("v")).alias("t")).collect():
        assert r["t"] == format_float(r["v"])
    assert [format_float(x) for x in (1e6, 100000.0, 0.00001, 37.0)] == ["1e+06", "100000", "1e-05", "37"]


def test_whole_numbers_in_a_base(spark):
    for r in spark.createDataFrame([(x,) for x in ["ff", "-7f", "zz", "", "7fffffffffffffff", "-8000000000000000", "8000000000000000", "+10"]], "v string").select("v", parse_base_column(F.col("v"), F.lit(16)).alias("t")).collect():
        try:
            assert r["t"] == parse_int(r["v"], 16)
        except ValueError:
            assert r["t"] is None


@pytest.mark.parametrize("value,layout,zone", [("2011/02/22 21:50:31", "2006/01/02 15:04:05", "UTC"), ("Jun 30 12:04:43", "Jan _2 15:04:05", "America/New_York"), ("10/Oct/2000:13:55:36 -0700", "02/Jan/2006:15:04:05 -0700", "UTC"), ("2017-10-03T20:14:42Z", "2006-01-02T15:04:05Z07:00", "UTC"), ("bad", "2006", "UTC"), ("2021-02-30 17:34:23", "2006-01-02 15:04:05", "UTC"), ("Mon Feb 21 3:21:32 PM 2011", "Mon Jan _2 3:04:05 PM 2006", "UTC"), ("2021-01-03 17:34:23.25", "2006-01-02 15:04:05.000", "UTC")])
def test_times_in_rows_and_columns(spark, value, layout, zone):
    got = spark.createDataFrame([(value,)], "v string").select(F.unix_micros(gotime.parse_column(F.col("v"), layout, 2024, zone)).alias("t")).first()["t"]
    try:
        assert got == round(gotime.parse(value, layout, 2024, zone) * 1e6)
    except ValueError:
        assert got is None


def test_files(spark, tmp_path):
    from metricloom.sources.lines import load_programs, read_lines

    (tmp_path / "b.log").write_bytes(b"one\r\ntwo\rx\n\nlast")
    (tmp_path / "a.log").write_bytes(b"first\n")
    (tmp_path / "a.log.gz.skip").write_bytes(b"no\n")
    rows = read_lines(spark, [f"file://{tmp_path}/*"], ignore=r"\.skip$").orderBy("seq").collect()
    assert [(os.path.basename(r["filename"]), r["line"], r["seq"]) for r in rows] == [("a.log", "first", 0), ("b.log", "one", 1), ("b.log", "two\rx", 2), ("b.log", "", 3), ("b.log", "last", 4)]
    (tmp_path / "x.loom").write_text("counter c\n/$/ {\n  c++\n}\n")
    (tmp_path / ".y.loom").write_text("no")
    assert list(load_programs(str(tmp_path))) == ["x.loom"]


def test_tail_follows_rotates_and_truncates(tmp_path):
    from metricloom.sources.tail import TailReader

    log = tmp_path / "x.log"
    log.write_text("old\n")
    reader = TailReader({"path": f"{tmp_path}/*.log", "from_start": "false"})
    at = reader.initialOffset()
    with log.open("a") as f:
        f.write("one\ntwo\nhalf")
    rows, after = reader.read(at)
    assert [r[1] for r in rows] == ["one", "two"]
    assert [r[1] for r in reader.readBetweenOffsets(at, after)] == ["one", "two"]
    with log.open("a") as f:
        f.write(" done\n")
    rows, after = reader.read(after)
    assert [r[1:] for r in rows] == [("half done", 2)]
    log.write_text("cut\n")
    rows, after = reader.read(after)
    assert [r[1] for r in rows] == ["cut"]
    os.rename(log, tmp_path / "x.old")
    log.write_text("fresh and longer than before\n")
    rows, after = reader.read(after)
    assert [r[1] for r in rows] == ["fresh and longer than before"]
    os.remove(log)
    rows, after = reader.read(after)
    assert not list(rows) and set(after) == {"_seq"}


def test_tail_loses_nothing(tmp_path, monkeypatch):
    """What a file got between the last look and its rotation or deletion, partial last lines, and long lines."""
    import pickle

    from metricloom.sources import tail

    log = tmp_path / "x.log"
    log.write_text("a\nhal")
    reader = tail.TailReader({"path": f"{tmp_path}/*.log", "from_start": "true"})
    rows, at = reader.read(reader.initialOffset())
    assert [r[1] for r in rows] == ["a"]
    with log.open("a") as f:
        f.write("f\nlate\nno newline")
    os.rename(log, tmp_path / "x.log.1")
    log.write_text("new\npart")
    rows, after = reader.read(at)
    assert [r[1:] for r in rows] == [("half", 1), ("late", 2), ("no newline", 3), ("new", 4)]
    assert [r[1] for r in pickle.loads(pickle.dumps(reader)).readBetweenOffsets(at, after)] == ["half", "late", "no newline", "new"]
    log.write_text("z\n")
    rows, after = reader.read(after)
    assert [r[1] for r in rows] == ["part", "z"]
    with log.open("a") as f:
        f.write("before it goes\nand this")
    os.remove(log)
    rows, after = reader.read(after)
    assert [r[1] for r in rows] == ["before it goes", "and this"] and "_late" in after
    rows, after = reader.read(after)
    assert not list(rows) and "_late" not in after
    monkeypatch.setattr(tail, "BATCH_BYTES", 10)
    log.write_text("x" * 95 + "\nnext\n")
    rows, after = reader.read(after)
    assert [len(r[1]) for r in rows][0] == 95


def test_pages_and_names(spark, store):
    import threading
    import urllib.error
    import urllib.request

    from metricloom.sinks.pages import serve
    from metricloom.sources.lines import from_text

    server = serve(store, "127.0.0.1", 0, {"prog": PROGRAM})
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", timeout=60).read().decode()
    assert "hits{prog=\"prog\"} 52\n" in get("/metrics") and "hits{prog=prog," in get("/varz") and "prog.hits 52" in get("/graphite")
    assert {m["Name"] for m in json.loads(get("/json"))} >= {"hits", "open"} and "counter hits" in get("/programs") and "/metrics" in get("/")
    with pytest.raises(urllib.error.HTTPError):
        get("/nothing")
    server.shutdown()
    odd = run(from_text(spark, "x\n"), {'p"q': 'counter c as "a\\"b"\n/x/ {\n  c++\n}\n'}, Options(now=WHEN)).store
    assert json.loads(text.json_document(odd))[0]["Program"] == 'p"q'


def test_floats_in_base_16(spark):
    from metricloom.functions.numbers import parse_float, parse_float_column

    texts = ["0x1p4", "-0x1.8p1", "0X.8P-3", "0x1.fffffffffffffp1023", "0x1p99999", "0x1", "0xp1", "1.5", "0x0p0", "0x123456789abcdep-4"]
    for r in spark.createDataFrame([(x,) for x in texts], "v string").select("v", parse_float_column(F.col("v")).alias("x")).collect():
        try:
            assert r["x"] == parse_float(r["v"]), r
        except ValueError:
            assert r["x"] is None, r


def test_stream_of_a_tail(spark, tmp_path):
    from metricloom.sources.tail import TailSource
    from metricloom.streaming.run import StoreStream, counters

    spark.dataSource.register(TailSource)
    log = tmp_path / "x.log"
    log.write_text("a 1\nb 2\na 3\n")
    programs = {"p": "counter c by k\n/(\\w) (\\d+)/ {\n  c[$1] += $2\n}\n"}
    stream = StoreStream(spark, programs, str(tmp_path / "store"), Options(now=WHEN))
    source = spark.readStream.format("tail").option("path", str(log)).option("from_start", "true").load()
    query = stream.start(source, str(tmp_path / "cp"), every="1 second")
    deadline = time.time() + 60
    while time.time() < deadline and stream.latest() is None:
        time.sleep(0.2)
    with log.open("a") as f:
        f.write("b 5\n")
    value = lambda: {r["labels"][0]: r["int_value"] for r in stream.latest().collect()}
    while time.time() < deadline and value().get("b") != 7:
        time.sleep(0.2)
    query.stop()
    assert value() == {"a": 4, "b": 7}
    assert stream.reload({"p": "counter"}) and not stream.reload(programs)
    assert len(stream.done()) <= 3
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("f", "a 1", 0), ("f", "a 2", 1)], "filename string, line string, seq bigint").write.mode("append").parquet(str(tmp_path / "in"))
    lines_ = spark.readStream.schema("filename string, line string, seq bigint").parquet(str(tmp_path / "in"))
    q = counters(lines_, programs, Options(now=WHEN)).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["name"], r["labels"], r["value"]) for r in spark.table("counted").collect()] == [("c", ["a"], 3.0)]


@pytest.mark.parametrize("kind", ["tcp", "udp", "unix", "unixgram"])
def test_listeners(spark, tmp_path, kind):
    from metricloom.sources.listen import Listener, spool_columns

    spool = tmp_path / "spool"
    path = str(tmp_path / "s")
    listener = Listener(f"{kind}://127.0.0.1:0" if kind in ("tcp", "udp") else f"{kind}://{path}", str(spool))
    client = socket.socket(socket.AF_INET if kind in ("tcp", "udp") else socket.AF_UNIX, socket.SOCK_STREAM if kind in ("tcp", "unix") else socket.SOCK_DGRAM)
    client.connect(("127.0.0.1", listener.port) if kind in ("tcp", "udp") else path)
    client.sendall(b"one\r\ntwo\n")
    client.close()
    deadline = time.time() + 10
    while time.time() < deadline and not os.listdir(spool):
        time.sleep(0.05)
    time.sleep(0.2)
    listener.close()
    assert [r["line"] for r in spool_columns(spark.read.text(str(spool))).orderBy("seq").collect()] == ["one", "two"]


def test_named_pipe(spark, tmp_path):
    from metricloom.sources.listen import Listener, spool_columns

    pipe = str(tmp_path / "fifo")
    os.mkfifo(pipe)
    listener = Listener(f"fifo://{pipe}", str(tmp_path / "spool"))
    with open(pipe, "w") as f:
        f.write("a\nb\n")
    time.sleep(0.3)
    listener.close()
    assert [r["line"] for r in spool_columns(spark.read.text(str(tmp_path / "spool"))).orderBy("seq").collect()] == ["a", "b"]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from metricloom.cli import main

    (tmp_path / "p.loom").write_text("counter c\n/$/ {\n  c++\n}\n")
    assert main(["--progs", str(tmp_path), "--compile-only"]) == 0
    assert main(["--progs", str(tmp_path), "--rewrite"]) == 0
    assert "counter c\n/$/ {\n  c++\n}\n" in capsys.readouterr().out
    assert main(["--progs", str(tmp_path), "--dump-graph"]) == 0
    assert "digraph program" in capsys.readouterr().out
    (tmp_path / "one.log").write_text("x\ny\n")
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"z\n")))
    assert main(["--progs", str(tmp_path), "--logs", str(tmp_path / "one.log"), "--logs", "-"]) == 0
    assert json.loads(capsys.readouterr().out)["c"][0]["LabelValues"][0]["Value"]["Value"] == 3
    assert main(["--progs", str(tmp_path), "--logs", str(tmp_path / "one.log"), "--format", "collectd"]) == 0
    assert "metricloom-p.loom/counter-c" in capsys.readouterr().out
    (tmp_path / "q.loom").write_text("counter\n")
    assert main(["--progs", str(tmp_path), "--compile-only"]) == 1


def test_flagship_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stats_and_shared_patterns(spark):
    from metricloom.api import stats
    from metricloom.sources.lines import from_text

    program = "counter a by k\n/^(\\w+) x$/ {\n  a[$1]++\n}\n"
    lines = from_text(spark, "p x\nq x\nz\n", "f")
    result = run(lines, {"one": program, "two": program.replace("counter a", "counter b").replace("a[", "b[")}, Options(now=WHEN))
    assert {(r["name"], r["labels"][0]): r["int_value"] for r in result.store.collect()} == {(n, k): 1 for n in "ab" for k in "pq"}
    assert {(r["name"], r["label"]): r["value"] for r in stats(lines, result).collect()} == {("lines_total", ""): 3, ("log_lines_total", "f"): 3, ("runtime_errors_total", "one"): 0, ("runtime_errors_total", "two"): 0}


def test_pusher(store):
    from metricloom.streaming.run import Pusher

    p = Pusher([("tcp://127.0.0.1:9", text.statsd)], seconds=3600)
    p(store, 0)
    p(store, 1)
    assert p.failures == 1


def test_graph():
    from metricloom.lang.parser import dot, parse

    assert 'label="cond"' in dot(parse('counter c\n/x"y/ {\n  c++\n} else {\n  stop\n}\n'))


def test_reload_by_content(spark, tmp_path):
    """Unchanged programs stay, wrong ones go on as they were, others come and go; old stores are deleted."""
    from metricloom.sources.lines import from_text
    from metricloom.streaming.run import KEPT, StoreStream

    one, two = "counter a\n/x/ {\n  a++\n}\n", "counter b\n/y/ {\n  b++\n}\n"
    progs = tmp_path / "progs"
    progs.mkdir()
    (progs / "one.loom").write_text(one)
    (progs / "two.loom").write_text(two)
    stream = StoreStream(spark, {"one.loom": one, "two.loom": two}, f"file://{tmp_path}/store", Options(now=WHEN), collect=3600)
    stream.follow(str(progs), None)
    same = stream.programs[0]
    batch = from_text(spark, "x\ny\n")
    stream.step(batch, 0)
    (progs / "two.loom").write_text("counter\n")
    (progs / "three.loom").write_text("counter d\n/x/ {\n  d += 5\n}\n")
    stream.step(batch, 1)
    stream.asked = True
    stream.step(batch, 2)
    cells = lambda: {r["name"]: r["int_value"] for r in stream.latest().collect()}
    assert cells() == {"a": 3, "b": 3, "d": 5} and same in stream.programs
    os.remove(progs / "two.loom")
    stream.asked = True
    stream.step(batch, 3)
    assert cells() == {"a": 4, "d": 10} and stream.done() == [1, 2, 3] and KEPT == 3
    assert stream.reload({"one.loom": one, "clash": "gauge a\n/x/ {\n  a = 1\n}\n"})
    counts = {k: v for k, v in stream.counts.items() if v}
    assert counts == {("prog_loads_total", "one.loom"): 1, ("prog_loads_total", "two.loom"): 1, ("prog_loads_total", "three.loom"): 1, ("prog_load_errors_total", "two.loom"): 1, ("prog_load_errors_total", "clash"): 1,
                      ("prog_unloads_total", "two.loom"): 1, ("prog_unloads_total", "three.loom"): 1, ("batches_total", ""): 4, ("collections_total", ""): 1}


def test_idle_files_are_closed(tmp_path):
    from metricloom.sources.tail import IDLE, TailReader

    log = tmp_path / "x.log"
    log.write_text("a\nb")
    reader = TailReader({"path": str(log), "from_start": "true"})
    rows, at = reader.read(reader.initialOffset())
    assert [r[1] for r in rows] == ["a"] and str(log) in reader.files
    os.utime(log, (time.time() - IDLE - 60,) * 2)
    rows, at = reader.read(at)
    assert not list(rows) and not reader.files
    with log.open("a") as f:
        f.write("c\n")
    rows, at = reader.read(at)
    assert [r[1] for r in rows] == ["bc"] and reader.files


def test_a_stale_handle_is_opened_anew(tmp_path, monkeypatch):
    import errno

    from metricloom.sources import tail

    log, calls, real = tmp_path / "x.log", [], os.fstat
    log.write_text("a\n")

    def fstat(fd):
        calls.append(fd)
        if len(calls) == 1:
            raise OSError(errno.ESTALE, "stale")
        return real(fd)

    reader = tail.TailReader({"path": str(log), "from_start": "true"})
    start = reader.initialOffset()
    monkeypatch.setattr(tail.os, "fstat", fstat)
    rows, _ = reader.read(start)
    assert [r[1] for r in rows] == ["a"] and len(calls) == 2


def test_command_line_follows(spark, tmp_path, capsys):
    from metricloom import cli

    (tmp_path / "p.loom").write_text("counter c by w\n/(?P<w>\\w+)/ {\n  c[$w]++\n}\n")
    log = tmp_path / "x.log"
    log.write_text("before\n")
    assert cli.main(["--progs", str(tmp_path), "--follow"]) == 1 and "--store" in capsys.readouterr().err
    a = cli.arguments().parse_args(["--progs", str(tmp_path), "--logs", str(log), "--follow", "--store", str(tmp_path / "kept"), "--push", "statsd=tcp://127.0.0.1:9"])
    stream, query = cli.follow(spark, a, {"p.loom": (tmp_path / "p.loom").read_text()}, Options(now=WHEN))
    try:
        deadline, found = time.time() + 90, {}
        while time.time() < deadline and found.get("after", 0) < 1:
            with log.open("a") as f:
                f.write("after\n")
            time.sleep(1)
            latest = stream.latest()
            found = {r["labels"][0]: r["int_value"] for r in latest.collect()} if latest is not None else {}
    finally:
        query.stop()
    assert found.get("after", 0) >= 1 and "before" not in found and stream.on_store.failures == 1
