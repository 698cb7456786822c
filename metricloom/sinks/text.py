"""The store as text: each function gives a table of lines (column `line`), without hidden metrics.

Prometheus and JSON give documents: their lines have an order (columns before `line`).
"""

from __future__ import annotations

import json
import socket
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import format_float_column


def number() -> Column:
    """A cell's value as text (a histogram's is its sum)."""
    return F.coalesce(F.col("int_value").cast("string"), format_float_column(F.coalesce("float_value", "hist_sum")), F.col("str_value"))


def pairs(separator: str, between: str, clean: Column | None = None, first: list[Column] | None = None, quote: bool = False) -> Column:
    """Labels sorted by key, as text; clean: what to do to a label x."""
    labels = F.arrays_zip(F.col("keys").alias("k"), F.col("labels").alias("v"))
    value = (lambda x: clean(x)) if clean else (lambda x: x)
    quoted = (lambda x: F.concat(F.lit('"'), F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))) if quote else value
    every = F.transform(labels, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))
    if first:
        every = F.concat(every, F.array(*first))
    return F.array_join(F.transform(F.array_sort(every), lambda x: F.concat(x["k"], F.lit(separator), quoted(x["v"]))), between)


def _label(k: str, v: Column | str) -> Column:
    return F.struct(F.lit(k).alias("k"), (v if isinstance(v, Column) else F.lit(v)).alias("v"))


def _shown(store: DataFrame) -> DataFrame:
    return store.where(~F.col("hidden"))


def _millis() -> Column:
    return (F.unix_micros("ts") / 1000).cast("bigint").cast("string")


def prometheus(store: DataFrame, program_label: bool = True, timestamps: bool = False) -> DataFrame:
    """name, part, labels, line: ordered by these, the lines are an exposition document."""
    rows = _shown(store).where("kind <> 'text'").withColumn("name", F.replace(F.col("name"), F.lit("-"), F.lit("_")))
    first = [_label("prog", F.col("program"))] if program_label else None
    own = pairs("=", ",", None, first, quote=True)
    stamp = F.concat(F.lit(" "), _millis()) if timestamps else F.lit("")
    plain = rows.where("kind <> 'histogram'").select("name", F.lit(1).alias("part"), own.alias("labels"), F.concat("name", F.lit("{"), own, F.lit("} "), number(), stamp).alias("line"))
    running = F.transform("buckets", lambda b, k: F.struct(b["max"].alias("le"), F.aggregate(F.slice("buckets", 1, k + 1), F.lit(0).cast("bigint"), lambda s, x: s + x["count"]).alias("n"), k.alias("k")))
    hist = rows.where("kind = 'histogram'").withColumn("own", own)
    each = hist.select("name", "own", "ts", F.explode(running).alias("b"))
    comma = F.when(F.col("own") == "", "").otherwise(",")
    edge = format_float_column(F.col("b.le"))
    buckets = each.select("name", F.lit(1).alias("part"), F.concat("own", F.lpad(F.col("b.k").cast("string"), 6, "0")).alias("labels"), F.concat("name", F.lit("_bucket{"), "own", comma, F.lit('le="'), edge, F.lit('"} '), F.col("b.n").cast("string"), stamp).alias("line"))
    tail = lambda what, v, k: hist.select("name", F.lit(1).alias("part"), F.concat("own", F.lit(f"~{k}")).alias("labels"), F.concat("name", F.lit(f"_{what}{{"), "own", F.lit("} "), v, stamp).alias("line"))
    heads = rows.groupBy("name").agg(F.min("source").alias("source"), F.min(F.when(F.col("kind") == "timer", "gauge").otherwise(F.col("kind"))).alias("kind"))
    help_ = heads.select("name", F.lit(0).alias("part"), F.lit("0").alias("labels"), F.concat(F.lit("# HELP "), "name", F.lit(" defined at "), "source").alias("line"))
    type_ = heads.select("name", F.lit(0).alias("part"), F.lit("1").alias("labels"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind").alias("line"))
    out = help_
    for x in (type_, plain, buckets, tail("sum", format_float_column(F.col("hist_sum")), 0), tail("count", F.col("hist_count").cast("string"), 1)):
        out = out.unionByName(x)
    return out


def document(lines: DataFrame) -> str:
    """The ordered lines of a store's document, for a page or a file (the store's size, not the log's)."""
    return "".join(f"{r['line']}\n" for r in lines.orderBy(*[c for c in lines.columns if c != "line"]).collect())


def varz(store: DataFrame, instance: str | None = None) -> DataFrame:
    labels = pairs("=", ",")
    fixed = "prog=%s,instance=%s"  # after the sorted labels
    text = F.concat("name", F.lit("{"), labels, F.when(F.size("keys") > 0, ",").otherwise(""), F.format_string(fixed, "program", F.lit(instance or socket.gethostname())), F.lit("} "), number())
    return _shown(store).select(text.alias("line"))


def graphite(store: DataFrame, prefix: str = "", text_too: bool = True) -> DataFrame:
    rows = _shown(store) if text_too else _shown(store).where("kind <> 'text'")
    clean = lambda x: F.replace(x, F.lit("."), F.lit("_"))
    path = F.concat(F.lit(prefix), "program", F.lit("."), "name", F.when(F.size("keys") > 0, F.concat(F.lit("."), pairs(".", ".", clean))).otherwise(""))
    rows = rows.withColumns({"path": path, "at": F.unix_seconds("ts").cast("string")})
    plain = rows.select(F.concat_ws(" ", "path", number(), "at").alias("line"))
    hist = rows.where("kind = 'histogram'")
    edge = F.when(F.col("b.max") == float("inf"), "inf").otherwise(format_float_column(F.col("b.max")))
    bins = hist.select("path", "at", F.explode("buckets").alias("b")).select(F.concat_ws(" ", F.concat("path", F.lit(".bin_"), edge), F.col("b.count").cast("string"), "at").alias("line"))
    count = hist.select(F.concat_ws(" ", F.concat("path", F.lit(".count")), F.col("hist_count").cast("string"), "at").alias("line"))
    return plain.unionByName(bins).unionByName(count)


def statsd(store: DataFrame, prefix: str = "") -> DataFrame:
    kind = F.when(F.col("kind") == "counter", "c").when(F.col("kind") == "gauge", "g").when(F.col("kind") == "timer", "ms").otherwise("c")
    clean = lambda x: F.replace(x, F.lit("."), F.lit("_"))
    path = F.concat(F.lit(prefix), "program", F.lit("."), "name", F.when(F.size("keys") > 0, F.concat(F.lit("."), pairs(".", ".", clean))).otherwise(""))
    return _shown(store).where("kind <> 'text'").select(F.concat(path, F.lit(":"), number(), F.lit("|"), kind).alias("line"))


def collectd(store: DataFrame, host: str, interval: int = 60, prefix: str = "", plugin: str = "metricloom") -> DataFrame:
    """`plugin` names the exporting tool in the identifier, before the program."""
    clean = lambda x: F.replace(x, F.lit("-"), F.lit("_"))
    kind = F.when(F.col("kind") == "timer", "gauge").otherwise(F.col("kind"))
    what = F.concat(kind, F.lit("-"), "name", F.when(F.size("keys") > 0, F.concat(F.lit("-"), pairs("-", "-", clean))).otherwise(""))
    head = F.concat(F.lit(f'PUTVAL "{host}/{prefix}{plugin}-'), "program", F.lit("/"), what, F.lit(f'" interval={interval} '))
    return _shown(store).where("kind <> 'text'").select(F.concat(head, F.unix_seconds("ts").cast("string"), F.lit(":"), number()).alias("line"))


def json_cells(store: DataFrame) -> DataFrame:
    """One row for each metric: name, program, and the metric as JSON text."""
    nanos = (F.unix_micros("ts") * 1000).alias("Time")
    numeric = F.concat(F.lit('{"Value":'), number(), F.lit(',"Time":'), (F.unix_micros("ts") * 1000).cast("string"), F.lit("}"))
    text = F.to_json(F.struct(F.col("str_value").alias("Value"), nanos))
    bins = F.array_join(F.transform("buckets", lambda b: F.concat(F.lit('"'), format_float_column(b["max"]), F.lit('":'), b["count"].cast("string"))), ",")
    hist = F.concat(F.lit('{"Buckets":{'), bins, F.lit('},"Count":'), F.col("hist_count").cast("string"), F.lit(',"Sum":'), format_float_column(F.col("hist_sum")), F.lit(',"Time":'), (F.unix_micros("ts") * 1000).cast("string"), F.lit("}"))
    value = F.when(F.col("type") == "Buckets", hist).when(F.col("type") == "String", text).otherwise(numeric)
    expiry = F.when(F.col("expiry_s") > 0, F.concat(F.lit(',"Expiry":'), (F.col("expiry_s") * 1_000_000_000).cast("string"))).otherwise("")
    cell = F.concat(F.lit("{"), F.when(F.size("labels") > 0, F.concat(F.lit('"Labels":'), F.to_json("labels"), F.lit(","))).otherwise(""), F.lit('"Value":'), value, expiry, F.lit("}"))
    by = _shown(store).withColumn("cell", cell).groupBy("name", "program", "kind", "type", "source", "keys").agg(F.array_sort(F.collect_list(F.struct("labels", "cell"))).alias("cells"))
    # Kinds and types are numbered in this order.
    place = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c)).cast("string")
    kind = place("kind", ["counter", "gauge", "timer", "text", "histogram"])
    type_ = (F.array_position(F.array(*map(F.lit, ["Int", "Float", "String", "Buckets"])), F.col("type")) - 1).cast("string")
    keys = F.when(F.size("keys") > 0, F.concat(F.lit(',"Keys":'), F.to_json("keys"))).otherwise("")
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("s"))), r"(?s)\A\{\"s\":(.*)\}\z", 1)
    source = F.when(F.col("source") != "", F.concat(F.lit(',"Source":'), quoted("source"))).otherwise("")
    line = F.concat(F.lit('{"Name":'), quoted("name"), F.lit(',"Program":'), quoted("program"), F.lit(',"Kind":'), kind, F.lit(',"Type":'), type_, keys, F.lit(',"LabelValues":['), F.array_join(F.transform("cells", lambda c: c["cell"]), ","), F.lit("]"), source, F.lit("}"))
    return by.select("name", "program", line.alias("line"))


def json_document(store: DataFrame) -> str:
    """All metrics as one indented array."""
    cells = [json.loads(r["line"]) for r in json_cells(store).orderBy("name", "program").collect()]
    return json.dumps(cells, indent=2, ensure_ascii=False)


def json_by_name(store: DataFrame) -> str:
    """A map from name to its metrics."""
    out: dict[str, list] = {}
    for r in json_cells(store).orderBy("name", "program").collect():
        out.setdefault(r["name"], []).append(json.loads(r["line"]))
    return json.dumps(out, indent=2, ensure_ascii=False)


def push(lines: DataFrame, address: str, timeout: float = 10.0) -> int:
    """Sends lines to "tcp://host:port", "udp://host:port" or "unix://path"; the number sent.

    One connection from the driver: what is sent is the store, not the log."""
    scheme, _, where = address.partition("://")
    kind = socket.SOCK_DGRAM if scheme in ("udp", "unixgram") else socket.SOCK_STREAM
    family = socket.AF_UNIX if scheme.startswith("unix") else socket.AF_INET
    target = where if family == socket.AF_UNIX else (where.rpartition(":")[0], int(where.rpartition(":")[2]))
    n = 0
    with socket.socket(family, kind) as s:
        s.settimeout(timeout)
        s.connect(target)
        for r in lines.toLocalIterator():
            s.sendall((r["line"] + ("" if scheme == "udp" else "\n")).encode())
            n += 1
    return n


FORMATS: dict[str, Callable[..., DataFrame]] = {"prometheus": prometheus, "varz": varz, "graphite": graphite, "statsd": statsd, "collectd": collectd, "json": json_cells}
