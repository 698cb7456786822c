"""The metric store: a table of cells, its declared metrics, garbage collection and reload."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .plans.ops import OPS

STORE = (
    "program string, name string, kind string, type string, hidden boolean, source string, keys array<string>, labels array<string>, int_value bigint, float_value double, str_value string, "
    "buckets array<struct<min:double,max:double,count:bigint>>, hist_count bigint, hist_sum double, ts timestamp, expiry_s bigint, `limit` bigint"
)
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


@dataclass(frozen=True)
class MetricInfo:
    """A declared metric."""

    program: str
    index: int
    name: str
    kind: str
    type: str
    hidden: bool
    source: str
    keys: tuple[str, ...]
    buckets: tuple[float, ...]
    limit: int


class LoadError(ValueError):
    """Two programs export one name with different kinds."""


def infos(program) -> list[MetricInfo]:
    return [MetricInfo(program.name, m.index, m.exported or m.name, m.kind, m.type, m.hidden, f"{program.name}:{m.place}", tuple(m.keys), tuple(m.buckets), m.limit) for m in program.metrics]


def check_kinds(metrics: list[MetricInfo]) -> None:
    kinds: dict[str, MetricInfo] = {}
    for m in metrics:
        if not m.hidden and kinds.setdefault(m.name, m).kind != m.kind:
            raise LoadError(f"Metric {m.name} has different kind {m.kind} to existing {kinds[m.name].kind}")


def bounds(edges) -> list[tuple[float, float]]:
    """The ranges (low, high] of a histogram: from 0 if the first boundary is above it, up to infinity."""
    edges = list(edges)
    if not edges:
        return [(0.0, math.inf)]
    low = [(0.0, edges[0])] if edges[0] > 0 else []
    return low + list(zip(edges, edges[1:], strict=False)) + [(edges[-1], math.inf)]


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a local relation, which needs no job of its own."""
    shape = spark.createDataFrame([], schema).schema
    fields = to_arrow_schema(shape)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields), shape)


def declared_ops(spark: SparkSession, metrics: list[MetricInfo]) -> DataFrame:
    """Touches, at the epoch and before every line, of cells that exist before any: those of counters
    and histograms without keys."""
    rows = [(m.program, m.index, [], "touch", None, None, None, EPOCH, -2, 0) for m in metrics if not m.keys and m.kind in ("counter", "histogram")]
    return local(spark, rows, OPS)


def dress(spark: SparkSession, cells: DataFrame, metrics: list[MetricInfo], now: dt.datetime) -> DataFrame:
    """Cells (see operators.folds) with their metric's description; `now` stamps those without a time."""
    rows = [(m.program, m.index, m.name, m.kind, m.type, m.hidden, m.source, list(m.keys), [[a, b] for a, b in bounds(m.buckets)] if m.type == "Buckets" else None, m.limit or None) for m in metrics]
    about = F.broadcast(local(spark, rows, "program string, metric int, name string, kind string, type string, hidden boolean, source string, keys array<string>, bounds array<array<double>>, `limit` bigint"))
    met = cells.join(about, ["program", "metric"])
    of = lambda t, c: F.when(F.col("type") == t, F.col(c))
    buckets = F.transform("bounds", lambda b, k: F.struct(b[0].alias("min"), b[1].alias("max"), F.coalesce(F.get("counts", k), F.lit(0)).cast("bigint").alias("count")))
    return met.select(
        "program", "name", "kind", "type", "hidden", "source", "keys", "labels", of("Int", "i").alias("int_value"), of("Float", "f").alias("float_value"), of("String", "s").alias("str_value"),
        F.when(F.col("type") == "Buckets", buckets).alias("buckets"), of("Buckets", "hist_count").cast("bigint").alias("hist_count"), of("Buckets", "hist_sum").alias("hist_sum"),
        F.coalesce("ts", F.lit(now)).alias("ts"), "expiry_s", "limit",
    )


def gc(store: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Without cells that have expired at `as_of`, and with the newest `limit` cells of limited metrics."""
    live = store.where(F.col("expiry_s").isNull() | (F.unix_micros(F.lit(as_of)) - F.unix_micros("ts") <= F.col("expiry_s") * 1_000_000))
    limited = live.where(F.col("limit").isNotNull())
    newest = Window.partitionBy("program", "source").orderBy(F.desc("ts"), "labels")
    return live.where(F.col("limit").isNull()).unionByName(limited.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= F.col("limit")).drop("_n"))


def visible(store: DataFrame) -> DataFrame:
    return store.where(~F.col("hidden"))


def as_ops(store: DataFrame, metrics: list[MetricInfo]) -> DataFrame:
    """A former store as ops before every line: cells of metrics with equal program, source, type and keys."""
    rows = [(m.program, m.source, m.type, list(m.keys), m.index) for m in metrics]
    about = F.broadcast(local(store.sparkSession, rows, "program string, source string, type string, keys array<string>, metric int"))
    kept = store.where(F.col("type") != "Buckets").join(about, ["program", "source", "type", "keys"])
    common = ["program", "metric", "labels"]
    setter = kept.select(*common, F.lit("set").alias("op"), F.col("int_value").alias("i"), F.col("float_value").alias("f"), F.col("str_value").alias("s"), "ts", F.lit(-1).cast("bigint").alias("seq"), F.lit(0).alias("ord"))
    expiry = kept.where("expiry_s is not null").select(*common, F.lit("expire").alias("op"), F.lit(None).cast("bigint").alias("i"), F.col("expiry_s").cast("double").alias("f"), F.lit(None).cast("string").alias("s"), "ts", F.lit(-1).cast("bigint").alias("seq"), F.lit(1).alias("ord"))
    return setter.unionByName(expiry)
