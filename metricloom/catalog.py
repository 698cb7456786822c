"""Queries over the test tables: rows are written as log lines, a program runs over them, and the
store is returned.  ORACLE_SQL computes the same from the columns."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Options, run
from .sinks import text as sinks
from .sources.lines import read_lines
from .store import gc
from .streaming.run import StoreStream, counters

NOW = dt.datetime(2024, 6, 1, tzinfo=dt.UTC)
OPTIONS = Options(year=2024, now=NOW)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _time(c: str, pattern: str = "yyyy/MM/dd HH:mm:ss") -> Column:
    return F.date_format(F.col(c).cast("timestamp"), pattern)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2024/01/02 03:04:05 [17] click value=1.5 k=87 id=3"""
    k = F.regexp_extract("props", r'"k": (\d+)', 1)
    line = F.concat(_time("ts"), F.lit(" ["), F.col("user_id").cast("string"), F.lit("] "), "event_type", F.lit(" value="), F.col("value").cast("string"), F.lit(" k="), k, F.lit(" id="), F.col("event_id").cast("string"))
    return _table(spark, sf_dir, "events").select(F.lit("events.log").alias("filename"), line.alias("line"), F.col("event_id").alias("seq"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """17 3 R O 32.0 33203.72 0.05"""
    line = F.concat_ws(" ", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"), F.col("l_discount").cast("string"))
    return _table(spark, sf_dir, "lineitem").select(F.lit("lineitem.log").alias("filename"), line.alias("line"), F.col("l_orderkey").alias("seq"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1996-01-02 host orders[17]: customer 370 status O total 172799.49 priority 5-LOW"""
    line = F.concat(_time("o_orderdate", "yyyy-MM-dd"), F.lit(" host orders["), F.col("o_orderkey").cast("string"), F.lit("]: customer "), F.col("o_custkey").cast("string"), F.lit(" status "), "o_orderstatus", F.lit(" total "), F.col("o_totalprice").cast("string"), F.lit(" priority "), "o_orderpriority")
    return _table(spark, sf_dir, "orders").select(F.concat(F.lit("/var/log/orders."), "o_orderstatus").alias("filename"), line.alias("line"), F.col("o_orderkey").alias("seq"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every text, as it is."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return docs.select(F.col("doc_id").cast("string").alias("filename"), "line", (F.col("doc_id") * 100000 + F.col("n")).alias("seq"))


def _key(k: int) -> Column:
    return F.coalesce(F.get("labels", F.lit(k)), F.lit("")).alias(f"k{k + 1}")


def _ints(store: DataFrame) -> DataFrame:
    return store.select("name", _key(0), _key(1), F.col("int_value").alias("value"))


def _floats(store: DataFrame) -> DataFrame:
    return store.select("name", _key(0), _key(1), F.round("float_value", 2).alias("value"))


def _texts(store: DataFrame) -> DataFrame:
    return store.select("name", _key(0), _key(1), F.col("str_value").alias("value"))


def _stamps(store: DataFrame) -> DataFrame:
    return store.select("name", _key(0), F.unix_seconds("ts").alias("at"))


def _bins(store: DataFrame) -> DataFrame:
    rows = store.select("name", _key(0), F.explode("buckets").alias("b"))
    return rows.select("name", "k1", F.when(F.col("b.max") == float("inf"), -1.0).otherwise(F.col("b.max")).alias("upto"), F.col("b.count").alias("n"))


def _sums(store: DataFrame) -> DataFrame:
    return store.select("name", _key(0), F.col("hist_count").alias("n"), F.round("hist_sum", 2).alias("total"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PROGRAMS: dict[str, str] = {}


def _query(name: str, lines, program: str | dict[str, str], shape, sql: str, options: Options = OPTIONS, after=None) -> None:
    programs = program if isinstance(program, dict) else {name: program}

    def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = run(lines(spark, sf_dir), programs, options).store
        return shape(after(store) if after else store)

    QUERIES[name], ORACLE_SQL[name] = ask, sql
    PROGRAMS.update(programs)


HEAD = r"/^(?P<date>\S+ \S+) \[(?P<user>\d+)\] (?P<type>\S+) value=(?P<value>[-+]?\d+\.?\d*([eE][-+]?\d+)?) k=(?P<k>\d*) id=(?P<id>\d+)/"
VALUE = r"/value=(?P<value>[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?) k=(?P<k>\d+)/"
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
GROUPS = "event_type AS k1, '' AS k2"

_query("line_count", events, "counter lines_total\n/$/ {\n  lines_total++\n}\n", _ints, "SELECT 'lines_total' AS name, '' AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM events")
_query("counter_by_label", events, "counter events_total by type\n/\\] (?P<type>\\S+) value/ {\n  events_total[$type]++\n}\n", _ints, f"SELECT 'events_total' AS name, {GROUPS}, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY event_type")
_query(
    "counter_two_labels", lineitem, "counter items by flag, status\n/^\\d+ \\d+ (\\S+) (\\S+) / {\n  items[$1][$2]++\n}\n", _ints,
    "SELECT 'items' AS name, l_returnflag AS k1, l_linestatus AS k2, CAST(count(*) AS BIGINT) AS value FROM lineitem GROUP BY ALL",
)
_query("counter_add_int", events, "counter ks by type\n" + HEAD + " {\n  ks[$type] += $user\n}\n", _ints, f"SELECT 'ks' AS name, {GROUPS}, CAST(sum(user_id) AS BIGINT) AS value FROM events GROUP BY event_type")
_query("counter_add_float", events, "counter total by type\n/\\] (?P<type>\\S+) / {\n  " + VALUE + " {\n    total[$type] += $value\n  }\n}\n", _floats, f"SELECT 'total' AS name, {GROUPS}, round(sum(value), 2) AS value FROM events GROUP BY event_type")
_query(
    "else_branch", events, "counter high\ncounter low\n" + VALUE + " {\n  $k >= 50 {\n    high++\n  } else {\n    low++\n  }\n}\n", _ints,
    f"SELECT CASE WHEN {K} >= 50 THEN 'high' ELSE 'low' END AS name, '' AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY ALL",
)
_query(
    "otherwise_branch", events, "counter a\ncounter b\ncounter rest\n/ k=1/ {\n  a++\n}\n/ k=2/ {\n  b++\n}\notherwise {\n  rest++\n}\n", _ints,
    f"SELECT CASE left({K}::VARCHAR, 1) WHEN '1' THEN 'a' WHEN '2' THEN 'b' ELSE 'rest' END AS name, '' AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY ALL",
)
_query(
    "nested_otherwise", events, "counter kind by which\n/ k=(\\d+)/ {\n  $1 < 30 {\n    $1 < 10 {\n      kind[\"small\"]++\n    }\n    otherwise {\n      kind[\"medium\"]++\n    }\n  }\n  otherwise {\n    kind[\"large\"]++\n  }\n}\n", _ints,
    f"SELECT 'kind' AS name, CASE WHEN {K} < 10 THEN 'small' WHEN {K} < 30 THEN 'medium' ELSE 'large' END AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY ALL",
)
_query(
    "and_or_shortcircuit", events, "counter hits by what\n/\\] (?P<type>\\S+) value/ {\n  / k=(?P<k>\\d+)/ {\n    $type == \"click\" && $k > 50 {\n      hits[\"and\"]++\n    }\n    $type == \"click\" || $k > 90 {\n      hits[\"or\"]++\n    }\n  }\n}\n", _ints,
    f"SELECT 'hits' AS name, k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM (SELECT 'and' AS k1 FROM events WHERE event_type = 'click' AND {K} > 50 UNION ALL SELECT 'or' FROM events WHERE event_type = 'click' OR {K} > 90) GROUP BY k1",
)
_query(
    "match_op", orders, "counter urgent by status\n/status (\\S+) total \\S+ priority (.*)$/ {\n  $2 =~ /^[12]-/ {\n    urgent[$1]++\n  }\n}\n", _ints,
    "SELECT 'urgent' AS name, o_orderstatus AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM orders WHERE regexp_matches(o_orderpriority, '^[12]-') GROUP BY ALL",
)
_query(
    "not_match_op", orders, "counter calm by status\n/status (\\S+) total \\S+ priority (.*)$/ {\n  $2 !~ /^[12]-/ {\n    calm[$1]++\n  }\n}\n", _ints,
    "SELECT 'calm' AS name, o_orderstatus AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[12]-') GROUP BY ALL",
)
_query(
    "compare_float", events, "counter cmp by what\n" + VALUE + " {\n  $value < 10.0 {\n    cmp[\"lt\"]++\n  }\n  $value >= 50.5 {\n    cmp[\"ge\"]++\n  }\n  $value != 0.0 {\n    cmp[\"ne\"]++\n  }\n}\n", _ints,
    "SELECT 'cmp' AS name, k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM (SELECT 'lt' AS k1 FROM events WHERE value < 10 UNION ALL SELECT 'ge' FROM events WHERE value >= 50.5 UNION ALL SELECT 'ne' FROM events WHERE value <> 0) GROUP BY k1",
)
_query(
    "compare_string", events, "counter cmp by what\n/\\] (?P<type>\\S+) / {\n  $type < \"purchase\" {\n    cmp[\"lt\"]++\n  }\n  $type >= \"purchase\" {\n    cmp[\"ge\"]++\n  }\n}\n", _ints,
    "SELECT 'cmp' AS name, CASE WHEN event_type < 'purchase' THEN 'lt' ELSE 'ge' END AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY ALL",
)
_query(
    "int_arith", events, "counter r by op\n/ k=(?P<k>\\d+) id=(?P<id>\\d+)/ {\n  r[\"add\"] += $k + $id\n  r[\"sub\"] += $k - $id\n  r[\"mul\"] += $k * 3\n  r[\"div\"] += ($k - 50) / 7\n  r[\"mod\"] += ($k - 50) % 7\n  r[\"pow\"] += $k ** 2\n}\n", _ints,
    f"""SELECT 'r' AS name, k1, '' AS k2, CAST(value AS BIGINT) AS value FROM (SELECT 'add' AS k1, sum({K} + event_id) AS value FROM events UNION ALL SELECT 'sub', sum({K} - event_id) FROM events UNION ALL SELECT 'mul', sum({K} * 3) FROM events
    UNION ALL SELECT 'div', sum(({K} - 50) // 7) FROM events UNION ALL SELECT 'mod', sum(({K} - 50) % 7) FROM events UNION ALL SELECT 'pow', sum({K} * {K}) FROM events)""",
)
_query(
    "bitwise_shift", events, "counter r by op\n/ k=(?P<k>\\d+) / {\n  r[\"and\"] += $k & 12\n  r[\"or\"] += $k | 3\n  r[\"xor\"] += $k ^ 5\n  r[\"shl\"] += $k << 3\n  r[\"shr\"] += $k >> 1\n}\n", _ints,
    f"""SELECT 'r' AS name, k1, '' AS k2, CAST(value AS BIGINT) AS value FROM (SELECT 'and' AS k1, sum({K} & 12) AS value FROM events UNION ALL SELECT 'or', sum({K} | 3) FROM events UNION ALL SELECT 'xor', sum(xor({K}, 5)) FROM events
    UNION ALL SELECT 'shl', sum({K} * 8) FROM events UNION ALL SELECT 'shr', sum({K} // 2) FROM events)""",
)
_query("complement", events, "counter hit\n/ k=(?P<k>\\d+) / {\n  ~$k {\n    hit++\n  }\n}\n", _ints, "SELECT 'hit' AS name, '' AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM events")
_query(
    "float_arith", events, "gauge r by op\n" + VALUE + " {\n  r[\"a\"] += $value * 2.0 + 1.0\n  r[\"b\"] += $value / 4.0 - 0.5\n}\n", _floats,
    "SELECT 'r' AS name, k1, '' AS k2, round(value, 2) AS value FROM (SELECT 'a' AS k1, sum(value * 2 + 1) AS value FROM events UNION ALL SELECT 'b', sum(value / 4 - 0.5) FROM events)",
)
_query("concat_label", events, "counter c by both\n/\\] (?P<type>\\S+) value=\\S+ k=(?P<k>\\d+)/ {\n  c[$type + \"/\" + string($k)]++\n}\n", _ints, f"SELECT 'c' AS name, event_type || '/' || {K} AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY ALL")
_query("len_bytes", documents, "counter bytes\n/(?P<all>.*)/ {\n  bytes += len($all)\n}\n", _ints, "SELECT 'bytes' AS name, '' AS k1, '' AS k2, CAST(sum(strlen(text) - (length(text) - length(replace(text, chr(10), '')))) AS BIGINT) AS value FROM documents")
_query("tolower_label", orders, "counter c by p\n/priority (.*)$/ {\n  c[tolower($1)]++\n}\n", _ints, "SELECT 'c' AS name, lower(o_orderpriority) AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM orders GROUP BY ALL")
_query("strtol_hex", events, "counter h\n/ k=(?P<k>\\d+) / {\n  h += strtol(string($k), 16)\n}\n", _ints, f"SELECT 'h' AS name, '' AS k1, '' AS k2, CAST(sum(({K} // 10) * 16 + {K} % 10) AS BIGINT) AS value FROM events WHERE {K} < 100")
_query("subst_literal", orders, "counter c by p\n/priority (.*)$/ {\n  c[subst(\"-\", \"_\", $1)]++\n}\n", _ints, "SELECT 'c' AS name, replace(o_orderpriority, '-', '_') AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM orders GROUP BY ALL")
_query("subst_regex", orders, "counter c by p\n/priority (.*)$/ {\n  c[subst(/[0-9]+-/, \"$1:\", $1)]++\n}\n", _ints, "SELECT 'c' AS name, '$1:' || regexp_replace(o_orderpriority, '[0-9]+-', '') AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM orders GROUP BY ALL")
_query("cast_int_label", events, "counter c by k\n/ k=(?P<k>\\S+) id/ {\n  c[int($k) / 10]++\n}\n", _ints, f"SELECT 'c' AS name, CAST({K} // 10 AS VARCHAR) AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY ALL")
_query("cast_float", events, "counter c\n/ k=(?P<k>\\d+) / {\n  c += float($k) / 4.0\n}\n", _floats, f"SELECT 'c' AS name, '' AS k1, '' AS k2, round(sum({K} / 4.0), 2) AS value FROM events")
_query("strptime_epoch", events, "gauge seen by type\n" + HEAD + " {\n  strptime($date, \"2006/01/02 15:04:05\")\n  seen[$type] = timestamp()\n}\n", _ints, f"SELECT 'seen' AS name, {GROUPS}, CAST(epoch(arg_max(date_trunc('second', ts), event_id)) AS BIGINT) AS value FROM events GROUP BY event_type")
_query("strptime_stamp", events, "counter seen by type\n" + HEAD + " {\n  strptime($date, \"2006/01/02 15:04:05\")\n  seen[$type]++\n}\n", _stamps, "SELECT 'seen' AS name, event_type AS k1, CAST(epoch(arg_max(date_trunc('second', ts), event_id)) AS BIGINT) AS at FROM events GROUP BY event_type")
_query("settime_epoch", events, "counter seen by type\n/\\] (?P<type>\\S+) .*id=(?P<id>\\d+)/ {\n  settime($id)\n  seen[$type]++\n}\n", _stamps, "SELECT 'seen' AS name, event_type AS k1, CAST(max(event_id) AS BIGINT) AS at FROM events GROUP BY event_type")
_query("filename_label", orders, "counter files by name\n/$/ {\n  files[getfilename()]++\n}\n", _ints, "SELECT 'files' AS name, '/var/log/orders.' || o_orderstatus AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM orders GROUP BY ALL")
_query("filename_stop", orders, "counter n by status\ngetfilename() !~ /orders\\.[FO]$/ {\n  stop\n}\n/status (\\S+) / {\n  n[$1]++\n}\n", _ints, "SELECT 'n' AS name, o_orderstatus AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL")
_query("gauge_last", orders, "gauge last by status\n/status (?P<s>\\S+) total (?P<t>\\d+\\.\\d+)/ {\n  last[$s] = $t\n}\n", _floats, "SELECT 'last' AS name, o_orderstatus AS k1, '' AS k2, round(arg_max(o_totalprice, o_orderkey), 2) AS value FROM orders GROUP BY ALL")
_query("timer_last", events, "timer t by type\n/\\] (?P<type>\\S+) .* k=(?P<k>\\d+)/ {\n  t[$type] = $k\n}\n", _ints, f"SELECT 't' AS name, {GROUPS}, arg_max({K}, event_id) AS value FROM events GROUP BY event_type")
_query("text_last", orders, "text last by status\n/status (?P<s>\\S+) .*priority (?P<p>.*)$/ {\n  last[$s] = $p\n}\n", _texts, "SELECT 'last' AS name, o_orderstatus AS k1, '' AS k2, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY ALL")
_query(
    "set_then_inc", events, "gauge g by type\n/\\] (?P<type>\\S+) .* k=(?P<k>\\d+)/ {\n  $k == 7 {\n    g[$type] = 1000\n  } else {\n    g[$type]++\n  }\n}\n", _ints,
    f"""WITH s AS (SELECT event_type, event_id, {K} AS k, max(CASE WHEN {K} = 7 THEN event_id END) OVER (PARTITION BY event_type) AS last FROM events)
    SELECT 'g' AS name, event_type AS k1, '' AS k2, CAST(max(CASE WHEN last IS NULL THEN 0 ELSE 1000 END) + count(*) FILTER (k <> 7 AND (last IS NULL OR event_id > last)) AS BIGINT) AS value FROM s GROUP BY event_type""",
)
_HIST = "CASE WHEN {x} <= 10 THEN 10.0 WHEN {x} <= 50 THEN 50.0 WHEN {x} <= 90 THEN 90.0 ELSE -1.0 END"
_query(
    "histogram_counts", events, "histogram h buckets 10, 50, 90\n/ k=(?P<k>\\d+) / {\n  h = $k\n}\n", _bins,
    f"SELECT 'h' AS name, '' AS k1, upto, CAST(count(k) AS BIGINT) AS n FROM (VALUES (10.0::DOUBLE), (50.0), (90.0), (-1.0)) b(upto) LEFT JOIN (SELECT {K} AS k, CAST({_HIST.format(x=K)} AS DOUBLE) AS upto FROM events) USING (upto) GROUP BY upto",
)
_query("histogram_labelled", events, "histogram h by type buckets 10, 50, 90\n/\\] (?P<type>\\S+) value=(?P<v>[-+]?\\d+\\.\\d+) / {\n  h[$type] = $v\n}\n", _sums, "SELECT 'h' AS name, event_type AS k1, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
_query(
    "del_reset", events, "counter c by type\n/\\] (?P<type>\\S+) .* k=(?P<k>\\d+)/ {\n  $k == 3 {\n    del c[$type]\n  } else {\n    c[$type]++\n  }\n}\n", _ints,
    f"""WITH s AS (SELECT event_type, event_id, {K} AS k, max(CASE WHEN {K} = 3 THEN event_id END) OVER (PARTITION BY event_type) AS gone FROM events)
    SELECT 'c' AS name, event_type AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM s WHERE k <> 3 AND (gone IS NULL OR event_id > gone) GROUP BY event_type""",
)
_query(
    "expire_gc", events, "gauge g by user\n" + HEAD + " {\n  settime($id)\n  g[$user] = $id\n  del g[$user] after 1h\n}\n", _ints,
    "SELECT 'g' AS name, CAST(user_id AS VARCHAR) AS k1, '' AS k2, CAST(max(event_id) AS BIGINT) AS value FROM events GROUP BY user_id HAVING 9000 - max(event_id) <= 3600",
    after=lambda s: gc(s, dt.datetime.fromtimestamp(9000, dt.UTC)),
)
_query(
    "limit_gc", events, "gauge g by user limit 10\n" + HEAD + " {\n  settime($id)\n  g[$user] = $id\n}\n", _ints,
    "SELECT 'g' AS name, CAST(user_id AS VARCHAR) AS k1, '' AS k2, CAST(max(event_id) AS BIGINT) AS value FROM events GROUP BY user_id ORDER BY value DESC LIMIT 10",
    after=lambda s: gc(s, NOW),
)
_query(
    "session_duration", events, "hidden gauge opened by user\ncounter spent by user\n/\\[(?P<user>\\d+)\\] (?P<type>\\S+) .*id=(?P<id>\\d+)/ {\n  $type == \"view\" {\n    opened[$user] = $id\n  }\n  $type == \"purchase\" {\n    spent[$user] += $id - opened[$user]\n    del opened[$user]\n  }\n}\n",
    lambda s: _ints(s.where("not hidden")),
    """WITH e AS (SELECT user_id, event_type, event_id, last_value(CASE WHEN event_type IN ('view', 'purchase') THEN CASE WHEN event_type = 'view' THEN event_id ELSE 0 END END IGNORE NULLS)
      OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened FROM events)
    SELECT 'spent' AS name, CAST(user_id AS VARCHAR) AS k1, '' AS k2, CAST(sum(event_id - coalesce(opened, 0)) AS BIGINT) AS value FROM e WHERE event_type = 'purchase' GROUP BY user_id""",
)
_query(
    "metric_as_rvalue", events, "gauge last\ncounter up\ncounter down\n/ k=(?P<k>\\d+) / {\n  $k > last {\n    up++\n  } else {\n    down++\n  }\n  last = $k\n}\n", _ints,
    f"""WITH e AS (SELECT event_id, {K} AS k, coalesce(lag({K}) OVER (ORDER BY event_id), 0) AS before FROM events)
    SELECT CASE WHEN k > before THEN 'up' ELSE 'down' END AS name, '' AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM e GROUP BY 1
    UNION ALL SELECT 'last', '', '', arg_max(k, event_id) FROM e""",
)
_query(
    "running_state_label", events, "text state\ncounter c by state\n/\\] (?P<type>\\S+) / {\n  c[state]++\n  state = $type\n}\n", lambda s: _ints(s.where("kind = 'counter'")),
    "SELECT 'c' AS name, before AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM (SELECT coalesce(lag(event_type) OVER (ORDER BY event_id), '') AS before FROM events) GROUP BY before",
)
_query(
    "ema_fold", events, "gauge avg\n/ k=(?P<k>\\d+) / {\n  avg = 0.5 * $k + 0.5 * avg\n}\n", _floats,
    f"""WITH e AS (SELECT {K} AS k, row_number() OVER (ORDER BY event_id DESC) AS back FROM events)
    SELECT 'avg' AS name, '' AS k1, '' AS k2, round(sum(k * pow(0.5, back)), 2) AS value FROM e WHERE back <= 60""",
)
_query(
    "runtime_error_partial", orders, "counter before\ncounter later\n/priority (?P<p>.*)$/ {\n  before++\n  int(subst(\"1-URGENT\", \"17\", $p)) > 0 {\n    later++\n  }\n}\n", _ints,
    "SELECT 'before' AS name, '' AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM orders UNION ALL SELECT 'later', '', '', CAST(count(*) AS BIGINT) FROM orders WHERE o_orderpriority = '1-URGENT'",
)


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(orders(spark, sf_dir), {"runtime_error_partial": PROGRAMS["runtime_error_partial"]}, OPTIONS).errors


QUERIES["runtime_error_count"] = _errors
ORACLE_SQL["runtime_error_count"] = "SELECT 'runtime_error_partial' AS program, CAST(count(*) AS BIGINT) AS errors FROM orders WHERE o_orderpriority <> '1-URGENT'"
_query(
    "decorator", events, "counter c by type\ndef stamped {\n  /^(?P<date>\\S+ \\S+) \\[\\d+\\] (?P<type>\\S+)/ {\n    strptime($date, \"2006/01/02 15:04:05\")\n    next\n  }\n}\n@stamped {\n  / k=\\d*5 / {\n    c[$type]++\n  }\n}\n", _ints,
    f"SELECT 'c' AS name, {GROUPS}, CAST(count(*) AS BIGINT) AS value FROM events WHERE {K} % 10 = 5 GROUP BY event_type",
)
_query(
    "const_pattern", events, "counter c by type\nconst TYPE /\\] (?P<type>\\S+) /\nconst REST /value=\\S+ k=\\d+/\n// + TYPE + REST {\n  c[$type]++\n}\n", _ints,
    f"SELECT 'c' AS name, {GROUPS}, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY event_type",
)
_query("re2_posix_class", documents, "counter c\n/^[[:upper:]][[:alpha:]]+[[:space:]][[:lower:]]+/ {\n  c++\n}\n", _ints, "SELECT 'c' AS name, '' AS k1, '' AS k2, CAST(count(*) FILTER (regexp_matches(line, '^[[:upper:]][[:alpha:]]+[[:space:]][[:lower:]]+')) AS BIGINT) AS value FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
_query("re2_dollar", documents, "counter c\n/[a-z]\\.$/ {\n  c++\n}\n", _ints, "SELECT 'c' AS name, '' AS k1, '' AS k2, CAST(count(*) FILTER (regexp_matches(line, '[a-z]\\.$')) AS BIGINT) AS value FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
_query("re2_word", documents, "counter c\n/\\bthe\\b.\\w+,\\s/ {\n  c++\n}\n", _ints, "SELECT 'c' AS name, '' AS k1, '' AS k2, CAST(count(*) FILTER (regexp_matches(line, '\\bthe\\b.\\w+,\\s')) AS BIGINT) AS value FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
_query(
    "multi_program_union", events, {"one": "counter c by type\n/\\] (?P<type>\\S+) / {\n  c[$type]++\n}\n", "two": "counter n\n/ k=9/ {\n  n++\n}\n"}, _ints,
    f"SELECT 'c' AS name, {GROUPS}, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY event_type UNION ALL SELECT 'n', '', '', CAST(count(*) AS BIGINT) FROM events WHERE left({K}::VARCHAR, 1) = '9'",
)
_BY_TYPE = PROGRAMS["counter_by_label"]
_TEXT = "SELECT {line} AS line FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)"
_query(
    "prometheus_text", events, _BY_TYPE, lambda s: sinks.prometheus(s, False).where("part = 1").select("line"), _TEXT.format(line="'events_total{type=\"' || event_type || '\"} ' || n")
)
_query("varz_text", events, {"p": _BY_TYPE}, lambda s: sinks.varz(s, "host"), _TEXT.format(line="'events_total{type=' || event_type || ',prog=p,instance=host} ' || n"))
_query("graphite_text", events, {"p": _BY_TYPE}, sinks.graphite, _TEXT.format(line="'p.events_total.type.' || event_type || ' ' || n || ' 1717200000'"))
_query("statsd_text", events, {"p": _BY_TYPE}, sinks.statsd, _TEXT.format(line="'p.events_total.type.' || event_type || ':' || n || '|c'"))
_query("collectd_text", events, {"p": _BY_TYPE}, lambda s: sinks.collectd(s, "host"), _TEXT.format(line="'PUTVAL \"host/metricloom-p/counter-events_total-type-' || event_type || '\" interval=60 1717200000:' || n"))
_query(
    "json_store", events, {"p": "counter lines_total\n/$/ {\n  lines_total++\n}\n"}, lambda s: sinks.json_cells(s).select("line"),
    "SELECT '{\"Name\":\"lines_total\",\"Program\":\"p\",\"Kind\":1,\"Type\":0,\"LabelValues\":[{\"Value\":{\"Value\":' || count(*) || ',\"Time\":1717200000000000000}}],\"Source\":\"p:1:9-19\"}' AS line FROM events",
)
_query(
    "histogram_cumulative", events, "histogram h buckets 10, 50, 90\n/ k=(?P<k>\\d+) / {\n  h = $k\n}\n", lambda s: sinks.prometheus(s, False).where("part = 1 and line like '%bucket%'").select("line"),
    f"SELECT 'h_bucket{{le=\"' || le || '\"}} ' || n AS line FROM (SELECT '10' AS le, count(*) FILTER ({K} <= 10) AS n FROM events UNION ALL SELECT '50', count(*) FILTER ({K} <= 50) FROM events UNION ALL SELECT '90', count(*) FILTER ({K} <= 90) FROM events UNION ALL SELECT '+Inf', count(*) FROM events)",
)


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{path or tempfile.mkdtemp(prefix='metricloom-logs-')}/logs-{uuid.uuid4().hex}"


def _files(spark: SparkSession, sf_dir: str, patterns: list[str], ignore: str | None = None) -> DataFrame:
    """The lines of `orders`, written as text files (a folder for each status, in order) and read again."""
    path = _folder(spark)
    lines = orders(spark, sf_dir)
    for s in "FOP":
        own = lines.where(F.col("filename").endswith(f".{s}"))
        own.repartitionByRange(2, "seq").sortWithinPartitions("seq").select("line").write.text(f"{path}/status={s}")
    return read_lines(spark, [p.format(path=path) for p in patterns], ignore)


_STATUS = "gauge last by status\ncounter n by status\n/orders\\[(?P<id>\\d+)\\].* status (?P<s>\\S+) / {\n  last[$s] = $id\n  n[$s]++\n}\n"
_STATUS_SQL = "SELECT 'n' AS name, o_orderstatus AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM orders {where} GROUP BY ALL UNION ALL SELECT 'last', o_orderstatus, '', CAST(max(o_orderkey) AS BIGINT) FROM orders {where} GROUP BY ALL"
_query("files_folder", lambda s, d: _files(s, d, ["{path}/status=F", "{path}/status=O", "{path}/status=P"]), _STATUS, _ints, _STATUS_SQL.format(where=""))
_query("files_glob", lambda s, d: _files(s, d, ["{path}/status=[FO]/part-*"]), _STATUS, _ints, _STATUS_SQL.format(where="WHERE o_orderstatus IN ('F', 'O')"))
_query("files_ignored", lambda s, d: _files(s, d, ["{path}/status=*/part-*"], r"^part-00001"), "counter n\n/$/ {\n  n++\n  getfilename() =~ /part-00001/ {\n    n += 1000000\n  }\n}\nhidden counter files by name\n/^/ {\n  files[getfilename()]++\n}\n",
       lambda s: s.where("name = 'n'").select("name", (F.col("int_value") < 1000000).alias("only_first")), "SELECT 'n' AS name, true AS only_first")
_query("quoted_name", events, "counter \"quoted\" by type\n/\\] (?P<type>\\S+) / {\n  quoted[$type]++\n}\n", _ints, f"SELECT 'quoted' AS name, {GROUPS}, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY event_type")
_query("renamed_metric", events, "counter c by type as \"hits-by-type\"\n/\\] (?P<type>\\S+) / {\n  c[$type]++\n}\n", _ints, f"SELECT 'hits-by-type' AS name, {GROUPS}, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY event_type")
_query("attribute_order", events, "histogram h buckets 10, 50, 90 by type as \"sizes\"\n/\\] (?P<type>\\S+) .* k=(?P<k>\\d+)/ {\n  h[$type] = $k\n}\n", _sums, f"SELECT 'sizes' AS name, event_type AS k1, CAST(count(*) AS BIGINT) AS n, round(CAST(sum({K}) AS DOUBLE), 2) AS total FROM events GROUP BY event_type")
_query("declared_inside", events, "/\\] (?P<type>\\S+) / {\n  counter inner by type\n  inner[$type]++\n}\n", _ints, f"SELECT 'inner' AS name, {GROUPS}, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY event_type")
_query("float_mod", events, "gauge r\n" + VALUE + " {\n  r += $value % 7.5\n}\n", _floats, "SELECT 'r' AS name, '' AS k1, '' AS k2, round(sum(value % 7.5), 2) AS value FROM events")
_query("float_pow", events, "gauge r\n" + VALUE + " {\n  r += $value ** 0.5\n}\n", _floats, "SELECT 'r' AS name, '' AS k1, '' AS k2, round(sum(sqrt(value)), 2) AS value FROM events")
_query("string_append", events, "text trail by user\n/\\[(?P<user>\\d+)\\] (?P<type>\\S+) / {\n  trail[$user] += $type\n}\n", _texts, "SELECT 'trail' AS name, CAST(user_id AS VARCHAR) AS k1, '' AS k2, string_agg(event_type, '' ORDER BY event_id) AS value FROM events GROUP BY user_id")
_query("bool_condition", events, "counter odd\n/ k=(?P<k>\\d+) / {\n  bool($k % 2) {\n    odd++\n  }\n}\n", _ints, f"SELECT 'odd' AS name, '' AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM events WHERE {K} % 2 = 1")
_query("string_of_float", events, "counter c by v\n" + VALUE + " {\n  $value < 10.0 {\n    c[string($value)]++\n  }\n}\n", _ints, "SELECT 'c' AS name, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM events WHERE value < 10 GROUP BY ALL")
_query("decrement", events, "gauge g by type\n/\\] (?P<type>\\S+) .* k=(?P<k>\\d+)/ {\n  $k < 30 {\n    g[$type]--\n  } else {\n    g[$type]++\n  }\n}\n", _ints, f"SELECT 'g' AS name, {GROUPS}, CAST(sum(CASE WHEN {K} < 30 THEN -1 ELSE 1 END) AS BIGINT) AS value FROM events GROUP BY event_type")


def _dated(pattern: str) -> Callable[[SparkSession, str], DataFrame]:
    """Lines that begin with the event's time in a pattern, then its type and id."""

    def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = F.concat(*(F.lpad(_time("ts", "d"), 2, " ") if part == "_2" else _time("ts", part) for part in pattern.split("|")))
        line = F.concat(at, F.lit(" "), "event_type", F.lit(" "), F.col("event_id").cast("string"))
        return _table(spark, sf_dir, "events").select(F.lit("dated.log").alias("filename"), line.alias("line"), F.col("event_id").alias("seq"))

    return lines


def _stamped(name: str, pattern: str, matched: str, layout: str, epoch: str, options: Options = OPTIONS) -> None:
    program = f"counter seen by type\n/^(?P<date>{matched}) (?P<type>[a-z_]+) \\d+$/ {{\n  strptime($date, \"{layout}\")\n  seen[$type]++\n}}\n"
    _query(name, _dated(pattern), program, _stamps, f"SELECT 'seen' AS name, event_type AS k1, CAST(arg_max({epoch}, event_id) AS BIGINT) AS at FROM events GROUP BY event_type", options)


_SECONDS = "epoch(date_trunc('second', ts))"
_stamped("layout_apache", "dd/MMM/yyyy:HH:mm:ss '+0200'", "\\S+ \\+\\d+", "02/Jan/2006:15:04:05 -0700", f"{_SECONDS} - 7200")
_stamped("layout_padded_day", "yyyy |MMM |_2| HH:mm:ss.SSS", ".{24}", "2006 Jan _2 15:04:05.000", _SECONDS)
_stamped("layout_without_year", "MMM |_2| HH:mm:ss", ".{15}", "Jan _2 15:04:05", "epoch(make_timestamp(2024, month(ts), day(ts), hour(ts), minute(ts), second(ts)::DOUBLE)) - (second(ts)::DOUBLE - floor(second(ts)::DOUBLE))")
_stamped("other_timezone", "yyyy-MM-dd HH:mm:ss", "\\S+ \\S+", "2006-01-02 15:04:05", f"{_SECONDS} - 19800", Options(year=2024, now=NOW, zone="Asia/Kolkata"))

_DOC_LINES = "(SELECT unnest(string_split(text, chr(10))) AS line FROM documents)"
for _name, _pattern in {
    "re2_ungreedy": r"(?U)^\w+ \w+[.,]",
    "re2_class_bracket": r"[[|]\s?[A-Z]",
    "re2_unicode_class": r"^\p{Lu}\pL*[\x{e0}-\x{ff}]\pL*\b",
    "re2_quoted": r"\Q. \E[A-Z]\w+",
    "re2_fold": r"(?i)\bTHE (?P<next_word>[a-m]\w*)",
}.items():
    _query(_name, documents, "counter c\n/" + _pattern + "/ {\n  c++\n}\n", _ints, f"SELECT 'c' AS name, '' AS k1, '' AS k2, CAST(count(*) AS BIGINT) AS value FROM {_DOC_LINES} WHERE regexp_matches(line, '{_pattern}')")

_HISTOGRAM = "histogram h by type buckets 10, 50, 90\n/\\] (?P<type>\\S+) .* k=(?P<k>\\d+)/ {\n  h[$type] = $k\n}\n"
_HIST_ROWS = f"(SELECT event_type AS t, count(*) FILTER ({K} <= 10) AS a, count(*) FILTER ({K} <= 50) AS b, count(*) FILTER ({K} <= 90) AS c, count(*) AS n, CAST(sum({K}) AS BIGINT) AS total FROM events GROUP BY event_type)"
#: A whole number as the formats write a float (below 10 ** 21).
_G = "CASE WHEN {x} >= 1000000 THEN regexp_replace(rtrim(rtrim(left({x}::VARCHAR, 1) || '.' || substr({x}::VARCHAR, 2), '0'), '.') || 'e+' || lpad((length({x}::VARCHAR) - 1)::VARCHAR, 2, '0'), ' ', '') ELSE {x}::VARCHAR END"
_query(
    "prometheus_document", events, {"p": _HISTOGRAM}, lambda s: sinks.prometheus(s, False).select("line"),
    f"""SELECT unnest(['h_bucket{{type="' || t || '",le="10"}} ' || a, 'h_bucket{{type="' || t || '",le="50"}} ' || b, 'h_bucket{{type="' || t || '",le="90"}} ' || c, 'h_bucket{{type="' || t || '",le="+Inf"}} ' || n,
      'h_sum{{type="' || t || '"}} ' || {_G.format(x="total")}, 'h_count{{type="' || t || '"}} ' || n]) AS line FROM {_HIST_ROWS}
    UNION ALL SELECT unnest(['# HELP h defined at p:1:11', '# TYPE h histogram'])""",
)
_query(
    "graphite_histogram", events, {"p": _HISTOGRAM}, sinks.graphite,
    f"""SELECT unnest(['p.h.type.' || t || ' ' || {_G.format(x="total")} || ' 1717200000', 'p.h.type.' || t || '.bin_10 ' || a || ' 1717200000', 'p.h.type.' || t || '.bin_50 ' || (b - a) || ' 1717200000',
      'p.h.type.' || t || '.bin_90 ' || (c - b) || ' 1717200000', 'p.h.type.' || t || '.bin_inf ' || (n - c) || ' 1717200000', 'p.h.type.' || t || '.count ' || n || ' 1717200000']) AS line FROM {_HIST_ROWS}""",
)
_query(
    "json_histogram", events, {"p": _HISTOGRAM}, lambda s: sinks.json_cells(s).select(F.explode(F.from_json("line", "LabelValues array<struct<Labels array<string>, Value struct<Buckets map<string, bigint>, Count bigint, Sum double>>>")["LabelValues"]).alias("x")).select(F.col("x.Labels")[0].alias("k1"), *(F.col("x.Value.Buckets")[k].alias(c) for k, c in (("10", "a"), ("50", "b"), ("90", "c"), ("+Inf", "d"))), F.col("x.Value.Count").alias("n"), F.col("x.Value.Sum").alias("total")),
    f"SELECT t AS k1, CAST(a AS BIGINT) AS a, CAST(b - a AS BIGINT) AS b, CAST(c - b AS BIGINT) AS c, CAST(n - c AS BIGINT) AS d, CAST(n AS BIGINT) AS n, CAST(total AS DOUBLE) AS total FROM {_HIST_ROWS}",
)

_query(
    "wrapping_sum", events, "counter w by type\n/\\] (?P<type>\\S+) .* k=(?P<k>\\d+)/ {\n  w[$type] += 4611686018427387904 + $k\n}\n", _ints,
    f"SELECT 'w' AS name, event_type AS k1, '' AS k2, CAST((s + 9223372036854775808) % 18446744073709551616 - 9223372036854775808 AS BIGINT) AS value FROM (SELECT event_type, sum(4611686018427387904 + {K}::HUGEINT) AS s FROM events GROUP BY event_type)",
)

_PRIORITY = "counter n by p\ngauge spent by p\n/total (?P<t>\\d+\\.\\d+) priority (?P<p>.*)$/ {\n  n[$p]++\n  spent[$p] += $t\n}\n"
_PRIORITY_SQL = "SELECT {name} AS name, o_orderpriority AS k1, '' AS k2, {value} AS value FROM orders GROUP BY ALL"


def _former(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one status after the others: each run goes on from the store of the one before."""
    store, lines = None, orders(spark, sf_dir)
    for s in "FOP":
        store = run(lines.where(F.col("filename").endswith(f".{s}")), {"p": _PRIORITY}, OPTIONS, store).store
    return store.select("name", _key(0), _key(1), F.round(F.coalesce(F.col("int_value").cast("double"), "float_value"), 2).alias("value"))


QUERIES["former_store"] = _former
ORACLE_SQL["former_store"] = f"{_PRIORITY_SQL.format(name=repr('n'), value='CAST(count(*) AS DOUBLE)')} UNION ALL {_PRIORITY_SQL.format(name=repr('spent'), value='round(sum(o_totalprice), 2)')}"


def _arriving(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The lines of `orders` as a stream of three files, one for each batch."""
    orders(spark, sf_dir).repartition(3, "seq").write.parquet(f"{folder}/in")
    return spark.readStream.schema("filename string, line string, seq bigint").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _stream_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    stream = StoreStream(spark, {"p": PROGRAMS["match_op"]}, f"{folder}/store", OPTIONS)
    stream.start(_arriving(spark, sf_dir, folder), f"{folder}/checkpoint").awaitTermination()
    return _ints(stream.latest())


def _stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, name = _folder(spark), f"counted_{uuid.uuid4().hex}"
    counted = counters(_arriving(spark, sf_dir, folder), {"p": PROGRAMS["match_op"]}, OPTIONS)
    writer = counted.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("name", _key(0), _key(1), F.col("value").cast("bigint").alias("value"))


QUERIES["stream_store"], ORACLE_SQL["stream_store"] = _stream_store, ORACLE_SQL["match_op"]
QUERIES["stream_counters"], ORACLE_SQL["stream_counters"] = _stream_counters, ORACLE_SQL["match_op"]
