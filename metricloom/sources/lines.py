"""Lines from files: (filename, line, seq)."""

from __future__ import annotations

import os
import re
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000  # blocks of files; with more, their numbers are joined
LINES = "filename string, line string, seq bigint"


def plain_path(pattern: str) -> str:
    """A path or file:// address as a path; other schemes that Spark reads stay."""
    return pattern.removeprefix("file://") if pattern.startswith("file://") else pattern


def read_lines(spark: SparkSession, patterns: list[str], ignore: str | None = None, batch_seq: bool = True) -> DataFrame:
    """All lines of the files that the glob patterns name, in order of path, then place in the file.

    A line ends at a newline, of which one carriage return before it is a part; a last line without
    one counts.  ignore: a pattern for base names to leave out.  Directories are left out."""
    raw = spark.read.option("lineSep", "\n").text([plain_path(p) for p in patterns])
    rows = raw.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("filename"), F.regexp_replace("value", r"\r\z", "").alias("line"), F.col("_metadata.file_path").alias("_p"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    if ignore:
        rows = rows.where(~F.element_at(F.split("filename", "/"), -1).rlike(ignore))
    rows = rows.drop("_p")
    return with_order(rows) if batch_seq else rows


def with_order(rows: DataFrame) -> DataFrame:
    """seq: rises with path, block and place; each part of the id is kept, so no sort is needed.

    Files are numbered by path in one small aggregate; within a file, the reader's row ids rise."""
    starts = rows.groupBy("filename", "_b").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("filename", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("filename").alias("_f"), F.col("_b").alias("_block"), "_first", "_base").persist()
    small = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    return rows.join(small, (F.col("filename") == F.col("_f")) & (F.col("_b") == F.col("_block"))).select("filename", "line", (F.col("_base") + F.col("_m") - F.col("_first")).alias("seq"))


def from_text(spark: SparkSession, text: str | bytes, filename: str = "-") -> DataFrame:
    """Lines of a text at hand (standard input, a test)."""
    body = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
    parts = body.split("\n")
    if parts and parts[-1] == "":
        parts.pop()
    return spark.createDataFrame([(filename, p.removesuffix("\r"), i) for i, p in enumerate(parts)], LINES)


def from_stdin(spark: SparkSession) -> DataFrame:
    return from_text(spark, sys.stdin.buffer.read(), "-")


def load_programs(path: str, suffix: str = ".loom") -> dict[str, str]:
    """name: text of a program file, or of a folder's files with that suffix (hidden files are left out)."""
    if os.path.isfile(path):
        return {os.path.basename(path): open(path).read()}
    names = sorted(n for n in os.listdir(path) if n.endswith(suffix) and not n.startswith(".") and os.path.isfile(os.path.join(path, n)))
    return {n: open(os.path.join(path, n)).read() for n in names}


def ignored(name: str, pattern: str | None) -> bool:
    return bool(pattern and re.search(pattern, os.path.basename(name)))
