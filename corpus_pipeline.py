"""From documents to sampled pieces: each stage works on all that the one before it kept.

Each function takes (spark, docs, sf_dir) and returns a table; all but the last return the columns
of documents.  Other columns are left out, an empty table gives an empty result, and no stage cuts a
text: one of any length is worked on whole, within a task's memory (see the operators).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import jaccard_join, line_dedup, mixing, ngram_lm, pieces
from metricloom.llm.storage import bounded, cut, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model of trusted text does not reject; a null or empty text is rejected.

    A null doc_id is never trusted, a null language is one of its own, and equal rows fare alike."""
    bounded(spark)
    return ngram_lm.classify(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line is similar to.

    Lines stand in order of doc_id (null first), text, then place.  Rows equal in doc_id and text keep the
    same lines (the next stage takes all but one away).  A null text stays null."""
    bounded(spark)
    return line_dedup.dedup(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the first by doc_id, null last.

    Rows that share a doc_id, and those without one, are documents each.  Of equal rows one stays; a
    text without words is linked with nothing but its own equals."""
    bounded(spark)
    docs = docs.select(COLUMNS)
    ids = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null"))
    if ids.isEmpty():
        gone = cut(jaccard_join.join(docs).where("doc_id <> component_id").select("doc_id"))
        small = gone.count() <= jaccard_join.SENT
        return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(COLUMNS)
    # Equal rows are one; then a hash of the row is its node, and each component keeps its first row.
    nodes = written(docs.dropDuplicates().withColumn("node", F.xxhash64(*COLUMNS)))
    of = jaccard_join.join(nodes.drop("doc_id").withColumnRenamed("node", "doc_id")).select(F.col("doc_id").alias("node"), F.col("component_id").alias("component"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    first = nodes.select("node", place.alias("place")).join(of, "node").groupBy("component").agg(F.min("place").alias("place")).select("place.node")
    return nodes.join(first, "node", "left_semi").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is one of its own, a null or empty text takes no
    words.  Equal rows share their copies."""
    return mixing.mixed(docs.select(COLUMNS)).select(COLUMNS)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every row: doc_id, sample, n_pieces, a hash of the ids, scores, and whether the
    ids give the text back.  A null text counts as empty; rows of equal doc_id and text give equal samples."""
    bounded(spark)
    rows = pieces.sample(docs.select(COLUMNS))
    return rows.select("doc_id", "sample", "n_pieces", F.xxhash64("ids").alias("ids_hash"), "log_prob", "score", "inclusion", "round_trip")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("piece sampling", sample_pieces),
]

#: SQL cannot express the model, the rounding or the sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
