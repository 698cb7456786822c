"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ARROW_ROWS = "1000"


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most 1000 rows: texts are long, and a batch is held whole by
    the JVM and by Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the session's checkpoint folder, so that a lost executor costs
    no more than re-reading it.  Where none is set, a temporary one is if all runs on one machine; on a
    cluster that is an error, as executors don't share such a folder."""
    spark = df.sparkSession
    _ready(spark)
    return df.checkpoint(eager=True)


def _ready(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="metricloom-"))


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, read again."""
    spark = df.sparkSession
    _ready(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
