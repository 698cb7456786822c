import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def play(spark):
    """play(program, log) -> ({(name, labels): value}, errors, tiers)"""
    from metricloom.api import Options, run

    def go(program, log, tier=None, filename="filename", **options):
        parts = log.split("\n")[:-1]
        lines = spark.createDataFrame([(filename, x, i) for i, x in enumerate(parts)], "filename string, line string, seq bigint")
        programs = program if isinstance(program, dict) else {"p": program}
        result = run(lines, programs, Options(now=dt.datetime(2024, 1, 1, tzinfo=dt.UTC), year=2024, tier=tier, **options))
        cells = {}
        for r in result.store.collect():
            value = next((r[c] for c in ("int_value", "float_value", "str_value") if r[c] is not None), None)
            if r["type"] == "Buckets":
                value = ([b["count"] for b in r["buckets"]], r["hist_count"], r["hist_sum"])
            cells[r["name"], tuple(r["labels"])] = value
        errors = {r["program"]: r["errors"] for r in result.errors.collect()}
        return cells, sum(errors.values()), result

    return go
