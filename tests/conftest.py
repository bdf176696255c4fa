from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


EVENT = "struct<event_type:string,trigger:string,arguments:array<struct<role:string,argument:string>>>"


def event(kind, *args, trigger=None):
    """An event tuple of a type and (role, argument) pairs."""
    return (kind, trigger, list(args) if args != (None,) else None)


def results(spark, rows):
    """(result_id, ground_truth, prediction) rows."""
    return spark.createDataFrame(rows, f"result_id bigint, ground_truth array<{EVENT}>, prediction array<{EVENT}>")
