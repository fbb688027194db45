import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"
DAY0 = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.default.parallelism", "3")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


HISTORY_SCHEMA = (
    "entity_group string, entity string, sensor string, ts timestamp_ntz, value double, "
    "hours_since_maintenance double, operating_mode string, failure_type string, "
    "ucl double, centerline double, lcl double"
)


def reading(entity="CPR01", sensor="rpm", at=0.0, value=1.0, hours=1.0, mode="normal", failure="none",
            group="CPR", ucl=None, centerline=None, lcl=None):
    """One row of a history; `at` counts hours from the first day."""
    ts = None if at is None else DAY0 + timedelta(hours=at)
    return (group, entity, sensor, ts, value, hours, mode, failure, ucl, centerline, lcl)


@pytest.fixture
def history(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), HISTORY_SCHEMA)

    return make


def as_set(df, *columns):
    rows = (df.select(*columns) if columns else df).collect()
    return sorted((tuple(r) for r in rows), key=repr)
