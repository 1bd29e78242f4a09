import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    logs = tmp_path_factory.mktemp("eventlog")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", str(logs))
        .config("spark.eventLog.compress", "false")
        .config("spark.eventLog.rolling.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.event_logs = str(logs)
    yield session
    session.stop()


@pytest.fixture
def narrow(spark):
    """Cut every ordered series into many slices, some of a row or two."""
    spark.conf.set("spark.tidewatch.sliceSeconds", "20")
    spark.conf.set("spark.tidewatch.sliceNumbers", "7")
    yield
    spark.conf.unset("spark.tidewatch.sliceSeconds")
    spark.conf.unset("spark.tidewatch.sliceNumbers")
