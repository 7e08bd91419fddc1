import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallylog.session import configure, fresh_name  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tallylog-tests-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tallylog-warehouse-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def new_store(spark):
    from tallylog.plans.log_store import LogStore

    return lambda: LogStore(spark, fresh_name("test"))


@pytest.fixture
def log_rows(spark):
    """Log rows from (id number, ISO time, service) tuples."""
    from pyspark.sql import functions as F

    from tallylog.functions.ids import uuid_from
    from tallylog.functions.timestamps import parse_iso

    def make(rows):
        frame = spark.createDataFrame(rows, "n int, time string, service string")
        return frame.select(
            uuid_from(F.col("n")).alias("id"),
            parse_iso(F.col("time")).alias("ts"),
            F.lit("info").alias("level"),
            "service",
            F.concat(F.lit("m"), "n").alias("message"),
            F.lit("{}").alias("attributes"),
            F.expr("cast(map() as map<string,string>)").alias("attr"),
        )

    return make
