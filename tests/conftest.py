import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tidewarden-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def samples(spark):
    """Build a sample table from (tenant, metric, user, second, value) rows."""
    from datetime import datetime, timedelta, timezone

    from pyspark.sql import functions as F

    from tidewarden.functions.hashing import series_id

    start = datetime(2024, 1, 1, tzinfo=timezone.utc)

    def build(rows, nbytes=10, signal="metrics"):
        data = [(t, signal, m, {"user": str(u)}, start + timedelta(seconds=s), float(v), i, nbytes) for i, (t, m, u, s, v) in enumerate(rows)]
        df = spark.createDataFrame(
            data, "tenant string, signal string, metric string, labels map<string,string>, ts timestamp, value double, arrival_seq long, nbytes long"
        )
        return df.withColumn("series_id", series_id(F.col("tenant"), F.col("metric"), F.col("labels")))

    return build
