import pytest
from pyspark.sql import functions as F

from tidewarden.functions.units import duration_us, quantity_bytes

H = 3_600_000_000

DURATIONS = [
    ("0", 0), ("720h", 720 * H), ("720h0m0s", 720 * H), ("-1h", -H), ("1.5h", H * 3 // 2), ("+1m30s", 90_000_000),
    ("250ms", 250_000), ("7us", 7), ("7µs", 7), ("1ns", 1), ("-1ns", -1), (".5s", 500_000), ("1h2m3.004005s", 3_723_004_005), (None, None),
]
QUANTITIES = [
    ("500Gi", 536_870_912_000), ("50Mi", 52_428_800), ("1Gi", 1_073_741_824), ("256Mi", 268_435_456), ("0", 0), ("12", 12),
    ("-1Gi", -1_073_741_824), ("1k", 1_000), ("1.5Ki", 1_536), ("100m", 1), ("-100m", -1), ("1n", 1), ("2500m", 3), ("1e3", 1_000), ("1.5E3", 1_500),
    ("2E", 2 * 10**18), ("1Ei", 2**60), ("100Ei", 2**63 - 1), ("5e-1", 1), (None, None),
]


def run(spark, texts, fn):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_durations(spark):
    assert run(spark, [t for t, _ in DURATIONS], duration_us) == [v for _, v in DURATIONS]


def test_quantities(spark):
    assert run(spark, [t for t, _ in QUANTITIES], quantity_bytes) == [v for _, v in QUANTITIES]


@pytest.mark.parametrize("text", ["1", "h", "1d", "1h 2m", "", "1h-2m"])
def test_malformed_durations(spark, text):
    assert run(spark, [text], lambda c: duration_us(c, strict=False)) == [None]
    with pytest.raises(Exception, match="not a duration"):
        run(spark, [text], duration_us)


@pytest.mark.parametrize("text", ["Gi", "1Gb", "1 Gi", "", "1Kii", "e3"])
def test_malformed_quantities(spark, text):
    assert run(spark, [text], lambda c: quantity_bytes(c, strict=False)) == [None]
    with pytest.raises(Exception, match="not a quantity"):
        run(spark, [text], quantity_bytes)
