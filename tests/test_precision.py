import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidewarden.functions.mantissa import truncate_mantissa
from tidewarden.functions.tiers import PrecisionTier
from tidewarden.functions.timeline import DAY
from tidewarden.operators.precision import apply_precision, part_precision, precision_report


def mask(x: float, bits: int) -> float:
    if bits >= 53 or x == 0 or math.isnan(x) or math.isinf(x):
        return x
    raw = struct.unpack("<Q", struct.pack("<d", x))[0]
    drop = 53 - bits
    return struct.unpack("<d", struct.pack("<Q", raw >> drop << drop))[0]


@pytest.fixture(scope="module")
def doubles(spark):
    rnd = random.Random(7)
    values = [rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-290, 290) for _ in range(2000)]
    values += [2.0**e for e in range(-1000, 1000, 7)] + [math.nextafter(2.0**e, 0) for e in range(-1000, 1000, 7)]
    values += [0.0, -0.0, float("inf"), float("-inf"), 1.0, -1.0, 3.0, 0.1, 1.7976931348623157e308]
    return spark.createDataFrame([(v,) for v in values], "v double").cache()


@pytest.mark.parametrize("bits", [1, 8, 16, 32, 52, 53, 63])
def test_truncation_is_bit_masking(doubles, bits):
    for r in doubles.select("v", truncate_mantissa(F.col("v"), bits).alias("t")).collect():
        assert r["t"] == mask(r["v"], bits), r


def test_truncation_composes_and_repeats(doubles):
    v = F.col("v")
    once, twice = truncate_mantissa(v, 16), truncate_mantissa(truncate_mantissa(v, 16), 16)
    via = truncate_mantissa(truncate_mantissa(v, 32), 16)
    assert doubles.filter((once != twice) | (once != via)).count() == 0


def test_nan_and_null_pass(spark):
    rows = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(truncate_mantissa(F.col("v"), 8).alias("t")).collect()
    assert math.isnan(rows[0]["t"]) and rows[1]["t"] is None


@pytest.mark.parametrize("bits", [0, 64])
def test_bits_range(bits):
    with pytest.raises(ValueError):
        truncate_mantissa(F.lit(1.0), bits)


def test_part_takes_fewest_bits_in_any_order(samples):
    df = samples([("t", "m", 1, d * 86_400 + 60, 1 / 3) for d in range(30)])
    tiers = [PrecisionTier(7 * DAY, 32), PrecisionTier(14 * DAY, 16), PrecisionTier(20 * DAY, 24)]
    as_of = 1_704_067_200_000_000 + 30 * DAY
    a = {r["dt"]: r["bits"] for r in part_precision(df, tiers, as_of).collect()}
    b = {r["dt"]: r["bits"] for r in part_precision(df, tiers[::-1], as_of).collect()}
    assert a == b
    bits = [a[k] for k in sorted(a)]
    # Ages run from just under 30 days down to just under 1 day.
    assert bits == [16] * 16 + [32] * 7 + [None] * 7
    kept = {r["arrival_seq"]: r["value"] for r in apply_precision(df, tiers, as_of).collect()}
    assert kept[0] == mask(1 / 3, 16) and kept[20] == mask(1 / 3, 32) and kept[29] == 1 / 3


def test_report_counts(samples):
    df = samples([("t", "m", 1, i, 1.0 + i / 64) for i in range(64)])
    (row,) = precision_report(df, [PrecisionTier(0, 3)], 1_704_067_200_000_000 + DAY).collect()
    assert (row["n_rows"], row["distinct_before"], row["distinct_after"]) == (64, 64, 4)
    assert 0 < row["mean_rel_error"] < row["max_rel_error"] < 0.25
