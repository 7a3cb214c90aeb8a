import random

import pytest
from pyspark.sql import functions as F

from tidewarden.operators.scan import previous_value, running_total, spread


def table(spark, points, n=2000, seed=1):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice(["a", None]), rnd.choice(points), i, rnd.randrange(5)) for i in range(n)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, t long, seq long, v long")


@pytest.mark.parametrize("rows_per_task", [None, 90])
@pytest.mark.parametrize("points", [range(100_000), [7], [1, 1, 1, 1, 2, 3, 900]], ids=["spread", "one instant", "crowded"])
def test_running_total_and_previous(spark, points, rows_per_task):
    rows, df = table(spark, list(points))
    total, before, want = {}, {}, {}
    for k, t, seq, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        total[k] = total.get(k, 0) + v
        want[seq] = (total[k], before.get(k))
        before[k] = v
    out = running_total(df, ["k"], ["t", "seq"], F.col("v"), "total", rows_per_task)
    out = previous_value(out, ["k"], ["t", "seq"], "v", "prev", rows_per_task)
    assert out.columns == [*df.columns, "total", "prev"]
    assert {r["seq"]: (r["total"], r["prev"]) for r in out.collect()} == want


def test_rows_of_one_instant_and_arrival_are_spread(spark):
    """The shipped setting is used: 200,000 rows that differ in nothing but their label."""
    df = spark.range(200_000).selectExpr("'k' AS k", "5L AS t", "0L AS seq", "id AS label", "1L AS v")
    sizes = [r["count"] for r in spread(df, ["k"], ["t", "seq"]).groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 100_000
    out = running_total(df, ["k"], ["t", "seq"], F.col("v"), "total")
    assert out.agg(F.count_distinct("total"), F.min("total"), F.max("total")).first() == (200_000, 1, 200_000)


def test_missing_times_maps_and_no_rows(spark):
    df = spark.createDataFrame([("k", None, 1, 1, {"a": "b"}), ("k", 5, 2, 10, None), (None, None, 3, 100, {})], "k string, t long, seq long, v long, m map<string,string>")
    out = running_total(df, ["k"], ["t", "seq"], F.col("v"), "total")
    assert {r["seq"]: r["total"] for r in out.collect()} == {1: 1, 2: 11, 3: 100}
    assert running_total(df.limit(0), ["k"], ["t", "seq"], F.col("v"), "total").count() == 0
