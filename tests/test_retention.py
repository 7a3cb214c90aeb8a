from pyspark.sql import functions as F

from tidewarden.functions.timeline import DAY, HOUR
from tidewarden.operators.retention import apply_retention, apply_retention_by_policy, expired_partitions, retention_budget_plan, retention_overhang
from tidewarden.schema import POLICIES
from tidewarden.sources.samples import read_table

START = 1_704_067_200_000_000


def test_partitions_go_whole(samples):
    df = samples([("t", "m", 1, h * 3600, 1) for h in range(24 * 5)])
    as_of = START + 5 * DAY
    for hours in range(1, 24 * 6, 5):
        kept = {r["arrival_seq"] for r in apply_retention(df, hours * HOUR, as_of).collect()}
        # No row inside the window is lost, and days are kept or dropped as a whole.
        assert set(range(24 * 5 - hours, 24 * 5)) & set(range(24 * 5)) <= kept
        assert all({h // 24 * 24 + k for k in range(24)} <= kept for h in kept)
        dropped = expired_partitions(df, hours * HOUR, as_of).count()
        assert len(kept) == 24 * (5 - dropped)


def test_zero_and_null_keep_forever(samples):
    df = samples([("t", "m", 1, 0, 1)])
    assert apply_retention(df, None, START + 9999 * DAY).count() == apply_retention(df, 0, START + 9999 * DAY).count() == 1


def test_overhang(samples):
    df = samples([("t", "m", 1, h * 3600, 1) for h in range(24)])
    (row,) = retention_overhang(df, 10 * HOUR, START + DAY).collect()
    assert (row["n_rows"], row["n_bytes"]) == (14, 140)


def test_budget_keeps_the_newest(samples):
    df = samples([("t", "m", 1, d * 86_400, 1) for d in range(5)])
    plan = {r["dt"].day: r["would_drop"] for r in retention_budget_plan(df, 30).collect()}
    assert plan == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert not any(r["would_drop"] for r in retention_budget_plan(df, 0).collect())


def test_partition_column_is_pruned(spark, samples, tmp_path):
    df = samples([("t", "m", 1, d * 86_400, 1) for d in range(10)])
    df.selectExpr("*", "to_date(ts) AS dt").write.partitionBy("dt").parquet(str(tmp_path / "t"))
    kept = apply_retention(read_table(spark, str(tmp_path / "t")), 3 * DAY, START + 10 * DAY, dt="dt")
    assert kept.count() == 3
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "GreaterThanOrEqual(ts" in plan


def test_policies_prune_directories(spark, samples, tmp_path):
    """Young and old tenants, one without a window, rows without a tenant or a time: the same rows as without directories."""
    rows = [(t, "m", 1, h * 3600, 1) for t in ("short", "long", "free", "wide", None) for h in range(0, 24 * 12, 3)]
    df = samples(rows).withColumn("ts", F.when(F.col("arrival_seq") % 50 != 7, F.col("ts"))).withColumn("dt", F.to_date("ts"))
    windows = {"short": (2 * DAY, None), "long": (9 * DAY, None), "wide": (3 * DAY, [(DAY, 5 * DAY, "last")])}
    policies = spark.createDataFrame([(t, (age, None), None, tiers, None, None, None, None, None) for t, (age, tiers) in windows.items()], POLICIES)
    df.write.partitionBy("tenant", "dt").parquet(str(tmp_path / "t"))
    stored = spark.read.schema(df.schema).parquet(str(tmp_path / "t"))
    for width in (DAY, HOUR):
        got = apply_retention_by_policy(stored, policies, START + 12 * DAY, width, dt="dt")
        want = apply_retention_by_policy(df, policies, START + 12 * DAY, width)
        assert {r["arrival_seq"] for r in got.collect()} == {r["arrival_seq"] for r in want.collect()}
        assert got.columns == stored.columns and 100 < want.count() < df.count()
    assert "dynamicpruning" in got._jdf.queryExecution().toString()
