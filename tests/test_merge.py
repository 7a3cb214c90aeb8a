"""The policy-driven merge: repeatable, lossless, replaced as a whole."""

import math

import pytest
from pyspark.sql import functions as F

from tidewarden.functions.tiers import RollupTier
from tidewarden.functions.timeline import DAY, HOUR
from tidewarden.operators.retention import apply_retention, apply_retention_by_policy
from tidewarden.operators.rollup import as_state, downsample, finish, merge_rollup
from tidewarden.plans.merge_job import InvalidPolicy, bit_widths, check_policies, merge_states, merged, published, read_merged, run_merge
from tidewarden.schema import POLICIES

START = 1_704_067_200_000_000
AS_OF = START + 30 * DAY
KEYS = ("tenant", "metric", "series_id")


def policy(spark, *rows):
    """(tenant, max age, rollup tiers, precision tiers) as a policy table."""
    return spark.createDataFrame([(t, (age, None), None, down, prec, None, None, None, None) for t, age, down, prec in rows], POLICIES)


@pytest.fixture
def month(samples):
    return samples([(f"t{i % 2}", "m", i % 3, 7_000 * i, i / 8) for i in range(360)])


WEEKLY = ("t0", 10 * DAY, [(DAY, 7 * DAY, "sum")], [(2 * DAY, 20)])


def table(df):
    return sorted(map(tuple, df.select("tenant", "series_id", "ts", F.round("value", 9), "resolution_us", "n", "bits").collect()), key=repr)


def test_young_samples_survive_in_a_wide_bucket(spark, month):
    policies = policy(spark, WEEKLY)
    young = month.filter("tenant = 't0'").filter(F.col("ts") >= F.timestamp_micros(F.lit(AS_OF - 10 * DAY)))
    first = merge_states(as_state(month.filter("tenant = 't0'")), policies, AS_OF)
    later = merge_states(first, policies, AS_OF + HOUR)
    assert later.agg(F.sum("n")).first()[0] == first.agg(F.sum("n")).first()[0] >= young.count()
    rows = merged(month, policies, AS_OF, bit_widths(policies))
    # Every bucket older than its tenant's precision age has bits, also where no sample fell on its first day.
    assert rows.filter("tenant = 't0' AND resolution_us > 0 AND dt < '2024-01-20' AND bits IS NULL").count() == 0


@pytest.mark.parametrize("agg", ["last", "first", "min", "max", "sum", "avg", "count"])
def test_merging_in_steps_equals_one_merge(spark, month, agg):
    policies = policy(spark, ("t0", 20 * DAY, [(DAY, HOUR, agg), (4 * DAY, 2 * DAY, agg)], [(6 * DAY, 24)]), ("t1", None, [(DAY, HOUR, agg)], None))
    states = as_state(month)
    once = merge_states(states, policies, AS_OF)
    steps = states
    for as_of in (AS_OF - 9 * DAY - 5, AS_OF - 2 * DAY, AS_OF, AS_OF):
        steps = merge_states(steps, policies, as_of)
    shown = [table(published(x, policies, AS_OF, [24])) for x in (once, steps)]
    assert shown[0] == shown[1]


def test_a_rerun_and_a_second_merge_replace_the_table(spark, month, tmp_path):
    policies = policy(spark, WEEKLY, ("t1", None, [(DAY, HOUR, "avg")], None))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    run_merge(month, policies, AS_OF - 3 * DAY, a, 4000)
    before = table(read_merged(spark, a))
    run_merge(month, policies, AS_OF - 3 * DAY, a, 4000)
    assert table(read_merged(spark, a)) == before
    run_merge(read_merged(spark, a), policies, AS_OF, b, 4000)
    states = merge_states(as_state(month), policies, AS_OF)
    assert table(read_merged(spark, b)) == table(published(states, policies, AS_OF, [20]))


@pytest.mark.parametrize("values", [[4e-10] * 10, [1.5, math.nan, 2.0], [1.0, math.inf], [math.inf, -math.inf], [1e30, 2e30, 1.0], [0.1, 1 / 3, 1e16]])
def test_sums_of_any_size_match_the_plain_rollup(samples, values):
    df, tiers = samples([("t", "m", 1, i, v) for i, v in enumerate(values)]), [RollupTier(0, HOUR, "sum")]
    plain = downsample(df, tiers, AS_OF).first()["value"]
    state = merge_rollup(merge_rollup(as_state(df), tiers, AS_OF), tiers, AS_OF)
    assert finish(state, "sum").first()["value"] == pytest.approx(plain, nan_ok=True)


def test_samples_without_a_time_stay_raw(spark, samples):
    df = samples([("t", "m", 1, 0, 1), ("t", "m", 1, 5, 2)]).withColumn("ts", F.when(F.col("value") == 1, F.col("ts")))
    policies = policy(spark, ("t", 60 * DAY, [(DAY, HOUR, "sum")], [(DAY, 8)]))
    assert downsample(df, [RollupTier(DAY, HOUR)], AS_OF).filter("ts IS NULL").count() == 1
    assert apply_retention(df, DAY, AS_OF).count() == apply_retention_by_policy(df, policy(spark, ("t", DAY, None, None)), AS_OF).count() == 1
    out = published(merge_states(as_state(df), policies, AS_OF), policies, AS_OF, [8])
    assert sorted((r["ts"] is None, r["value"]) for r in out.collect()) == [(False, 1.0), (True, 2.0)]


def test_an_empty_table_merges(spark, samples, tmp_path):
    run_merge(samples([("t0", "m", 1, 0, 1)]).limit(0), policy(spark, WEEKLY), AS_OF, str(tmp_path / "e"), 100)
    assert read_merged(spark, str(tmp_path / "e")).count() == 0


def test_intervals_that_do_not_nest_are_refused(spark):
    check_policies(policy(spark, WEEKLY, ("t1", None, [(DAY, HOUR, None), (2 * DAY, 6 * HOUR, None)], None)))
    for bad in (7 * HOUR, 36 * HOUR):
        with pytest.raises(InvalidPolicy, match="1 tenants with intervals"):
            check_policies(policy(spark, ("t0", 10 * DAY, [(DAY, bad, None)], None)))
