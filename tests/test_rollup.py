import random

import pytest
from pyspark.sql import functions as F

from tidewarden.functions.tiers import RollupTier
from tidewarden.functions.timeline import DAY, HOUR, MINUTE
from tidewarden.operators.rollup import as_state, downsample, finish, merge_rollup, with_tier

START = 1_704_067_200_000_000
AS_OF = START + 20 * DAY + 11 * MINUTE


@pytest.fixture
def month(samples):
    rnd = random.Random(3)
    return samples([(f"t{rnd.randrange(2)}", rnd.choice("ab"), rnd.randrange(3), rnd.randrange(20 * 86_400), rnd.randrange(1000) / 8) for _ in range(3000)]).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_tier_order_does_not_matter(month):
    tiers = [RollupTier(DAY, 5 * MINUTE), RollupTier(7 * DAY, HOUR, "avg"), RollupTier(3 * DAY, 30 * MINUTE, "sum")]
    assert rows(downsample(month, tiers, AS_OF)) == rows(downsample(month, tiers[::-1], AS_OF))


def test_coarsest_tier_wins_and_young_rows_stay_raw(samples):
    tiers = [RollupTier(DAY, HOUR), RollupTier(2 * DAY, MINUTE)]
    df = samples([("t", "m", 1, 0, 1), ("t", "m", 1, 19 * 86_400 + 600, 2), ("t", "m", 1, 19 * 86_400 + 700, 2)])
    got = {r["arrival_seq"]: r["resolution_us"] for r in with_tier(df, tiers, AS_OF).collect()}
    # The older tier is the finer one: the widest interval still wins. Age must exceed the tier's.
    assert got == {0: HOUR, 1: HOUR, 2: 0}


def test_equal_ages_are_rejected(month):
    with pytest.raises(ValueError):
        downsample(month, [RollupTier(DAY, HOUR), RollupTier(DAY, MINUTE)], AS_OF)


def test_ties_take_the_last_arrival(samples):
    df = samples([("t", "m", 1, 5, v) for v in (3, 9, 4)])
    value = lambda agg: downsample(df, [RollupTier(0, HOUR, agg)], AS_OF).collect()[0]["value"]
    assert (value(None), value("last"), value("first"), value("count"), value("avg")) == (4, 4, 3, 3, 16 / 3)


def test_unset_tiers_change_nothing(month):
    assert downsample(month, [], AS_OF).count() == month.count()


TIERS = [RollupTier(DAY, 30 * MINUTE), RollupTier(7 * DAY, 4 * HOUR)]
KEYS = ("tenant", "metric")


def test_progressive_merge_equals_one_merge(month):
    state = as_state(month, KEYS)
    stepwise = merge_rollup(merge_rollup(state, TIERS[:1], AS_OF - 9 * DAY, KEYS), TIERS, AS_OF - 3 * DAY, KEYS)
    once = merge_rollup(state, TIERS, AS_OF, KEYS)
    again = merge_rollup(merge_rollup(stepwise, TIERS, AS_OF, KEYS), TIERS, AS_OF, KEYS)
    assert rows(again.select(*once.columns)) == rows(once)
    assert once.agg(F.sum("n")).first()[0] == 3000


@pytest.mark.parametrize("agg", ["last", "first", "min", "max", "sum", "avg", "count"])
def test_finished_state_equals_direct_rollup(month, agg):
    # With an as-of on a bucket edge the snapped and the plain cut-off are the same.
    as_of = START + 20 * DAY
    tiers = [RollupTier(t.after_us, t.interval_us, agg) for t in TIERS]
    merged = finish(merge_rollup(as_state(month, KEYS), tiers, as_of, KEYS), agg, KEYS)
    direct = downsample(month, tiers, as_of, KEYS)
    if agg == "count":
        merged, direct = (d.filter("resolution_us > 0") for d in (merged, direct))
    r = lambda d: rows(d.select(*KEYS, "ts", F.round("value", 9).alias("v"), "resolution_us"))
    assert r(merged) == r(direct)


def test_intervals_must_nest(month):
    with pytest.raises(ValueError):
        merge_rollup(as_state(month), [RollupTier(DAY, 7 * MINUTE), RollupTier(2 * DAY, HOUR)], AS_OF)
