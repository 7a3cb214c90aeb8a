import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewarden.functions.timeline import MINUTE
from tidewarden.operators import admission, kernels
from tidewarden.operators.admission import limit_in_flight, limit_rate, limit_rate_by_policy, limit_rate_from, limit_series, partial_success, series_usage
from tidewarden.operators.kernels import NEVER, admit, bucket_kernel
from tidewarden.operators.scan import spread
from tidewarden.schema import POLICIES

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
START_US = 1_704_067_200_000_000


def token_bucket(rows, rate):
    """Row by row, the definition: rows of (key, us, seq, nbytes) -> {seq: verdict}."""
    level, at, out = {}, {}, {}
    clock = lambda us: us * rate // 1_000_000
    for key, us, seq, n in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        have = min(rate, level.get(key, rate) + clock(us) - at.get(key, clock(us)))
        ok = n <= have
        level[key], at[key] = have - n if ok else have, clock(us)
        out[seq] = "accepted" if ok else "shed"
    return out


def random_rows(kind, n=1500, seed=5):
    """(key, us, seq, nbytes): one key holds most rows."""
    rnd = random.Random(seed)
    rows, us = [], START_US
    for seq in range(n):
        key = "hot" if rnd.random() < 0.8 else rnd.choice(["a", "b", None])
        us += {"calm": rnd.randrange(400_000), "overload": rnd.randrange(60_000), "ties": rnd.choice([0, 0, 0, 0, 2_000_000])}[kind]
        if kind == "overload" and seq % 500 == 0:
            us += 5_000_000
        rows.append((key, us, seq, 40 if kind == "ties" else rnd.randrange(1, 120)))
    return rows


def frame(spark, rows):
    data = [(k, START + timedelta(microseconds=us - START_US), seq, n) for k, us, seq, n in rows]
    return spark.createDataFrame(data, "tenant string, ts timestamp, arrival_seq long, nbytes long")


@pytest.mark.parametrize("kind", ["calm", "overload", "ties"])
@pytest.mark.parametrize("size", [700, 60])
def test_rate_limit_equals_row_by_row(spark, kind, size):
    rows = random_rows(kind)
    got = {r["arrival_seq"]: r["verdict"] for r in limit_rate(frame(spark, rows), 300, rows_per_task=size).collect()}
    want = token_bucket(rows, 300)
    assert got == want
    assert 0 < list(want.values()).count("shed") < len(rows)


def test_rate_limit_equal_sizes_without_a_pause(spark):
    # Equal sizes under constant overload never forget their start: the longest chain of rounds.
    rows = [("k", START_US + i * 50_003, i, 40) for i in range(1200)]
    got = {r["arrival_seq"]: r["verdict"] for r in limit_rate(frame(spark, rows), 310, rows_per_task=30).collect()}
    assert got == token_bucket(rows, 310)


def test_rate_unlimited(spark):
    assert {r["verdict"] for r in limit_rate(frame(spark, random_rows("calm", 20)), 0).collect()} == {"accepted"}


def test_equal_rows_are_spread_and_limited(spark):
    df = spark.range(6000).selectExpr("'k' AS tenant", "TIMESTAMP '2024-01-01 00:00:00' AS ts", "0L AS arrival_seq", "cast(5 AS bigint) AS nbytes", "id")
    assert limit_rate(df, 1000, rows_per_task=500).filter("verdict = 'accepted'").count() == 200
    parts = [r["count"] for r in spread(df, ["tenant"], ["ts", "arrival_seq"], 500).groupBy("_part").count().collect()]
    assert len(parts) >= 10 and max(parts) < 1500


def test_rates_of_the_policy_table(spark):
    rows = random_rows("overload")
    limits = {"hot": 300, "a": 20, "b": 0}
    policies = spark.createDataFrame([(k, None, (n, None, None, None, None), None, None, None, None, None, None) for k, n in limits.items()], POLICIES)
    got = {r["arrival_seq"]: r["verdict"] for r in limit_rate_by_policy(frame(spark, rows), policies, rows_per_task=80).collect()}
    want = {seq: "accepted" for _, _, seq, _ in rows}
    for k in ("hot", "a"):
        want |= token_bucket([r for r in rows if r[0] == k], limits[k])
    assert got == want and len({want[r[2]] for r in rows if r[0] == "a"}) == 2


def test_credit_that_is_younger_than_the_rows(spark):
    """Rows behind the credit's time count as arriving then, in the stretch they fill and in the ones after it."""
    rows = [("k", START_US + i * 100_000, i, 30) for i in range(200)]
    since = START_US + 12_000_000
    credit = spark.createDataFrame([("k", 300, since)], "tenant string, level long, since long")
    tagged, left = limit_rate_from(frame(spark, rows), credit, 300, rows_per_task=20)
    ok, level = admit(*(np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 3)), 300, since, 300)
    assert [r["verdict"] == "accepted" for r in tagged.orderBy("arrival_seq").collect()] == ok.tolist() and not ok.all()
    assert left.first()["level"] == level


def test_a_round_reads_its_own_stretches(spark, monkeypatch):
    """The first round reads all rows; later ones only the directories of stretches whose start moved."""
    rows = [("k", START_US + i * 50_003, i, 40) for i in range(600)] + [("calm", START_US + i * 5_000_000, 600 + i, 40) for i in range(600)]
    plans, counts = [], []

    def watched(chosen, *rest, **tag):
        if not tag["tag"]:
            plans.append(chosen._jdf.queryExecution().toString())
            counts.append(chosen.count())
        return real(chosen, *rest, **tag)

    real = admission._run_kernel
    monkeypatch.setattr(admission, "_run_kernel", watched)
    limit_rate(frame(spark, rows), 310, rows_per_task=50)
    assert counts[0] == 1200 and len(counts) > 2 and max(counts[1:]) <= 700 and sum(counts) < 6 * 1200
    assert all("dynamicpruning" in p for p in plans[1:])


def stretch_batch(rows, start, since, path=None, end=(None, None)):
    us, cost = (pa.array([0] + [r[i] for r in rows]) for i in (1, 3))
    n = len(rows)
    first = lambda v, t=pa.int64(): pa.array([v] + [None] * n, t)
    return pa.RecordBatch.from_pydict({
        "tenant": ["k"] * (n + 1), "_part": [0] * (n + 1), "_head": [1] + [0] * n, "_us": us, "_cost": cost, "_rate": first(300), "_level": first(start),
        "_since": first(since), "_path": first(path, pa.list_(pa.int64())), "_end_level": first(end[0]), "_end_us": first(end[1]),
    })


def test_a_stretch_stops_where_its_credit_meets_the_stored_path(monkeypatch):
    rows = random_rows("calm", 900)
    run = bucket_kernel(["tenant", "_part"], tag=False, step=10)
    full = next(iter(run([stretch_batch(rows, 300, NEVER)]))).to_pylist()[0]
    looked = []
    monkeypatch.setattr(kernels, "admit", lambda us, *rest: looked.append(len(us)) or admit(us, *rest))
    plain = next(iter(run([stretch_batch(rows, 5, START_US - 1)]))).to_pylist()[0]
    assert sum(looked) == 900
    looked.clear()
    batch = stretch_batch(rows, 5, START_US - 1, full["_path"], (full["_end_level"], full["_end_us"]))
    short = next(iter(run([batch.slice(0, 7), batch.slice(7, 600), batch.slice(607)]))).to_pylist()[0]
    assert short == plain and 0 < sum(looked) < 300


def test_kernel_can_be_cut_anywhere():
    rows = random_rows("overload", 600)
    us, cost = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 3))
    whole, end = admit(us, cost, 300, None, 300)
    for cut in (1, 7, 256, 257, 599):
        head, level = admit(us[:cut], cost[:cut], 300, None, 300)
        tail, level = admit(us[cut:], cost[cut:], level, int(us[cut - 1]), 300)
        assert np.array_equal(np.concatenate((head, tail)), whole) and level == end


@pytest.mark.parametrize("kind", ["calm", "ties"])
def test_in_flight_latches_until_the_flush(spark, kind):
    rows = random_rows(kind)
    used, want = {}, {}
    for key, us, seq, n in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        epoch = (key, us // MINUTE)
        used[epoch] = used.get(epoch, 0) + n
        want[seq] = "accepted" if used[epoch] <= 2500 else "shed"
    got = {r["arrival_seq"]: r["verdict"] for r in limit_in_flight(frame(spark, rows), 2500, MINUTE).collect()}
    assert got == want


def series_rules(rows, hard, soft):
    """The ceiling, row by row: rows of (tenant, metric, user) in arrival order."""
    rank, over, out = {}, {}, []
    for tenant, metric, user in rows:
        known = rank.setdefault(tenant, {})
        r = known.setdefault((metric, user), len(known) + 1)
        if r <= (soft or hard):
            out.append("accepted")
        elif not soft:
            out.append("shed")
        else:
            minted = over.setdefault(tenant, [])
            if metric not in minted:
                minted.append(metric)
            out.append("overflow" if soft + minted.index(metric) + 1 <= hard else "shed")
    return out


@pytest.mark.parametrize("hard,soft", [(40, None), (40, 0), (43, 40), (40, 40), (10_000, 5)])
def test_series_limits_equal_row_by_row(samples, hard, soft):
    rnd = random.Random(11)
    keys = [("hot" if rnd.random() < 0.9 else "cold", f"m{rnd.randrange(9)}", rnd.randrange(30)) for _ in range(900)]
    df = samples([(t, m, u, i, 0) for i, (t, m, u) in enumerate(keys)])
    got = {r["arrival_seq"]: r for r in limit_series(df, hard, soft).collect()}
    want = series_rules(keys, hard, soft)
    assert [got[i]["verdict"] for i in range(900)] == want
    folded = {(r["tenant"], r["metric"]): r["series_id"] for r in got.values() if r["verdict"] == "overflow"}
    assert len(set(folded.values())) == len(folded)
    assert all(r["labels"] == {"overflow": "true"} for r in got.values() if r["verdict"] == "overflow")


def test_soft_budget_is_for_metrics_only(samples):
    df = samples([("t", "m", u, u, 0) for u in range(20)], signal="logs")
    verdicts = [r["verdict"] for r in limit_series(df, 10, 5).orderBy("arrival_seq").collect()]
    assert verdicts == ["accepted"] * 10 + ["shed"] * 10


def test_no_ceiling_admits_all(samples):
    assert {r["verdict"] for r in limit_series(samples([("t", "m", u, u, 0) for u in range(5)]), 0, 3).collect()} == {"accepted"}


def test_partial_success_adds_up(samples):
    df = samples([("t", "m", u % 7, u, 0) for u in range(70)])
    out = partial_success(limit_series(df, 5).withColumn("batch", F.expr("arrival_seq div 35")))
    rows = out.collect()
    assert sum(r["accepted_rows"] + r["rejected_rows"] for r in rows) == 70
    assert sum(r["rejected_bytes"] for r in rows) == 200
    assert {r["reason"] for r in rows} == {"RESOURCE_EXHAUSTED"}


def test_usage(spark, samples):
    df = samples([("t", m, u, u, 0) for m in "ab" for u in range(6)])
    budgets = spark.createDataFrame([("t", None, (None, None, 11, 12, None), None, None, None, None, None, None)], POLICIES)
    rows = series_usage(df, budgets).collect()
    assert {(r["metric"], r["n_series"], r["tenant_series"], r["over_soft"], r["over_hard"]) for r in rows} == {("a", 6, 12, False, True), ("b", 6, 12, False, True)}
    assert [r["n_series"] for r in series_usage(df, budgets, approximate=True).collect()] == [6, 6]
