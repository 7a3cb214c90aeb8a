import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewarden.functions.tiers import RollupTier
from tidewarden.functions.timeline import HOUR, MINUTE
from tidewarden.operators.admission import limit_in_flight, limit_rate
from tidewarden.operators.kernels import admit, rate_state
from tidewarden.operators.rollup import downsample
from tidewarden.streaming.admission import limit_in_flight_stream, limit_rate_stream, write_rate_limited
from tidewarden.streaming.aggregates import dedup_stream, latest_heartbeats_stream, rollup_stream
from tidewarden.streaming.ingest import flushed, ingest_stream, read_updates, write_samples, write_signal_stream, write_updates

FAR = 1_704_067_200_000_000 + 10_000 * HOUR


@pytest.fixture
def feed(spark, samples, tmp_path):
    """The rows as a batch, and as a stream that takes them in five micro-batches, in time order."""
    rnd = random.Random(6)
    n = 400
    df = samples([(f"t{rnd.randrange(3)}", "m", rnd.randrange(4), i * 30 + rnd.randrange(30), rnd.random()) for i in range(n)], nbytes=40).cache()
    src = tmp_path / "in"
    for i in range(5):
        df.filter(f"arrival_seq div {n // 5} = {i}").coalesce(1).write.mode("append").parquet(str(src))
    return df, ingest_stream(spark, str(src), df.schema, files_per_batch=1)


def drain(stream, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    flushed(stream.writeStream.format("parquet").outputMode(mode), str(tmp_path / "ck"), None).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ingest_equals_batch(spark, feed, tmp_path):
    df, stream = feed
    write_samples(stream, str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    cols = ["tenant", "series_id", "ts", "value", "arrival_seq"]
    assert rows(spark.read.parquet(str(tmp_path / "t")).select(cols)) == rows(df.select(cols))


def test_flush_interval(feed):
    _, stream = feed
    with pytest.raises(ValueError):
        flushed(stream.writeStream, "x", 0)


@pytest.mark.parametrize("agg", ["last", "avg"])
def test_rollup_equals_batch(feed, tmp_path, agg):
    df, stream = feed
    tier = RollupTier(0, 10 * MINUTE, agg)
    got = drain(rollup_stream(stream, tier, 5 * MINUTE), tmp_path)
    closed = df.agg(F.max("ts")).first()[0]
    want = downsample(df, [tier], FAR).filter(F.col("ts") + F.expr("INTERVAL 10 MINUTES") <= F.lit(closed) - F.expr("INTERVAL 5 MINUTES"))
    fix = lambda d: rows(d.select("tenant", "series_id", "ts", F.round("value", 9)))
    assert fix(got) == fix(want) and got.count() > 20


def test_dedup(feed, tmp_path):
    df, stream = feed
    three = stream.select("series_id", "ts", F.explode(F.expr("array(1, 2, 3)")).alias("copy"))
    assert rows(drain(dedup_stream(three, HOUR).select("series_id", "ts"), tmp_path)) == rows(df.select("series_id", "ts").distinct())


def test_rate_limit_equals_batch(feed, tmp_path):
    df, stream = feed
    fast = lambda d: d.select("tenant", F.timestamp_micros(F.expr("unix_micros(ts) div 100")).alias("ts"), "arrival_seq", "nbytes")
    got = drain(limit_rate_stream(fast(stream), 60), tmp_path)
    want = limit_rate(fast(df), 60)
    assert rows(got) == rows(want)
    assert 0 < got.filter("verdict = 'shed'").count() < 400


def test_sliced_rate_limit_equals_batch(spark, feed, tmp_path):
    df, stream = feed
    fast = lambda d: d.select("tenant", F.timestamp_micros(F.expr("unix_micros(ts) div 100")).alias("ts"), "arrival_seq", "nbytes")
    write_rate_limited(fast(stream), str(tmp_path / "r"), 60, str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "r" / "rows")).drop("batch")
    assert rows(got) == rows(limit_rate(fast(df), 60))


def test_late_rows_refill_nothing():
    ok, level = admit(np.array([0, 500_000]), np.array([10, 50]), 20, 2_000_000, 100)
    assert list(ok) == [True, False] and level == 10


def test_in_flight_equals_batch(feed, tmp_path):
    df, stream = feed
    cols = ["tenant", "ts", "arrival_seq", "nbytes"]
    got = drain(limit_in_flight_stream(stream.select(cols), 700, 20 * MINUTE), tmp_path)
    want = limit_in_flight(df.select(cols), 700, 20 * MINUTE).drop("epoch")
    assert rows(got) == rows(want.select(got.columns))
    assert 0 < got.filter("verdict = 'shed'").count() < 400


def test_signal_fan_out(spark, feed, tmp_path):
    _, stream = feed
    mixed = stream.withColumn("signal", F.expr("CASE WHEN arrival_seq % 2 = 0 THEN 'logs' ELSE 'metrics' END"))
    write_signal_stream(mixed, str(tmp_path / "s"), {"logs": False}, str(tmp_path / "ck")).awaitTermination()
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and {r["signal"] for r in back.select("signal").distinct().collect()} == {"metrics"}


def test_latest_heartbeats(feed):
    df, stream = feed
    beats = stream.selectExpr("tenant AS cluster", "labels['user'] AS node", "ts", "value > 0.5 AS ready")
    query = latest_heartbeats_stream(beats).writeStream.format("memory").queryName("beats").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["cluster"], r["node"]): r["ready"] for r in df.sparkSession.table("beats").collect()}
    want = df.selectExpr("tenant", "labels['user'] AS node", "ts", "value > 0.5 AS ready").groupBy("tenant", "node").agg(F.max_by("ready", "ts").alias("r")).collect()
    assert got == {(r["tenant"], r["node"]): r["r"] for r in want}


@pytest.mark.parametrize("agg", ["last", "avg"])
def test_updates_hold_open_buckets(spark, feed, tmp_path, agg):
    df, stream = feed
    tier = RollupTier(0, 10 * MINUTE, agg)
    rolled = rollup_stream(stream, tier, 5 * MINUTE)
    write_updates(rolled, str(tmp_path / "u"), str(tmp_path / "ck")).awaitTermination()
    got = read_updates(spark, str(tmp_path / "u"), rolled.schema, ["tenant", "metric", "series_id", "ts"])
    fix = lambda d: rows(d.select("tenant", "series_id", "ts", F.round("value", 9)))
    assert fix(got) == fix(downsample(df, [tier], FAR))


def test_rows_without_time_or_size_spend_nothing(spark):
    data = [("a", None, 0, 50), ("a", 1_704_067_200_000_000, 1, None), ("a", 1_704_067_200_000_001, 2, 90), ("a", 1_704_067_200_000_002, 3, 50)]
    df = spark.createDataFrame(data, "tenant string, us long, arrival_seq long, nbytes long").withColumn("ts", F.timestamp_micros("us"))
    for out in (limit_rate(df, 100), limit_rate(df.withColumn("nbytes", F.expr("nbytes * 60000000000")), 6_000_000_000_000)):
        assert [r["verdict"] for r in out.orderBy("arrival_seq").collect()] == ["accepted", "accepted", "accepted", "shed"]


@pytest.mark.parametrize("query", ["stream_rollup", "stream_partial_success", "stream_dedup"])
def test_whole_history_in_any_order(spark, tmp_path, query):
    """Part files in no order, several micro-batches: nothing is late, nothing is left open."""
    from tidewarden.plans.queries import REGISTRY

    one = "/root/testdata/sf0.001"
    spark.read.parquet(f"{one}/events.parquet").repartition(40).write.parquet(f"{tmp_path}/events.parquet")
    got = [rows(REGISTRY[query](spark, d)) for d in (one, str(tmp_path))]
    assert got[0] == got[1] and got[0]


def test_streams_read_a_directory_table(spark, tmp_path):
    """The registered streams give the same over one file and over part files in a directory."""
    from tidewarden.plans.queries import REGISTRY

    one = "/root/testdata/sf0.001"
    spark.read.parquet(f"{one}/events.parquet").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    rows = [sorted(map(tuple, REGISTRY["stream_ingest"](spark, d).collect())) for d in (one, str(tmp_path))]
    assert rows[0] == rows[1] and sum(r[2] for r in rows[0]) == spark.read.parquet(f"{one}/events.parquet").count()


class _Credit:
    """The state of one key."""

    exists = False

    def update(self, value):
        self.get, self.exists = value, True


def _frames(n, seed):
    draw = np.random.default_rng(seed)
    us = 1_704_067_200_000_000 + draw.integers(0, 20 * n, n)
    rows = pd.DataFrame({"seq": draw.permutation(n), "_us": us, "_cost": draw.integers(1, 60, n)})
    for a in range(0, n, 1000):
        yield rows.iloc[a : a + 1000].assign(tenant=[f"tenant {i % 7}" for i in range(len(rows.iloc[a : a + 1000]))])


def test_rate_state_in_steps_is_the_whole_run():
    rows = pd.concat(_frames(5000, 1)).sort_values(["_us", "seq"])
    want, left = admit(rows["_us"].to_numpy(), rows["_cost"].to_numpy(), 100_000, None, 100_000)
    state = _Credit()
    got = pd.concat(rate_state(100_000, ["seq"], ["seq", "tenant"], step=7)(None, _frames(5000, 1), state))
    assert got["seq"].tolist() == pd.concat(_frames(5000, 1))["seq"].tolist()
    verdicts = dict(zip(got["seq"], got["verdict"] == "accepted"))
    assert [verdicts[s] for s in rows["seq"]] == want.tolist() and 0 < want.sum() < len(want)
    assert state.get == (left, int(rows["_us"].iloc[-1]))


def test_rate_state_keeps_rows_packed():
    n = 200_000
    frames, run = _frames(n, 2), rate_state(10**9, ["seq"], ["seq", "tenant"])
    tracemalloc.start()
    rows = sum(len(f) for f in run(None, frames, _Credit()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and peak < 200 * n, peak / n
