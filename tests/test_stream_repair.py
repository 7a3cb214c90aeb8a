import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidewarden.functions.tiers import RollupTier
from tidewarden.functions.timeline import HOUR, MINUTE
from tidewarden.operators.replicas import dedup_replicas
from tidewarden.operators.rollup import downsample
from tidewarden.streaming.ingest import flushed, ingest_stream
from tidewarden.streaming.repair import read_repaired, repair, write_rolled, write_samples_and_dirt
from tidewarden.streaming.replicas import STORE, dedup_stream_primary


def feed(spark, tmp_path, parts, name="in"):
    """A stream with one micro-batch per part, in this order."""
    src = str(tmp_path / name)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
    return ingest_stream(spark, src, parts[0].schema, files_per_batch=1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("agg", ["last", "avg", "count"])
def test_late_rows_end_in_the_table_of_the_batch_rollup(spark, samples, tmp_path, agg):
    rnd = random.Random(8)
    df = samples([(f"t{i % 2}", "m", i % 3, rnd.randrange(80 * 3600), rnd.randrange(50)) for i in range(400)])
    df = df.unionByName(df.where("arrival_seq < 3").withColumn("ts", F.lit(None).cast("timestamp")))
    tier, delay, path = RollupTier(0, HOUR, agg), 30 * MINUTE, str(tmp_path / "out")
    stream = feed(spark, tmp_path, [df.where(f"arrival_seq % 4 = {i}") for i in range(4)])
    write_rolled(stream, path, tier, delay, str(tmp_path / "a")).awaitTermination()
    write_samples_and_dirt(stream, path, tier, delay, str(tmp_path / "b")).awaitTermination()
    want = rows(downsample(df.where("ts is not null"), [tier], 2_000_000_000_000_000).select("tenant", "metric", "series_id", "ts", "value", "resolution_us"))
    for _ in range(2):  # a repair may be repeated
        buckets = repair(spark, path, tier, delay)
        got = read_repaired(spark, path, tier, buckets)
    assert rows(got) == want
    # The stream alone had lost most of it.
    assert spark.read.parquet(f"{path}/rolled").count() < len(want)


def test_a_repair_reads_the_days_touched_only(spark, samples, tmp_path):
    early, late = samples([("t", "m", 0, i * 3600, 1.0) for i in range(240)]), samples([("t", "m", 0, 3 * 86_400 + 60, 7.0)])
    tier, delay, path = RollupTier(0, HOUR, "max"), HOUR, str(tmp_path / "out")
    write_samples_and_dirt(feed(spark, tmp_path, [early, late]), path, tier, delay, str(tmp_path / "b")).awaitTermination()
    dirty = spark.read.parquet(f"{path}/dirty").where("batch = 1")
    assert dirty.count() == 1
    # Days that are neither dirty nor open may be gone.
    write_rolled(feed(spark, tmp_path, [early], "in2"), path, tier, delay, str(tmp_path / "a")).awaitTermination()
    shutil.rmtree(f"{path}/dirty/batch=0")
    shutil.rmtree(f"{path}/raw/day=2024-01-02")
    out = read_repaired(spark, path, tier, repair(spark, path, tier, delay))
    assert [r["value"] for r in out.where("ts = timestamp'2024-01-04 00:00:00'").collect()] == [7.0]
    assert out.count() == 240


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    yield
    spark.conf.set(name, before)


def drained(stream, tmp_path):
    out = str(tmp_path / "got")
    flushed(stream.writeStream.format("parquet").outputMode("append"), str(tmp_path / "ck"), None).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def copies_of(spark, samples, seed, n=60):
    rnd = random.Random(seed)
    points = samples([("t", "m", i % 4, i * 60, float(i)) for i in range(n)]).select("tenant", F.lit(0).alias("shard"), "series_id", "ts", "value", "arrival_seq")
    spread = points.withColumn("node", F.explode(F.array(*[F.lit(f"n{k}") for k in range(3)]))).withColumn("value", F.col("value") + F.ascii(F.substring("node", 2, 1)))
    missing = [rnd.randrange(3 * n) for _ in range(n)]
    spread = spread.withColumn("k", F.col("arrival_seq") * 3 + F.ascii(F.substring("node", 2, 1)) - 48).where(~F.col("k").isin(missing)).drop("k")
    return spread, spark.createDataFrame([("t", 0, "n1")], "tenant string, shard int, node string")


def test_primary_wins_in_any_order_of_arrival(spark, samples, tmp_path, rocks):
    df, primaries = copies_of(spark, samples, 9)
    end = df.limit(1).withColumns({"series_id": F.lit("end"), "ts": F.lit("2025-01-01 00:00:00").cast("timestamp")})
    parts = [df.where(F.pmod(F.xxhash64("arrival_seq", "node"), F.lit(3)) == i) for i in range(3)] + [end]
    stream = dedup_stream_primary(feed(spark, tmp_path, parts), primaries, 24 * HOUR, slots=3)
    assert rows(drained(stream, tmp_path).where("series_id <> 'end'")) == rows(dedup_replicas(df, primaries).select(*df.columns))


def test_a_primary_goes_out_at_once_and_a_second_waits(spark, samples, tmp_path, rocks):
    df, primaries = copies_of(spark, samples, 10)
    first = df.where("node in ('n0', 'n1')")
    out = drained(dedup_stream_primary(feed(spark, tmp_path, [first]), primaries, 24 * HOUR), tmp_path)
    # The watermark has passed nothing: only the primary's copies are out.
    assert rows(out) == rows(df.where("node = 'n1'"))
