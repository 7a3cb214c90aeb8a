import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewarden.functions.hashing import series_id, series_id_of
from tidewarden.functions.timeline import DAY
from tidewarden.plans.merge_job import run_merge
from tidewarden.plans.inputs import tenant_policies
from tidewarden.sources.object_store import ObjectStore, object_store_conf, object_store_path
from tidewarden.sources.parts import assign_parts, recompress, write_parts
from tidewarden.sources.signals import enabled_signals, route_signals, write_signals
from tidewarden.sources.staging import shared_folder

START = 1_704_067_200_000_000


def test_object_store():
    s = ObjectStore("b", "pre/fix/", "eu", "http://minio:9000", True)
    assert object_store_path(s, "metrics", "/dt=1/") == "s3a://b/pre/fix/metrics/dt=1"
    conf = object_store_conf(s)
    assert conf["fs.s3a.bucket.b.path.style.access"] == "true" and conf["fs.s3a.bucket.b.connection.ssl.enabled"] == "false"
    assert not any("key" in k or "secret" in k for k in conf)
    assert object_store_path(ObjectStore("b")) == "s3a://b"
    with pytest.raises(ValueError):
        ObjectStore("")


@pytest.mark.parametrize("off", ["metrics", "logs", "traces", "profiles"])
def test_each_signal_off_and_alone(off):
    others = [s for s in ("metrics", "logs", "traces", "profiles") if s != off]
    assert enabled_signals({off: False}) == others
    assert enabled_signals({s: False for s in others}) == [off]


def test_no_signal_left():
    assert len(enabled_signals(None)) == 4
    with pytest.raises(ValueError):
        enabled_signals(dict.fromkeys(("metrics", "logs", "traces", "profiles"), False))


def test_signals_on_disk(spark, samples, tmp_path):
    df = samples([("t", "m", 1, i, 1) for i in range(6)]).withColumn("signal", F.expr("element_at(array('metrics','logs','traces'), cast(arrival_seq % 3 + 1 AS int))"))
    assert {k: v.count() for k, v in route_signals(df, {"logs": False}).items()} == {"metrics": 2, "traces": 2, "profiles": 0}
    write_signals(df, str(tmp_path / "s"), {"logs": False})
    assert sorted(p.name for p in (tmp_path / "s").glob("signal=*")) == ["signal=metrics", "signal=traces"]


def test_both_series_ids_agree(samples):
    df = samples([("t", "m", 7, 0, 1)])
    assert df.filter(F.col("series_id") == series_id_of(F.col("tenant"), F.col("metric"), {"user": F.lit("7")})).count() == 1
    two = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    other = series_id_of(F.lit("t"), F.lit("m"), {"b": F.lit("2"), "a": F.lit("1")})
    assert df.select((series_id(F.lit("t"), F.lit("m"), two) == other).alias("x")).first()["x"]


@pytest.fixture
def uneven(samples):
    rnd = random.Random(9)
    df = samples([("hot" if rnd.random() < 0.9 else "cold", "m", 1, rnd.randrange(3 * 86_400), 1) for _ in range(600)])
    return df.withColumn("nbytes", F.expr("arrival_seq % 37 + 1"))


def test_parts_are_bounded_and_whole(uneven):
    parts = assign_parts(uneven, 500).groupBy("tenant", "dt", "part_id").agg(F.sum("nbytes").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in parts) == 600
    # One row may pass the cap.
    assert max(r["b"] for r in parts) < 500 + 37


def test_written_parts_are_one_file_each(spark, uneven, tmp_path):
    write_parts(uneven, str(tmp_path / "p"), 500)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 600
    files = list((tmp_path / "p").glob("tenant=*/dt=*/part_id=*/*.parquet"))
    assert len(files) == back.select("tenant", "dt", "part_id").distinct().count()


def test_recompression_keeps_content(spark, uneven, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    uneven.withColumn("dt", F.to_date("ts")).write.partitionBy("tenant", "dt").option("compression", "none").parquet(src)
    recompress(spark, src, dst, DAY, None, START + 3 * DAY)
    cold = recompress(spark, src, dst, DAY, 19, START + 3 * DAY)
    # The last day is younger than a day, so only two days are rewritten.
    assert {str(r["dt"]) for r in cold.collect()} == {"2024-01-01", "2024-01-02"}
    cols = ["tenant", "dt", "arrival_seq", "value", "nbytes"]
    want = spark.read.parquet(src).filter("dt < '2024-01-03'").select(cols)
    got = spark.read.parquet(dst).select(cols)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert all("zstd" in p.name for p in Path(dst).rglob("*.parquet"))
    with pytest.raises(ValueError):
        recompress(spark, src, dst, 0, 19, START)
    with pytest.raises(ValueError):
        recompress(spark, src, dst, DAY, 20, START)


def test_merge_job_writes_everything(spark, samples, tmp_path):
    rnd = random.Random(4)
    df = samples([(f"t{rnd.randrange(4)}", "m", rnd.randrange(3), rnd.randrange(30 * 86_400), rnd.random()) for _ in range(1500)])
    run_merge(df, tenant_policies(spark).filter("tenant <> 't2'"), START + 30 * DAY, str(tmp_path / "m"), 2000)
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.filter("tenant = 't0'").agg(F.min("dt")).first()[0].isoformat() == "2024-01-20"
    assert back.filter("tenant = 't2'").count() == df.filter("tenant = 't2'").count()
    assert back.filter("tenant = 't0' AND bits = 16").count() > 0


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
