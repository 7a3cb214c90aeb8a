import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewarden.functions.timeline import DAY, HOUR, MINUTE
from tidewarden.operators.pyramid import Pyramid
from tidewarden.operators.sidecar import AGGREGATES, range_aggregate

START = 1_704_067_200_000_000


@pytest.fixture
def month(samples):
    rnd = random.Random(2)
    return samples([(f"t{i % 2}", "m", rnd.randrange(3), rnd.randrange(30 * 86_400), rnd.randrange(100)) for i in range(1500)])


def rows(df):
    return sorted(tuple(r) for r in df.withColumn("sum", F.round("sum", 6)).collect())


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_any_range_equals_raw_rows(month, tmp_path):
    kept, rnd = Pyramid(str(tmp_path / "p"), HOUR, levels=6, span=2 * DAY), random.Random(3)
    kept.refresh(month)
    for _ in range(8):
        a, b = sorted(rnd.randrange(-DAY, 31 * DAY) for _ in range(2))
        b = rnd.choice([b, a + 7 * MINUTE, a // HOUR * HOUR + 3 * HOUR])
        a, b = START + min(a, b), START + max(a, b)
        assert rows(kept.range_aggregate(month, a, b, AGGREGATES)) == rows(range_aggregate(month, None, a, b, HOUR, AGGREGATES))


def test_a_new_day_rewrites_its_path_only(month, tmp_path):
    kept, day = Pyramid(str(tmp_path / "p"), HOUR, levels=5, span=DAY), START + 20 * DAY
    # The pyramid of a month without the day, then the day: as if all had been there.
    kept.refresh(month.where(~F.col("ts").between(F.timestamp_micros(F.lit(day)), F.timestamp_micros(F.lit(day + DAY - 1)))))
    before = files(kept.path)
    kept.refresh(month, day, day + DAY)
    kept.refresh(month, day, day + DAY)
    untouched = {f for f, at in files(kept.path).items() if before.get(f) == at}
    for level in range(5):
        cells = {f.split("cell=")[1].split("/")[0] for f in set(files(kept.path)) - untouched if f"level={level}/" in f}
        assert cells == {str(day // kept.cell(level) * kept.cell(level))}
    assert rows(kept.range_aggregate(month, START, START + 30 * DAY, AGGREGATES)) == rows(range_aggregate(month, None, START, START + 30 * DAY, HOUR, AGGREGATES))


def test_nodes_are_few_and_cover_the_range_once():
    kept, rnd = Pyramid("-", HOUR, levels=16), random.Random(4)
    for _ in range(300):
        a = rnd.randrange(60_000)
        b = a + rnd.randrange(1, 60_000)
        runs = sorted((x, y) for _, x, y in kept.nodes(a * HOUR, b * HOUR))
        assert runs[0][0] == a * HOUR and runs[-1][1] == b * HOUR
        assert all(p[1] == q[0] for p, q in zip(runs, runs[1:]))
        assert sum((y - x) // kept.width(level) for level, x, y in kept.nodes(a * HOUR, b * HOUR)) <= 2 * 16 + 2
    with pytest.raises(ValueError):
        Pyramid("-", HOUR, span=90 * MINUTE)


def test_a_stored_pyramid_beats_the_samples(spark, tmp_path):
    df = spark.range(6_000_000).selectExpr(
        "concat('t', id % 2) AS tenant", "'m' AS metric", "concat('s', id % 50) AS series_id",
        f"timestamp_micros({START} + id * {30 * DAY // 6_000_000}) AS ts", "cast(id % 97 AS double) AS value", "id AS arrival_seq",
    )
    df.write.parquet(str(tmp_path / "raw"))
    raw, kept = spark.read.parquet(str(tmp_path / "raw")), Pyramid(str(tmp_path / "p"), HOUR, levels=8)
    kept.refresh(raw)
    took = {}
    for name, run in {"raw": lambda: range_aggregate(raw, None, *bounds, HOUR, AGGREGATES), "pyramid": lambda: kept.range_aggregate(raw, *bounds, AGGREGATES)}.items():
        bounds = (START + 3 * DAY, START + 27 * DAY)
        run().collect()
        start = time.perf_counter()
        took[name] = (run().collect(), time.perf_counter() - start)
    assert sorted(took["raw"][0]) == sorted(took["pyramid"][0]) and took["pyramid"][1] < took["raw"][1]
