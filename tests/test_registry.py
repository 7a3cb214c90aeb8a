import random

import pytest
from pyspark.sql import functions as F

from tidewarden.operators.registry import Registry, admit


def rows_of(seed, n=600):
    rnd = random.Random(seed)
    return [(f"t{rnd.randrange(3)}", f"m{rnd.randrange(4)}", rnd.randrange(12) if i < n // 2 else rnd.randrange(40), i, 1.0) for i in range(n)]


def plain(rows, limits):
    """Verdict per row, one after another."""
    known, minted, out = {}, {}, []
    for tenant, metric, user, i, _ in rows:
        hard, soft = limits.get(tenant, (None, None))
        own, over = known.setdefault(tenant, set()), minted.setdefault(tenant, set())
        if (metric, user) in own or not hard or len(own) < (soft or hard):
            own.add((metric, user))
            out.append((i, "accepted"))
        elif soft and (metric in over or len(over) < hard - soft):
            over.add(metric)
            out.append((i, "overflow"))
        else:
            out.append((i, "shed"))
    return out


@pytest.mark.parametrize("bitmaps", [1, 64])
@pytest.mark.parametrize("cuts", [[600], [50, 51, 300, 600], [200, 400, 600]])
def test_arrivals_in_order_are_one_stream(spark, samples, tmp_path, cuts, bitmaps):
    rows, limits = rows_of(len(cuts)), {"t0": (20, None), "t1": (23, 21), "t2": (0, 5)}
    df, registry = samples(rows), Registry(str(tmp_path / "kept"), bitmaps=bitmaps)
    budget = spark.createDataFrame([(t, h, s) for t, (h, s) in limits.items()], "tenant string, max_series long, max_series_soft long")
    got, low = [], 0
    for i, high in enumerate(cuts):
        part = df.where((F.col("arrival_seq") >= low) & (F.col("arrival_seq") < high))
        for _ in range(2):  # a repeated arrival changes nothing
            tagged = admit(part, registry, i, budget)
        got += [(r["arrival_seq"], r["verdict"]) for r in tagged.collect()]
        low = high
    assert sorted(got) == plain(rows, limits)


def test_signals_nulls_and_no_rows(spark, samples, tmp_path):
    df = samples([("t", "m", u, u, 1.0) for u in range(5)]).unionByName(samples([("t", "m", 100 + u, u, 1.0) for u in range(5)], signal="logs"))
    df = df.unionByName(df.where("arrival_seq = 0").withColumn("tenant", F.lit(None).cast("string")))
    budget = spark.createDataFrame([("t", 3, 2)], "tenant string, max_series long, max_series_soft long")
    tagged = admit(df, Registry(str(tmp_path / "kept")), 0, budget)
    counts = {(r["tenant"], r["signal"], r["verdict"]): r["count"] for r in tagged.groupBy("tenant", "signal", "verdict").count().collect()}
    assert counts == {
        ("t", "metrics", "accepted"): 2, ("t", "metrics", "overflow"): 3, ("t", "logs", "accepted"): 3, ("t", "logs", "shed"): 2,
        (None, "metrics", "accepted"): 1, (None, "logs", "accepted"): 1,
    }
    again = admit(df.limit(0), Registry(str(tmp_path / "kept")), 1, budget)
    assert again.count() == 0


def test_a_bit_of_the_sketch_is_set_exactly_for_registered_series(spark, samples, tmp_path):
    df, registry = samples([("t", "m", u, u, 1.0) for u in range(40)]), Registry(str(tmp_path / "kept"), bitmaps=4)
    admit(df.where("arrival_seq < 20"), registry, 0, spark.createDataFrame([("t", None, None)], "tenant string, max_series long, max_series_soft long"))
    seen = registry.maybe_known(df, 1).groupBy("maybe").agg(F.collect_list("arrival_seq").alias("x")).collect()
    by = {r["maybe"]: sorted(r["x"]) for r in seen}
    assert by[True] == list(range(20)) and by[False] == list(range(20, 40))
