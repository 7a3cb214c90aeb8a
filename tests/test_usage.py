import random
from datetime import timedelta

from pyspark.sql import functions as F

from tidewarden.operators.usage import series_between, series_churn, series_sketches

START = 1_704_067_200_000_000


def test_few_series_are_counted_exactly(samples, spark):
    rnd = random.Random(7)
    rows = [(f"t{rnd.randrange(2)}", f"m{rnd.randrange(2)}", rnd.randrange(60), rnd.randrange(9 * 86_400), 1.0) for _ in range(900)]
    df = samples(rows)
    nulls = df.limit(1).withColumn("ts", F.lit(None).cast("timestamp")).unionByName(df.limit(1).withColumn("series_id", F.lit(None).cast("string")))
    sketches = series_sketches(df.unionByName(nulls))
    seen, want = {}, {}
    for day in range(9):
        for t, m, u, s, _ in rows:
            if s // 86_400 == day:
                want.setdefault((t, m, day), set()).add(u)
    for key in sorted(want, key=lambda k: k[2]):
        before = seen.setdefault(key[:2], set())
        fresh = want[key] - before
        before |= want[key]
        want[key] = (len(want[key]), len(fresh), len(before))
    first = df.select(F.min(F.to_date("ts"))).first()[0]
    got = {(r["tenant"], r["metric"], (r["dt"].date() - first) // timedelta(days=1)): (r["n_series"], r["n_new"], r["n_so_far"]) for r in series_churn(sketches).collect()}
    assert got == want
    two = {t: len({(m, u) for a, m, u, s, _ in rows if a == t and 2 <= s // 86_400 < 5}) for t in ("t0", "t1")}
    day = 86_400_000_000
    assert {r["tenant"]: r["n_series"] for r in series_between(sketches, START + 2 * day, START + 5 * day).collect()} == two


def test_many_series_stay_within_the_stated_error(spark):
    """Three days of 200,000 series each, half of them new: sketches of 2^12 entries are off by a few of 64 standard parts."""
    df = spark.range(600_000).selectExpr(
        "'t' AS tenant", "'m' AS metric", f"timestamp_micros({START} + (id div 200000) * 86400000000) AS ts", "concat('s', id % 200000 + (id div 200000) * 100000) AS series_id"
    )
    got = [(r["n_series"], r["n_new"], r["n_so_far"]) for r in series_churn(series_sketches(df, 12), size=12).orderBy("dt").collect()]
    for (n, new, so_far), (a, b, c) in zip(got, [(200_000, 200_000, 200_000), (200_000, 100_000, 300_000), (200_000, 100_000, 400_000)]):
        part = 4 / 64
        assert abs(n - a) <= part * a and abs(so_far - c) <= part * c and abs(new - b) <= part * c
