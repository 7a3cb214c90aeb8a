"""Distinct series over time, from stored sketches: a theta sketch per tenant, metric and day.

Sketches merge, so a day, a month or a fleet is counted without its samples, and their difference
counts what is new. Up to 2^size entries a sketch is exact; beyond, its error is about 1 / sqrt(2^size),
and that of a difference the same share of the union's count.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.timeline import instant, micros
from .retention import partition_of

SIZE = 14
DAY_KEY = ("tenant", "metric", "dt")


def series_sketches(df: DataFrame, size: int = SIZE) -> DataFrame:
    """tenant, metric, dt and the sketch of that day's series. A day of samples is merged on the map side.

    Samples without a time have no day and are left out; a null series is none.
    """
    days = df.where("ts is not null and series_id is not null").withColumn("dt", partition_of("ts"))
    return days.groupBy(*DAY_KEY).agg(F.theta_sketch_agg("series_id", size).alias("sketch"))


def series_between(sketches: DataFrame, frm: datetime | int, to: datetime | int, by: tuple[str, ...] = ("tenant",), size: int = SIZE) -> DataFrame:
    """Distinct series per `by` over the days of [frm, to); a series counts once however many days and metrics have it."""
    some = sketches.where((F.col("dt") >= instant(micros(frm))) & (F.col("dt") < instant(micros(to))))
    return some.groupBy(*by).agg(F.theta_union_agg("sketch", size).alias("_all")).select(*by, F.theta_sketch_estimate("_all").alias("n_series"))


def series_churn(sketches: DataFrame, by: tuple[str, ...] = ("tenant", "metric"), size: int = SIZE) -> DataFrame:
    """Per day with samples: its series, those never seen before, and all seen so far.

    The running union is over the days of one key, which are few; samples are not read.
    """
    days = sketches.groupBy(*by, "dt").agg(F.theta_union_agg("sketch", size).alias("_day"))
    so_far = Window.partitionBy(*by).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    run = days.withColumn("_all", F.theta_union_agg("_day", size).over(so_far))
    before = F.lag("_all").over(Window.partitionBy(*by).orderBy("dt"))
    run = run.withColumn("_before", before)
    fresh = F.when(F.col("_before").isNull(), F.theta_sketch_estimate("_day")).otherwise(F.theta_sketch_estimate(F.theta_difference("_day", "_before")))
    return run.select(*by, "dt", F.theta_sketch_estimate("_day").alias("n_series"), fresh.alias("n_new"), F.theta_sketch_estimate("_all").alias("n_so_far"))
