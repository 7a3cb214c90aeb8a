"""Fleet status from heartbeats."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timeline import instant, micros
from .scan import previous_value

DEFAULT_REPLICAS = 3
PENDING, PROGRESSING, READY = "Pending", "Progressing", "Ready"


def phase_of(ready: Column, desired: Column) -> Column:
    return F.when(ready == 0, PENDING).when(ready < desired, PROGRESSING).otherwise(READY)


def fleet_status(heartbeats: DataFrame, desired: DataFrame, as_of: datetime | int, order_cols: tuple[str, ...] = ()) -> DataFrame:
    """Phase and conditions per cluster from each node's latest heartbeat up to `as_of`.

    A cluster that is desired but silent is Pending; without a desired size it wants three nodes.
    """
    at = F.struct("ts", *order_cols) if order_cols else F.col("ts")
    latest = heartbeats.filter(F.col("ts") <= instant(micros(as_of))).groupBy("cluster", "node").agg(F.max_by("ready", at).alias("ready"))
    ready = latest.groupBy("cluster").agg(F.count_if("ready").alias("ready"))
    return (
        ready.join(desired.select("cluster", F.col("replicas").alias("_want")), "cluster", "full")
        .select(
            "cluster",
            F.coalesce("_want", F.lit(DEFAULT_REPLICAS)).cast("long").alias("desired"),
            F.coalesce("ready", F.lit(0)).cast("long").alias("ready"),
        )
        .withColumn("phase", phase_of(F.col("ready"), F.col("desired")))
        .withColumn("available", F.col("ready") > 0)
        .withColumn("progressing", F.col("ready") < F.col("desired"))
    )


def condition_transitions(status: DataFrame, order_cols: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row per actual change of (cluster, condition); repeats do not move the transition time.

    `status` is (cluster, condition, ts, status, ...). The look at the row before is a scan over
    range partitions, so one chatty cluster does not become one task.
    """
    before = previous_value(status, ["cluster", "condition"], ["ts", *order_cols], "status", "previous")
    return before.filter(~F.col("status").eqNullSafe(F.col("previous"))).select(
        "cluster", "condition", F.col("ts").alias("transition_ts"), "previous", "status"
    )
