"""Streaming rollup, replica dedup, status and partial-success counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.tiers import RollupTier
from ..operators.admission import REASON, SHED
from ..operators.rollup import ARRIVAL, SERIES


def _micros(us: int) -> str:
    return f"{us} microseconds"


def rollup_stream(
    stream: DataFrame, tier: RollupTier, delay_us: int, keys: tuple[str, ...] = SERIES, order_cols: tuple[str, ...] = ARRIVAL
) -> DataFrame:
    """One row per (series, bucket): in append mode once the watermark has passed the bucket, in update
    mode (`ingest.write_updates`) whenever it changes, so that the last buckets come out too.

    Windows sit on absolute multiples of the interval, like the table job's buckets. A row later
    than `delay_us` misses its bucket here; it stays in the raw table, and the next merge repairs
    the bucket from there. A row without a time has no bucket.
    """
    order = F.struct("ts", *order_cols) if order_cols else F.col("ts")
    value = {
        "last": F.max_by("value", order),
        "first": F.min_by("value", order),
        "min": F.min("value"),
        "max": F.max("value"),
        "sum": F.sum("value"),
        "avg": F.avg("value"),
        "count": F.count("value").cast("double"),
    }[tier.aggregate]
    return (
        stream.withWatermark("ts", _micros(delay_us))
        .groupBy(*keys, F.window("ts", _micros(tier.interval_us)).alias("_w"))
        .agg(value.alias("value"))
        .select(*keys, F.col("_w.start").alias("ts"), "value", F.lit(tier.interval_us).cast("long").alias("resolution_us"))
    )


def dedup_stream(stream: DataFrame, delay_us: int, point: tuple[str, ...] = ("series_id", "ts")) -> DataFrame:
    """The first copy seen of each (series, ts). Preferring the primary's copy is the table job's."""
    return stream.withWatermark("ts", _micros(delay_us)).dropDuplicatesWithinWatermark(list(point))


def partial_success_stream(tagged: DataFrame, window_us: int, delay_us: int, by: tuple[str, ...] = ("tenant",), nbytes: str = "nbytes") -> DataFrame:
    """Accepted and rejected rows and bytes per window."""
    shed = F.col("verdict") == SHED
    return (
        tagged.withWatermark("ts", _micros(delay_us))
        .groupBy(*by, F.window("ts", _micros(window_us)).alias("_w"))
        .agg(
            F.count_if(~shed).alias("accepted_rows"),
            F.count_if(shed).alias("rejected_rows"),
            F.coalesce(F.sum(F.when(~shed, F.col(nbytes))), F.lit(0)).alias("accepted_bytes"),
            F.coalesce(F.sum(F.when(shed, F.col(nbytes))), F.lit(0)).alias("rejected_bytes"),
        )
        .select(
            *by, F.col("_w.start").alias("window_ts"), "accepted_rows", "rejected_rows", "accepted_bytes", "rejected_bytes",
            F.when(F.col("rejected_rows") > 0, F.lit(REASON)).alias("reason"),
        )
    )


def latest_heartbeats_stream(heartbeats: DataFrame) -> DataFrame:
    """Latest heartbeat per node, for update mode; its table is an input of `fleet_status`."""
    return heartbeats.groupBy("cluster", "node").agg(F.max_by("ready", "ts").alias("ready"), F.max("ts").alias("ts"))
