"""Per-series aggregate sidecar and range aggregates answered from it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timeline import bucket_us, epoch_us, from_us, instant, micros
from .rollup import ARRIVAL, SERIES

AGGREGATES = ("count", "sum", "min", "max", "first", "last")


def _raw_state(ts: str, value: str, order_cols: tuple[str, ...]) -> list[Column]:
    v, at = F.col(value), F.struct(F.col(ts).alias("ts"), *[F.col(c).alias(c) for c in order_cols])
    return [
        v.isNotNull().cast("long").alias("n"),
        v.alias("s"),
        v.alias("mn"),
        v.alias("mx"),
        v.alias("first_v"),
        at.alias("first_at"),
        v.alias("last_v"),
        at.alias("last_at"),
    ]


def _combine(columns: list[str]) -> list[Column]:
    how = {
        "n": F.sum("n"),
        "s": F.sum("s"),
        "mn": F.min("mn"),
        "mx": F.max("mx"),
        "first_v": F.min_by("first_v", "first_at"),
        "first_at": F.min("first_at"),
        "last_v": F.max_by("last_v", "last_at"),
        "last_at": F.max("last_at"),
    }
    return [how[c].alias(c) for c in columns]


_NEEDS = {"count": ["n"], "sum": ["s"], "min": ["mn"], "max": ["mx"], "first": ["first_v", "first_at"], "last": ["last_v", "last_at"]}
_RESULT = {"count": "n", "sum": "s", "min": "mn", "max": "mx", "first": "first_v", "last": "last_v"}


def build_sidecar(
    df: DataFrame,
    bucket: int,
    keys: tuple[str, ...] = SERIES,
    order_cols: tuple[str, ...] = ARRIVAL,
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """One mergeable state per (series, bucket)."""
    columns = ["n", "s", "mn", "mx", "first_v", "first_at", "last_v", "last_at"]
    return (
        df.select(*keys, from_us(bucket_us(epoch_us(ts), bucket)).alias("bucket_ts"), *_raw_state(ts, value, order_cols))
        .groupBy(*keys, "bucket_ts")
        .agg(*_combine(columns))
    )


def range_aggregate(
    raw: DataFrame,
    sidecar: DataFrame | None,
    frm: datetime | int,
    to: datetime | int,
    bucket: int,
    aggs: tuple[str, ...] = ("count", "sum", "min", "max"),
    keys: tuple[str, ...] = SERIES,
    order_cols: tuple[str, ...] = ARRIVAL,
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Aggregates per series over [frm, to); equals the answer from raw rows alone.

    Whole buckets come from the sidecar; raw rows are read for the two edges only, behind literal
    bounds that prune the scan. Without a sidecar the range is read raw.
    """
    start, stop = micros(frm), micros(to)
    columns = [c for a in aggs for c in _NEEDS[a]]
    state = [c for c in _raw_state(ts, value, order_cols)]
    t = F.col(ts)

    def within(a: int, b: int) -> Column:
        return (t >= instant(a)) & (t < instant(b))

    first_whole, last_whole = -(-start // bucket) * bucket, stop // bucket * bucket
    if sidecar is None or first_whole >= last_whole:
        parts = raw.filter(within(start, stop)).select(*keys, *state)
    else:
        edges = raw.filter(within(start, first_whole) | within(last_whole, stop)).select(*keys, *state)
        b = F.col("bucket_ts")
        whole = sidecar.filter((b >= instant(first_whole)) & (b < instant(last_whole)))
        parts = edges.unionByName(whole.drop("bucket_ts"))
    return (
        parts.select(*keys, *columns).groupBy(*keys).agg(*_combine(columns)).select(*keys, *[F.col(_RESULT[a]).alias(a) for a in aggs])
    )
