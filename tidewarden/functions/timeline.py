"""Time as epoch microseconds.

`ts` columns are TIMESTAMP, so `unix_micros` is free in generated code and comparisons with a
literal instant reach the Parquet scan. Durations are plain microsecond counts.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F, types as T

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(instant: datetime | int) -> int:
    """Epoch microseconds of an instant; naive datetimes are UTC."""
    if isinstance(instant, int):
        return instant
    if instant.tzinfo is None:
        instant = instant.replace(tzinfo=timezone.utc)
    return (instant - _EPOCH) // timedelta(microseconds=1)


def instant(us: int) -> Column:
    """A TIMESTAMP literal; folds to a constant, so filters on it are pushed to the scan."""
    return F.timestamp_micros(F.lit(us).cast("long"))


def epoch_us(col: Column | str) -> Column:
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


def from_us(col: Column) -> Column:
    return F.timestamp_micros(col)


def bucket_us(us: Column, width: Column | int) -> Column:
    """Start of the bucket holding `us`; buckets sit on absolute multiples of `width`."""
    width = F.lit(width).cast("long") if isinstance(width, int) else width
    return us - F.pmod(us, width)


def floor_us(us: int, width: int) -> int:
    return us - us % width


def utc_timestamps(schema: T.StructType) -> T.StructType:
    """`schema` with zone-less timestamps read as instants in UTC.

    Parquet stores both as microseconds, so asking the reader for TIMESTAMP costs nothing, while a
    cast after the scan would hide the column from push-down.
    """
    return T.StructType(
        [
            T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType)
            for f in schema.fields
        ]
    )


def without_zone(df: DataFrame) -> DataFrame:
    """`df` with TIMESTAMP columns as TIMESTAMP_NTZ wall time (the session zone is UTC)."""
    return df.select(
        [
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
