"""Retention: partitions are dropped whole, never single rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timeline import DAY, bucket_us, epoch_us, floor_us, from_us, instant, micros
from ..sources.staging import stage


def partition_of(ts: Column | str, width: int = DAY) -> Column:
    """Start of the partition a row lives in."""
    return from_us(bucket_us(epoch_us(ts), width))


def apply_retention(
    df: DataFrame,
    max_age_us: int | None,
    as_of: datetime | int,
    width: int = DAY,
    ts: str = "ts",
    dt: str | None = None,
) -> DataFrame:
    """Rows of the partitions that are not wholly past `as_of - max_age`; null or 0 keeps all.

    A partition [p, p + width) survives when p + width > cutoff. Partitions start on multiples of
    the width, so that is the same as ts >= floor(cutoff): one literal bound that the Parquet scan
    uses to skip row groups. With `dt`, the day partition column of the table, the bound also prunes
    directories. A row without a time has no age and is kept.
    """
    if not max_age_us:
        return df
    first = floor_us(micros(as_of) - max_age_us, width)
    kept = df.filter((F.col(ts) >= instant(first)) | F.col(ts).isNull())
    if dt is None:
        return kept
    # Rows without a day are in a directory of their own, read apart so that the other bound stays plain.
    return kept.filter(F.col(dt) >= F.to_date(instant(floor_us(first, DAY)))).unionByName(kept.filter(F.col(dt).isNull()))


def expired_partitions(df: DataFrame, max_age_us: int | None, as_of: datetime | int, width: int = DAY, ts: str = "ts") -> DataFrame:
    """Partitions that a physical drop would delete, with their row counts."""
    if not max_age_us:
        return df.limit(0).select(F.col(ts).alias("dt"), F.lit(0).cast("long").alias("n_rows"))
    first = floor_us(micros(as_of) - max_age_us, width)
    return (
        df.filter(F.col(ts) < instant(first)).groupBy(partition_of(ts, width).alias("dt")).agg(F.count("*").alias("n_rows"))
    )


def retention_overhang(
    df: DataFrame, max_age_us: int, as_of: datetime | int, width: int = DAY, ts: str = "ts", by: tuple[str, ...] = ("tenant",)
) -> DataFrame:
    """Rows already past the window that a partition still in use keeps alive."""
    cutoff = micros(as_of) - max_age_us
    return (
        df.filter((F.col(ts) >= instant(floor_us(cutoff, width))) & (F.col(ts) < instant(cutoff)))
        .groupBy(*by, partition_of(ts, width).alias("dt"))
        .agg(F.count("*").alias("n_rows"), F.sum("nbytes").alias("n_bytes"))
    )


def retention_budget_plan(
    df: DataFrame, max_bytes: int | None, width: int = DAY, ts: str = "ts", by: tuple[str, ...] = ("tenant",)
) -> DataFrame:
    """Per partition: bytes, bytes kept from the newest partition down, and whether it is over.

    A plan only: a bytes budget is reported, never enforced. The window runs over one row per
    partition.
    """
    newest = Window.partitionBy(*by).orderBy(F.col("dt").desc())
    over = F.col("running_bytes") > F.lit(max_bytes) if max_bytes else F.lit(False)
    return (
        df.groupBy(*by, partition_of(ts, width).alias("dt"))
        .agg(F.sum("nbytes").alias("n_bytes"))
        .withColumn("running_bytes", F.sum("n_bytes").over(newest))
        .withColumn("would_drop", over)
    )


def apply_retention_by_policy(
    df: DataFrame, policies: DataFrame, as_of: datetime | int, width: int = DAY, ts: str = "ts", dt: str | None = None
) -> DataFrame:
    """`apply_retention` with every tenant's own window; no policy row keeps everything.

    A tenant's partition is the wider of `width` and its coarsest rollup interval: a rolled row stands
    at its bucket's start, and must stay as long as the newest sample in it. So retention drops the
    same samples before and after a rollup. A row without a time is kept.

    The policy side is joined without a hint: its size decides between broadcast
    and a shuffle that adaptive execution can split on a hot tenant.

    With `dt`, the day column of a table in directories of (tenant, day), the directories to keep are
    worked out first, from their names alone, and the scan opens no others.
    """
    now = F.lit(micros(as_of)).cast("long")
    unit = F.greatest(F.lit(width).cast("long"), F.array_max(F.transform("downsample", lambda t: t["interval_us"])))
    age = F.nullif(F.col("retention.max_age_us"), F.lit(0).cast("long"))
    first = policies.select("tenant", bucket_us(now - age, unit).alias("_first"))
    young = F.col("_first").isNull() | F.col(ts).isNull() | (epoch_us(ts) >= F.col("_first"))
    if dt is None:
        return df.join(first, "tenant", "left").filter(young).drop("_first")
    named = F.col("tenant").isNotNull() & F.col(dt).isNotNull()
    parts = df.filter(named).select("tenant", dt).distinct().join(first, "tenant", "left")
    kept = stage(parts.filter(F.col("_first").isNull() | (F.col(dt) >= F.to_date(from_us(bucket_us(F.col("_first"), DAY))))), "kept-parts")
    # Always true, and a condition by which the planner deems this side worth pruning by.
    kept = kept.filter(F.length("tenant") >= 0)
    rows = df.join(kept, ["tenant", dt]).filter(young).select(*df.columns)
    # Directories without a tenant or a day have no window.
    return rows.unionByName(df.filter(~named))
