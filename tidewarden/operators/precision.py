"""Age-tiered float precision: the age is a property of a part, not of a sample."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.mantissa import truncate_by_width
from ..functions.tiers import PrecisionTier, precision_bits
from ..functions.timeline import DAY, epoch_us, micros
from .retention import partition_of

PART = ("tenant", "dt")


def with_part_day(df: DataFrame, width: int = DAY, ts: str = "ts") -> DataFrame:
    return df if "dt" in df.columns else df.withColumn("dt", partition_of(ts, width))


def part_ages(df: DataFrame, as_of: datetime | int, by: tuple[str, ...] = PART, ts: str = "ts") -> DataFrame:
    """Age of each part, counted from its newest row. Reads the part key and `ts` only."""
    return (
        with_part_day(df, ts=ts)
        .groupBy(*by)
        .agg(F.max(ts).alias("newest"), F.count("*").alias("n_rows"))
        .withColumn("age_us", F.lit(micros(as_of)) - epoch_us("newest"))
    )


def part_precision(
    df: DataFrame, tiers: list[PrecisionTier], as_of: datetime | int, by: tuple[str, ...] = PART, ts: str = "ts"
) -> DataFrame:
    """One row per part with the bits it keeps (null = lossless)."""
    return part_ages(df, as_of, by, ts).withColumn("bits", precision_bits(F.col("age_us"), tiers))


def policy_bits(tiers: Column, age_us: Column) -> Column:
    """Fewest bits among the tiers of a policy's tier array that an age has exceeded."""
    return F.array_min(F.transform(F.filter(tiers, lambda t: age_us > t["after_us"]), lambda t: t["bits"]))


def apply_precision(
    df: DataFrame,
    tiers: list[PrecisionTier],
    as_of: datetime | int,
    by: tuple[str, ...] = PART,
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """`df` with `value` truncated to the bits of its part; adds `dt` and `bits`.

    Parts number tenants times days, a tiny fraction of the rows. The join carries no hint.
    """
    df = with_part_day(df, ts=ts)
    parts = part_precision(df, tiers, as_of, by, ts).select(*by, "bits")
    return df.join(parts, [*by], "left").withColumn(value, truncate_by_width(F.col(value), F.col("bits"), [t.bits for t in tiers]))


def apply_precision_by_policy(
    df: DataFrame,
    policies: DataFrame,
    as_of: datetime | int,
    widths: list[int],
    ts: str = "ts",
    value: str = "value",
    ages: DataFrame | None = None,
) -> DataFrame:
    """`apply_precision` with every tenant's own tiers.

    `widths` lists the bit widths the policies use; it only shapes the CASE. `ages` gives the parts'
    ages when `df` no longer holds their newest rows (after a rollup).
    """
    df = with_part_day(df, ts=ts)
    ages = part_ages(df, as_of, PART, ts) if ages is None else ages
    parts = (
        ages.join(policies.select("tenant", "precision"), "tenant")
        .withColumn("bits", policy_bits(F.col("precision"), F.col("age_us")))
        .filter(F.col("bits").isNotNull())
        .select(*PART, "bits")
    )
    return df.join(parts, [*PART], "left").withColumn(value, truncate_by_width(F.col(value), F.col("bits"), widths))


def precision_report(
    df: DataFrame, tiers: list[PrecisionTier], as_of: datetime | int, by: tuple[str, ...] = PART, ts: str = "ts", value: str = "value"
) -> DataFrame:
    """What each tier would cost and gain: relative error and distinct values, before and after.

    Values are combined to (bits, value) counts first, so a frequent value weighs one row.
    """
    df = with_part_day(df, ts=ts)
    parts = part_precision(df, tiers, as_of, by, ts).select(*by, "bits")
    counted = (
        df.join(parts, [*by], "left")
        .filter(F.col("bits").isNotNull())
        .groupBy("bits", F.col(value).alias("_v"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_t", truncate_by_width(F.col("_v"), F.col("bits"), [t.bits for t in tiers]))
        .withColumn("_err", F.when(F.col("_v") == 0, F.lit(0.0)).otherwise(F.abs((F.col("_v") - F.col("_t")) / F.col("_v"))))
    )
    # Second grouping by the truncated value: its distinct count needs no second shuffle of rows.
    return (
        counted.groupBy("bits", "_t")
        .agg(
            F.sum("_n").alias("_rows"),
            F.count("*").alias("_distinct"),
            F.max("_err").alias("_max"),
            F.sum(F.col("_err") * F.col("_n")).alias("_sum"),
        )
        .groupBy("bits")
        .agg(
            F.sum("_rows").alias("n_rows"),
            F.max("_max").alias("max_rel_error"),
            (F.sum("_sum") / F.sum("_rows")).alias("mean_rel_error"),
            F.sum("_distinct").alias("distinct_before"),
            F.count("*").alias("distinct_after"),
        )
    )
