"""Age-tiered rollup of samples into fixed buckets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tiers import AGGREGATES, RollupTier, coarsest_first, raw_from_us, tier_index, tier_interval
from ..functions.timeline import bucket_us, epoch_us, from_us, instant, micros

SERIES = ("tenant", "metric", "series_id")
ARRIVAL = ("arrival_seq",)


def _aggregate(name: str, value: str, order: Column) -> Column:
    return {
        "last": F.max_by(value, order),
        "first": F.min_by(value, order),
        "min": F.min(value),
        "max": F.max(value),
        "sum": F.sum(value),
        "avg": F.avg(value),
        "count": F.count(value).cast("double"),
    }[name]


def _order(ts: str, order_cols: tuple[str, ...]) -> Column:
    # A bare timestamp keeps the aggregate in a hash table; a struct needs a sort.
    return F.struct(ts, *order_cols) if order_cols else F.col(ts)


def with_tier(df: DataFrame, tiers: list[RollupTier], as_of: datetime | int, ts: str = "ts") -> DataFrame:
    """`df` plus `resolution_us`, the interval of the tier each sample takes (0 = raw)."""
    return df.withColumn("resolution_us", tier_interval(F.col(ts), tiers, micros(as_of)))


def _split(df: DataFrame, tiers: list[RollupTier], as_of_us: int, ts: str, snapped: bool = False):
    """Samples younger than every tier or without a time, and the others; each side filters on a literal instant."""
    edge = raw_from_us(tiers, as_of_us, snapped)
    return df.filter((F.col(ts) >= instant(edge)) | F.col(ts).isNull()), df.filter(F.col(ts) < instant(edge))


def downsample(
    df: DataFrame,
    tiers: list[RollupTier],
    as_of: datetime | int,
    keys: tuple[str, ...] = SERIES,
    order_cols: tuple[str, ...] = ARRIVAL,
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """One row (keys, ts, value, resolution_us) per raw sample or rolled-up bucket.

    The representative of a bucket carries the bucket's start, so another run puts it into the same
    bucket. Raw rows never shuffle; a sample without a time stays raw. Rolled rows are combined on the map side before one shuffle on
    (series, bucket); only aggregates some tier asks for are computed.
    """
    as_of_us = micros(as_of)
    raw_cols = [F.col(k) for k in keys] + [F.col(ts).alias("ts"), F.col(value).alias("value")]
    zero = F.lit(0).cast("long").alias("resolution_us")
    if not tiers:
        return df.select(*raw_cols, zero)
    ordered = coarsest_first(tiers)
    raw, old = _split(df, tiers, as_of_us, ts)
    names = {t.aggregate for t in ordered}
    order = _order(ts, order_cols)
    # Tiers may share an interval but not an aggregate, so the tier itself is part of the key.
    grouped = (
        old.withColumn("_tier", tier_index(F.col(ts), tiers, as_of_us))
        .withColumn("resolution_us", tier_interval(F.col(ts), tiers, as_of_us))
        .withColumn("_bucket", bucket_us(epoch_us(ts), F.col("resolution_us")))
        .groupBy(*keys, "_tier", "resolution_us", "_bucket")
        .agg(*[_aggregate(n, value, order).alias(f"_{n}") for n in AGGREGATES if n in names])
    )
    picked = None
    for i, t in enumerate(ordered):
        out = F.col(f"_{t.aggregate}")
        picked = F.when(F.col("_tier") == i, out) if picked is None else picked.when(F.col("_tier") == i, out)
    rolled = grouped.select(*keys, from_us(F.col("_bucket")).alias("ts"), picked.alias("value"), "resolution_us")
    return raw.select(*raw_cols, zero).unionByName(rolled)


def downsample_plan(
    df: DataFrame, tiers: list[RollupTier], as_of: datetime | int, keys: tuple[str, ...] = SERIES, ts: str = "ts"
) -> DataFrame:
    """Rows and buckets each tier would replace; a dry run, as the rollup cannot be undone."""
    as_of_us = micros(as_of)
    _, old = _split(df, tiers, as_of_us, ts)
    return (
        old.withColumn("resolution_us", tier_interval(F.col(ts), tiers, as_of_us))
        .groupBy(*keys, "resolution_us", bucket_us(epoch_us(ts), F.col("resolution_us")).alias("_bucket"))
        .agg(F.count("*").alias("_n"))
        .groupBy("resolution_us")
        .agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_buckets"))
    )


def chosen_tier(tiers: Column, age_us: Column) -> Column:
    """Coarsest tier of a policy's tier array whose age the sample has exceeded (null = raw)."""
    hits = F.transform(
        F.filter(tiers, lambda t: age_us > t["after_us"]),
        lambda t: F.struct(t["interval_us"].alias("interval_us"), t["after_us"].alias("after_us"), t["agg"].alias("agg")),
    )
    return F.array_max(hits)


def downsample_by_policy(
    df: DataFrame,
    policies: DataFrame,
    as_of: datetime | int,
    keys: tuple[str, ...] = SERIES,
    order_cols: tuple[str, ...] = ARRIVAL,
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """`downsample` with every tenant's own tiers; `keys` must include `tenant`.

    The tier is picked inside the row, so no sample is copied per tier. One grouping computes the
    seven aggregates, as the aggregate in force is known only per row. The youngest age any policy
    names is looked up first: rows younger than that never enter the rolled side, and the bound
    reaches the scan.
    """
    age = F.lit(micros(as_of)) - epoch_us(ts)
    youngest = policies.select(F.min(F.array_min(F.transform("downsample", lambda t: t["after_us"])))).first()[0]
    tiered = df.join(policies.select("tenant", F.col("downsample").alias("_tiers")), "tenant", "left").withColumn(
        "_tier", chosen_tier(F.col("_tiers"), age)
    )
    raw = tiered.filter(F.col("_tier").isNull()).select(
        *keys, F.col(ts).alias("ts"), F.col(value).alias("value"), F.lit(0).cast("long").alias("resolution_us")
    )
    if youngest is None:
        return raw
    order = _order(ts, order_cols)
    grouped = (
        tiered.filter((F.col(ts) < instant(micros(as_of) - youngest)) & F.col("_tier").isNotNull())
        .withColumn("resolution_us", F.col("_tier.interval_us"))
        .withColumn("_after", F.col("_tier.after_us"))
        .withColumn("_agg", F.coalesce("_tier.agg", F.lit("last")))
        .withColumn("_bucket", bucket_us(epoch_us(ts), F.col("resolution_us")))
        .groupBy(*keys, "resolution_us", "_after", "_agg", "_bucket")
        .agg(*[_aggregate(n, value, order).alias(f"_{n}") for n in AGGREGATES])
    )
    picked = None
    for n in AGGREGATES:
        hit = F.col("_agg") == n
        picked = F.when(hit, F.col(f"_{n}")) if picked is None else picked.when(hit, F.col(f"_{n}"))
    rolled = grouped.select(*keys, from_us(F.col("_bucket")).alias("ts"), picked.alias("value"), "resolution_us")
    return raw.unionByName(rolled)


# --- mergeable state -------------------------------------------------------------------------

#: Values under this bound are summed as decimals of nine digits, which no order of merging changes.
EXACT_BELOW = 1e15
STATE = "n bigint, s decimal(38,9), rest double, mn double, mx double, first_v double, last_v double"


def as_state(
    df: DataFrame, keys: tuple[str, ...] = SERIES, order_cols: tuple[str, ...] = ARRIVAL, ts: str = "ts", value: str = "value"
) -> DataFrame:
    """Raw samples as one-row partial states.

    A state keeps count, sum, extremes and both end samples, so every aggregate survives any number
    of merges. A sum is a decimal and a double `rest` for what the decimal cannot hold: digits beyond
    the ninth, huge values, NaN and infinity. Only the last bits of `rest` depend on the order of merging.
    """
    v = F.col(value)
    exact = F.when(F.abs(v) < EXACT_BELOW, v.cast("decimal(38,9)")).when(v.isNotNull(), F.lit(0).cast("decimal(38,9)"))
    seen = v.isNotNull().cast("long")
    stamp = [F.col(ts).alias("ts"), *[F.col(c).alias(c) for c in order_cols]]
    return df.select(
        *keys,
        F.col(ts).alias("ts"),
        F.lit(0).cast("long").alias("resolution_us"),
        seen.alias("n"),
        exact.alias("s"),
        (v - exact.cast("double")).alias("rest"),
        v.alias("mn"),
        v.alias("mx"),
        v.alias("first_v"),
        F.struct(*stamp).alias("first_at"),
        v.alias("last_v"),
        F.struct(*stamp).alias("last_at"),
    )


def _merged_state() -> list[Column]:
    return [
        F.sum("n").alias("n"),
        F.sum("s").cast("decimal(38,9)").alias("s"),
        F.sum("rest").alias("rest"),
        F.min("mn").alias("mn"),
        F.max("mx").alias("mx"),
        F.min_by("first_v", "first_at").alias("first_v"),
        F.min("first_at").alias("first_at"),
        F.max_by("last_v", "last_at").alias("last_v"),
        F.max("last_at").alias("last_at"),
    ]


def merge_rollup(states: DataFrame, tiers: list[RollupTier], as_of: datetime | int, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Roll partial states up again; running it twice, or step by step, gives the same table.

    Each cut-off is snapped down to a multiple of its interval: a bucket is either wholly past the
    tier's age or wholly untouched. Finer buckets must nest in coarser ones.
    """
    if not tiers:
        return states
    widths = sorted(t.interval_us for t in tiers)
    if any(b % a for a, b in zip(widths, widths[1:])):
        raise ValueError("the intervals of progressive tiers must divide one another")
    as_of_us = micros(as_of)
    young, old = _split(states, tiers, as_of_us, "ts", snapped=True)
    # An already coarser row keeps its resolution.
    resolution = F.greatest(F.col("resolution_us"), tier_interval(F.col("ts"), tiers, as_of_us, snapped=True))
    merged = (
        old.withColumn("resolution_us", resolution)
        .withColumn("_bucket", bucket_us(epoch_us("ts"), F.col("resolution_us")))
        .groupBy(*keys, "resolution_us", "_bucket")
        .agg(*_merged_state())
        .withColumn("ts", from_us(F.col("_bucket")))
        .drop("_bucket")
    )
    return young.unionByName(merged)


def merge_rollup_by_policy(
    states: DataFrame, policies: DataFrame, as_of: datetime | int, keys: tuple[str, ...] = SERIES
) -> DataFrame:
    """`merge_rollup` with every tenant's own tiers; `keys` must include `tenant`.

    Adds `agg`, the aggregate of the tier a row was rolled by (null = a sample). Cut-offs are snapped
    to their intervals, so merging step by step gives the table of one merge, provided a tenant's
    intervals divide one another. Rows of tenants without a policy, or without a time, stay as they are.
    """
    now = F.lit(micros(as_of)).cast("long")
    # Cut-offs are worked out once per policy; a sample only compares.
    cut = F.transform(
        "downsample",
        lambda t: F.struct(
            t["interval_us"].alias("interval_us"),
            t["after_us"].alias("after_us"),
            F.coalesce(t["agg"], F.lit("last")).alias("agg"),
            bucket_us(now - t["after_us"], t["interval_us"]).alias("cut_us"),
        ),
    )
    tiers = policies.select("tenant", cut.alias("_tiers"))
    states = states if "agg" in states.columns else states.withColumn("agg", F.lit(None).cast("string"))
    newest_cut = tiers.select(F.max(F.array_max(F.transform("_tiers", lambda t: t["cut_us"])))).first()[0]
    if newest_cut is None:
        return states
    hits = F.array_max(F.filter("_tiers", lambda t: epoch_us("ts") < t["cut_us"]))
    tiered = states.join(tiers, "tenant", "left").withColumn("_tier", hits)
    kept = tiered.filter(F.col("_tier").isNull()).select(*states.columns)
    # A row that is coarser already keeps its resolution and its aggregate.
    coarser = F.col("resolution_us") > F.col("_tier.interval_us")
    merged = (
        tiered.filter((F.col("ts") < instant(newest_cut)) & F.col("_tier").isNotNull())
        .withColumn("agg", F.when(coarser, F.col("agg")).otherwise(F.col("_tier.agg")))
        .withColumn("resolution_us", F.greatest("resolution_us", "_tier.interval_us"))
        # Never a zero width: a filter from above may be pushed to rows that stay raw.
        .withColumn("_bucket", bucket_us(epoch_us("ts"), F.nullif(F.col("resolution_us"), F.lit(0))))
        .groupBy(*keys, "resolution_us", "agg", "_bucket")
        .agg(*_merged_state())
        .withColumn("ts", from_us(F.col("_bucket")))
    )
    return kept.unionByName(merged.select(*states.columns))


def state_value(agg: str) -> Column:
    """Value of a state row under one aggregate."""
    total = F.col("s").cast("double") + F.col("rest")
    return {
        "last": F.col("last_v"),
        "first": F.col("first_v"),
        "min": F.col("mn"),
        "max": F.col("mx"),
        "sum": total,
        "avg": F.try_divide(total, F.col("n").cast("double")),
        "count": F.col("n").cast("double"),
    }[agg]


def finish(states: DataFrame, agg: str, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Value of each state under one aggregate."""
    return states.select(*keys, "ts", state_value(agg).alias("value"), "resolution_us")


def finish_by_row(states: DataFrame) -> DataFrame:
    """`states` plus `value`, under the aggregate each row was rolled by; a sample has its own value."""
    value = F.when(F.col("agg").isNull(), F.col("last_v"))
    for name in AGGREGATES:
        value = value.when(F.col("agg") == name, state_value(name))
    return states.withColumn("value", value)
