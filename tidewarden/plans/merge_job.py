"""The policy-driven merge: retention, rollup, precision, sized and compressed parts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timeline import DAY, bucket_us, epoch_us, from_us, micros
from ..operators.policy import policy_violations
from ..operators.precision import apply_precision_by_policy, part_ages, with_part_day
from ..operators.retention import apply_retention_by_policy, partition_of
from ..operators.rollup import ARRIVAL, SERIES, STATE, as_state, chosen_tier, downsample_by_policy, finish_by_row, merge_rollup_by_policy
from ..sources.parts import assign_parts, write_assigned
from ..sources.staging import stage


class InvalidPolicy(ValueError):
    """The policy table breaks rules; the merge is lossy, so it does not start."""


def unmergeable(policies: DataFrame) -> DataFrame:
    """Tenants whose rollup intervals do not divide one another and, or a multiple of, a day."""
    widths = F.array_sort(F.array_append(F.transform("downsample", lambda t: t["interval_us"]), F.lit(DAY).cast("long")))
    uneven = F.exists(F.arrays_zip(F.slice(widths, 1, F.size(widths) - 1).alias("a"), F.slice(widths, 2, F.size(widths)).alias("b")), lambda p: p["b"] % p["a"] != 0)
    return policies.filter(F.size("downsample") > 0).filter(uneven).select("tenant")


def check_policies(policies: DataFrame, shown: int = 20) -> None:
    """Fail with the first `shown` offenders and the number of all."""
    broken = policy_violations(policies, first_only=True)
    rows = broken.limit(shown).collect()
    if rows:
        raise InvalidPolicy(f"{broken.count()} tenants: " + "; ".join(f"{r['tenant']}: rule {r['rule']} ({r['field']})" for r in rows))
    uneven = unmergeable(policies)
    rows = uneven.limit(shown).collect()
    if rows:
        raise InvalidPolicy(f"{uneven.count()} tenants with intervals that do not nest: " + "; ".join(r["tenant"] for r in rows))


def bit_widths(policies: DataFrame) -> list[int]:
    """The distinct precision widths in use: at most 63 numbers."""
    rows = policies.select(F.explode("precision.bits").alias("bits")).distinct().collect()
    return sorted(r["bits"] for r in rows if r["bits"] is not None)


def merged(
    samples: DataFrame,
    policies: DataFrame,
    as_of: datetime | int,
    widths: list[int],
    keys: tuple[str, ...] = SERIES,
    order_cols: tuple[str, ...] = ARRIVAL,
) -> DataFrame:
    """The rows a merge leaves: (keys, ts, value, resolution_us, dt, bits).

    Retention comes first, as coarsening rows about to be dropped is wasted work. A part's age is
    that of the newest sample the rollup puts into it. For samples only: its rows hold no states, so
    a table that is merged again goes through `merge_states`.
    """
    kept = apply_retention_by_policy(samples, policies, as_of)
    rolled = downsample_by_policy(kept, policies, as_of, keys, order_cols)
    tiers = policies.select("tenant", F.col("downsample").alias("_tiers"))
    tier = chosen_tier(F.col("_tiers"), F.lit(micros(as_of)) - epoch_us("ts"))
    moved = F.coalesce(from_us(bucket_us(epoch_us("ts"), tier["interval_us"])), F.col("ts"))
    placed = kept.select("tenant", "ts").join(tiers, "tenant", "left").select("tenant", "ts", partition_of(moved).alias("dt"))
    return apply_precision_by_policy(rolled, policies, as_of, widths, ages=part_ages(placed, as_of))


def merge_states(states: DataFrame, policies: DataFrame, as_of: datetime | int, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """States (`as_state`, or an earlier merge) after retention and rollup; merging again or in steps changes nothing."""
    return merge_rollup_by_policy(apply_retention_by_policy(states, policies, as_of), policies, as_of, keys)


def published(states: DataFrame, policies: DataFrame, as_of: datetime | int, widths: list[int]) -> DataFrame:
    """Merged states plus value, dt and bits.

    Precision applies to `value` alone: sums over truncated states would depend on when merges ran.
    A part's age is that of the newest sample in its rows, not of its bucket starts.
    """
    rows = with_part_day(finish_by_row(states))
    ages = part_ages(rows.select("tenant", "dt", F.col("last_at.ts").alias("newest_ts")), as_of, ts="newest_ts")
    return apply_precision_by_policy(rows, policies, as_of, widths, ages=ages)


#: The written table: states, and what is published of them.
MERGED = (
    f"tenant string, metric string, series_id string, ts timestamp, resolution_us bigint, agg string, {STATE}, "
    "first_at struct<ts:timestamp,arrival_seq:bigint>, last_at struct<ts:timestamp,arrival_seq:bigint>, "
    "value double, bits int, dt date, part_id bigint"
)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The table of an earlier `run_merge`, its partition columns with their own types."""
    return spark.read.schema(MERGED).parquet(path)


def run_merge(table: DataFrame, policies: DataFrame, as_of: datetime | int, path: str, max_part_bytes: int, level: int | None = None) -> None:
    """Validate the policies, then write the merged table as sized parts.

    `table` holds samples, or `read_merged` of an earlier merge, alone or with the states of new samples
    (`as_state`). `path` is replaced as a whole, so a rerun gives the same table and expired partitions
    are gone; it must not be a path that `table` reads.
    """
    check_policies(policies)
    policies = stage(policies, "merge-policies")
    kept = [c for c in (*SERIES, "ts", "resolution_us", "agg", *[x.split()[0] for x in STATE.split(", ")], "first_at", "last_at") if c in table.columns]
    states = table.select(*kept) if "resolution_us" in table.columns else as_state(table)
    out = published(merge_states(states, policies, as_of), policies, as_of, bit_widths(policies))
    # Approximate uncompressed size of a row: the text columns and fifteen 8-byte numbers.
    size = F.octet_length("tenant") + F.octet_length("metric") + F.octet_length("series_id") + 120
    ordered = out.withColumn("_size", size.cast("long")).withColumn("_seq", F.col("last_at.arrival_seq"))
    parts = assign_parts(ordered, max_part_bytes, order=("ts", "series_id", "resolution_us", "_seq"), nbytes="_size").drop("_size", "_seq")
    write_assigned(parts, path, level=level, mode="overwrite")
