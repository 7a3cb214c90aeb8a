"""Admission control: series ceilings, ingest rate, in-flight bytes, partial success.

Limits hold per admission key (a tenant, or tenant and shard). Rows are never dropped here: they are
tagged, so accepted, overflow and shed rows always add up to the input.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.hashing import series_id
from ..functions.timeline import bucket_us, epoch_us, from_us
from ..sources.staging import stage
from .kernels import ACCEPTED, NEVER, SECOND, SHED, bucket_kernel
from .scan import PART, TIE, running_total, spread

OVERFLOW = "overflow"
REASON = "RESOURCE_EXHAUSTED"
OVERFLOW_LABELS = {"overflow": "true"}


# --- series ceilings -------------------------------------------------------------------------


def series_arrivals(df: DataFrame, key: tuple[str, ...], arrival: str = "arrival_seq") -> DataFrame:
    """One row per series: its first arrival. Combined on the map side, so a busy series is cheap."""
    return df.groupBy(*key, "signal", "metric", "series_id").agg(F.min(arrival).alias("first_seq"))


def series_verdicts(
    df: DataFrame,
    max_series: int | None,
    max_series_soft: int | None = None,
    key: tuple[str, ...] = ("tenant",),
    arrival: str = "arrival_seq",
) -> DataFrame:
    """The series that are not simply admitted, with verdict `overflow` or `shed`.

    Series are ranked by first arrival per (key, signal). Up to the soft budget they are admitted;
    past it each metric mints one overflow series, in order of its first overflowing arrival, while
    the ceiling lasts. Without a soft budget, and for signals other than metrics, the ceiling alone
    decides. The rank is a scan over range partitions, so one huge tenant is not one task.
    """
    group = [*key, "signal"]
    series = stage(series_arrivals(df, key, arrival), "series")
    ranked = running_total(series, group, ["first_seq", "series_id"], F.lit(1), "rank")
    hard = int(max_series or 0)
    soft = int(max_series_soft or 0) if hard else 0
    columns = [*group, "metric", "series_id"]
    past_hard = ranked.filter(F.col("rank") > hard).select(*columns, F.lit(SHED).alias("verdict"))
    if not hard:
        return past_hard.limit(0)
    if not soft:
        return past_hard
    over = ranked.filter((F.col("signal") == "metrics") & (F.col("rank") > soft))
    metrics = stage(over.groupBy(*group, "metric").agg(F.min("first_seq").alias("_first")), "metrics")
    minted = (
        running_total(metrics, group, ["_first", "metric"], F.lit(1), "_m")
        .filter(F.col("_m") <= hard - soft)
        .select(*group, "metric", F.lit(OVERFLOW).alias("_minted"))
    )
    folded = over.join(minted, [*group, "metric"], "left").select(*columns, F.coalesce("_minted", F.lit(SHED)).alias("verdict"))
    return folded.unionByName(past_hard.filter(F.col("signal") != "metrics"))


def limit_series(
    df: DataFrame,
    max_series: int | None,
    max_series_soft: int | None = None,
    key: tuple[str, ...] = ("tenant",),
    arrival: str = "arrival_seq",
) -> DataFrame:
    """`df` plus `verdict`; rows of an overflow series get the overflow labels and identity.

    Only the exceptional series are joined back. They are staged first, so their true size, not a
    guess, decides whether the samples have to move.
    """
    if not max_series:
        return df.withColumn("verdict", F.lit(ACCEPTED))
    verdicts = stage(series_verdicts(df, max_series, max_series_soft, key, arrival), "verdicts")
    tagged = df.alias("d").join(verdicts.alias("v"), same_key("d", "v", [*key, "signal", "series_id"]), "left")
    tagged = tagged.select("d.*", F.coalesce("v.verdict", F.lit(ACCEPTED)).alias("verdict"))
    marker = F.create_map(*[F.lit(x) for kv in OVERFLOW_LABELS.items() for x in kv])
    folded = F.col("verdict") == OVERFLOW
    tagged = tagged.withColumn("series_id", F.when(folded, series_id(F.col("tenant"), F.col("metric"), marker)).otherwise(F.col("series_id")))
    if "labels" in df.columns:
        tagged = tagged.withColumn("labels", F.when(folded, marker).otherwise(F.col("labels")))
    return tagged


def series_usage(df: DataFrame, budgets: DataFrame, approximate: bool = False) -> DataFrame:
    """Series per tenant and metric against the tenant's budgets.

    Exact counting dedups (tenant, metric, series) on the map side first. `approximate` keeps one
    fixed-size sketch per metric instead.
    """
    count = F.approx_count_distinct("series_id") if approximate else F.count_distinct("series_id")
    used = df.groupBy("tenant", "metric").agg(count.alias("n_series"))
    whole = used.groupBy("tenant").agg(F.sum("n_series").alias("tenant_series"))
    limits = budgets.select("tenant", F.col("limits.max_series").alias("max_series"), F.col("limits.max_series_soft").alias("max_series_soft"))
    return (
        used.join(whole.join(limits, "tenant", "left"), "tenant")
        .withColumn("over_soft", (F.coalesce("max_series_soft", F.lit(0)) > 0) & (F.col("tenant_series") > F.col("max_series_soft")))
        .withColumn("over_hard", (F.coalesce("max_series", F.lit(0)) > 0) & (F.col("tenant_series") > F.col("max_series")))
        .withColumn("over_soft", F.coalesce("over_soft", F.lit(False)))
        .withColumn("over_hard", F.coalesce("over_hard", F.lit(False)))
    )


# --- byte budgets ----------------------------------------------------------------------------


def limit_in_flight(
    df: DataFrame,
    max_bytes: int | None,
    flush_interval_us: int,
    key: tuple[str, ...] = ("tenant",),
    ts: str = "ts",
    order: tuple[str, ...] = ("arrival_seq",),
    nbytes: str = "nbytes",
) -> DataFrame:
    """`df` plus `epoch` and `verdict`: bytes buffered since the last flush stay within the cap.

    Backpressure latches: the first row that does not fit is shed with everything after it, until
    the next flush. That makes the verdict a running sum, which needs no sequential kernel.
    """
    epochs = df.withColumn("epoch", from_us(bucket_us(epoch_us(ts), flush_interval_us)))
    if not max_bytes:
        return epochs.withColumn("verdict", F.lit(ACCEPTED))
    totals = running_total(epochs, [*key, "epoch"], [ts, *order], F.col(nbytes), "_used")
    return totals.withColumn("verdict", F.when(F.col("_used") <= max_bytes, F.lit(ACCEPTED)).otherwise(F.lit(SHED))).drop("_used")


def _run_kernel(rows: DataFrame, heads: DataFrame, key: list[str], order: list[str], out: T.StructType, tag: bool) -> DataFrame:
    """Run the bucket over `rows`; `heads` has a row for each of their stretches, and `_run` for those that run in one sequence."""
    body = rows.withColumn("_head", F.lit(0))
    return (
        body.unionByName(heads.withColumn("_head", F.lit(1)), allowMissingColumns=True)
        .repartition(*key, "_run")
        .sortWithinPartitions(*key, "_run", PART, F.col("_head").desc(), "_us", *order)
        .mapInArrow(bucket_kernel([*key, PART], tag), out)
    )


def _credit_at_start() -> Column:
    """Credit (`_level` at `_since`) as a stretch's first row at `_us0` finds it: what was left, refilled up to the rate."""
    at = F.greatest("_since", "_us0")
    # Whole bytes on the absolute clock; from two seconds on it is full either way.
    refill = F.expr(f"(_us0 div {SECOND} - _since div {SECOND}) * _rate + (_us0 % {SECOND}) * _rate div {SECOND} - (_since % {SECOND}) * _rate div {SECOND}")
    level = F.when(F.col("_us0") <= F.col("_since"), F.col("_level")).when(F.col("_since") < F.col("_us0") - 2 * SECOND, F.col("_rate"))
    return F.struct(level.otherwise(F.least("_rate", F.col("_level") + refill)).alias("level"), at.alias("at"))


# Rounds that run all moved stretches side by side, and the stretches of a run after them: what one task may hold.
_WIDE_ROUNDS = 2
_RUN_LENGTH = 16


def limit_rate(
    df: DataFrame,
    bytes_per_second: int | Column | None,
    key: tuple[str, ...] = ("tenant",),
    ts: str = "ts",
    order: tuple[str, ...] = ("arrival_seq",),
    nbytes: str = "nbytes",
    rows_per_task: int | None = None,
) -> DataFrame:
    """`df` plus `verdict` under a token bucket per key, every key starting with full credit."""
    if bytes_per_second is None or isinstance(bytes_per_second, int) and not bytes_per_second:
        return df.withColumn("verdict", F.lit(ACCEPTED))
    return limit_rate_from(df, None, bytes_per_second, key, ts, order, nbytes, rows_per_task)[0]


def limit_rate_by_policy(
    df: DataFrame,
    policies: DataFrame,
    key: tuple[str, ...] = ("tenant",),
    ts: str = "ts",
    order: tuple[str, ...] = ("arrival_seq",),
    nbytes: str = "nbytes",
    rows_per_task: int | None = None,
) -> DataFrame:
    """`limit_rate` with every tenant's own rate; no policy row, no rate or a rate of 0 is no limit.

    With more in the key than the tenant, each of the tenant's keys has the whole rate.
    """
    rates = policies.select("tenant", F.col("limits.ingest_bytes_per_second").alias("_limit"))
    with_rate = df.join(rates, "tenant", "left").select(*df.columns, "_limit")
    return limit_rate(with_rate, F.col("_limit"), key, ts, order, nbytes, rows_per_task).drop("_limit")


def limit_rate_from(
    df: DataFrame,
    credit: DataFrame | None,
    bytes_per_second: int | Column,
    key: tuple[str, ...] = ("tenant",),
    ts: str = "ts",
    order: tuple[str, ...] = ("arrival_seq",),
    nbytes: str = "nbytes",
    rows_per_task: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """`df` plus `verdict`, and the credit `(key, level, since)` left per key.

    `bytes_per_second` is one rate or a column that is the same in all rows of a key (null or 0: no
    limit). `credit` is what an earlier call left; keys without a row start full. A key may save up one
    second of its rate, and shed rows spend nothing.

    A verdict depends on every row before it, yet a key may hold a third of all rows. Rows are written
    in stretches of (key, time, order) that run side by side, each from a guessed start (full credit);
    the credit at the end of a stretch becomes the next one's start, and stretches whose start moved run
    again, until none moves. A stretch that runs again stops where its credit meets what an earlier run
    noted down, as all after it would repeat. Credit forgets its past whenever it fills up, so a key
    within its budget settles in the first or second round. A key that stays over its budget without a pause may
    keep its past: from the third round on its first unsettled stretches run in one sequence, sixteen at
    a time. Every round settles at least one more stretch of each key, so the result is the row-by-row
    one; the admission key (tenant and shard, say) sets how much of an overload runs in parallel.

    A round reads time, order and size of its own stretches only: each has a directory, and the join
    prunes the others. A row without a time or a size is accepted and spends nothing. Rows of equal time
    and order follow one another by their hash.
    """
    key, order = list(key), list(order)
    state = [*key, PART]
    us = epoch_us(ts)
    rate = bytes_per_second if isinstance(bytes_per_second, Column) else F.lit(int(bytes_per_second))
    # A row without a time spends nothing and stands before all others.
    cost = F.when(us.isNull(), F.lit(0)).otherwise(F.coalesce(F.col(nbytes).cast("long"), F.lit(0)))
    ready = df.withColumns({"_us": F.coalesce(us, F.lit(0).cast("long")), "_cost": cost.cast("long"), "_rate": F.coalesce(rate.cast("long"), F.lit(0).cast("long"))})
    full = spread(ready, key, ["_us", *order], rows_per_task, apart=True)
    order = [*order, TIE]
    rows = full.select(*state, "_us", "_cost", *dict.fromkeys(order))

    in_key = Window.partitionBy(*key).orderBy(PART)
    cells = full.groupBy(*state).agg(F.max("_rate").alias("_rate"), F.min("_us").alias("_us0"))
    if credit is None:
        cells = cells.withColumns({"_level0": F.col("_rate"), "_since0": F.lit(NEVER)})
    else:
        left = cells.alias("n").join(credit.alias("c"), same_key("n", "c", key), "left")
        cells = left.select("n.*", F.coalesce("c.level", "n._rate").alias("_level0"), F.coalesce("c.since", F.lit(NEVER)).alias("_since0"))
    # One row per stretch and key: where the key starts, and whether this stretch is its first.
    cells = stage(cells.withColumn("_nth", F.row_number().over(in_key)), "bucket-cells")
    guess = F.when(F.col("_nth") == 1, F.col("_level0")).otherwise(F.col("_rate"))
    nothing = {"_path": F.lit(None).cast("array<long>"), "_end_level": F.lit(None).cast("long"), "_end_us": F.lit(None).cast("long")}
    heads = cells.select(*state, "_rate", guess.alias("_level"), F.col("_since0").alias("_since"), F.col(PART).alias("_run")).withColumns(nothing)
    longs = [T.StructField(c, T.LongType()) for c in ("_level", "_since", "_end_level", "_end_us")]
    end_schema = T.StructType([*(full.schema[c] for c in state), *longs, T.StructField("_path", T.ArrayType(T.LongType()))])
    chosen, ends, again = rows.withColumn("_run", F.col(PART)), None, None
    for done in itertools.count(1):
        fresh = _run_kernel(chosen, heads, key, order, end_schema, tag=False)
        if ends is not None:
            # Stretches that did not run again keep their end.
            fresh = fresh.unionByName(ends.alias("e").join(again.alias("a"), same_key("e", "a", state), "left_anti"))
        ends = stage(fresh, "bucket-ends")
        known = ends.alias("e").join(cells.alias("c"), same_key("e", "c", state)).select("e.*", "c._rate", "c._us0", "c._level0", "c._since0")
        follow = known.withColumns(
            {
                "_used": _credit_at_start(),
                "_level": F.coalesce(F.lag("_end_level").over(in_key), F.col("_level0")),
                "_since": F.coalesce(F.lag("_end_us").over(in_key), F.col("_since0")),
            }
        )
        follow = follow.withColumn("_moved", (F.col("_rate") > 0) & (F.col("_used") != _credit_at_start()))
        # Everything before a key's first moved stretch is settled, so its start is exact.
        first = F.min(F.when(F.col("_moved"), F.col(PART))).over(Window.partitionBy(*key))
        later = follow.withColumn("_first", first).where(F.col(PART) >= F.col("_first"))
        if done < _WIDE_ROUNDS:
            later = later.where("_moved").withColumn("_run", F.col(PART))
        else:
            later = later.withColumn("_nth", F.row_number().over(in_key)).where(F.col("_nth") <= _RUN_LENGTH)
            later = later.withColumn("_run", F.col("_first"))
            # Only the first of a run knows its start; the others carry on.
            later = later.withColumn("_level", F.when(F.col("_nth") == 1, F.col("_level")))
        again = stage(later.select(*state, "_run", "_rate", "_level", "_since", "_path", "_end_level", "_end_us"), "bucket-again")
        if again.isEmpty():
            break
        heads = again
        # `_run` is never null; the condition tells the planner that this side is worth pruning by.
        own = again.where(F.col("_run") >= 0).select(*state, "_run")
        chosen = rows.alias("n").join(own.alias("a"), same_key("n", "a", key) & (F.col(f"n.{PART}") == F.col(f"a.{PART}"))).select("n.*", "a._run")
    tagged = T.StructType([*df.schema.fields, T.StructField("verdict", T.StringType())])
    left = ends.groupBy(*key).agg(F.max_by("_end_level", PART).alias("level"), F.max_by("_end_us", PART).alias("since"))
    heads = follow.select(*state, "_rate", "_level", "_since", F.col(PART).alias("_run")).withColumns(nothing)
    return _run_kernel(full.withColumn("_run", F.col(PART)), heads, key, order, tagged, tag=True), left


def same_key(left: str, right: str, columns: list[str]) -> Column:
    """Null-safe equality: a row without a key still belongs to one."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


# --- partial success -------------------------------------------------------------------------


def partial_success(tagged: DataFrame, by: tuple[str, ...] = ("tenant", "batch"), nbytes: str = "nbytes") -> DataFrame:
    """Accepted and rejected rows and bytes per request batch, with the reason of a rejection."""
    shed = F.col("verdict") == SHED
    return (
        tagged.groupBy(*by)
        .agg(
            F.count_if(~shed).alias("accepted_rows"),
            F.count_if(shed).alias("rejected_rows"),
            F.coalesce(F.sum(F.when(~shed, F.col(nbytes))), F.lit(0)).alias("accepted_bytes"),
            F.coalesce(F.sum(F.when(shed, F.col(nbytes))), F.lit(0)).alias("rejected_bytes"),
        )
        .withColumn("reason", F.when(F.col("rejected_rows") > 0, F.lit(REASON)))
    )
