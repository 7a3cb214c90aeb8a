"""Running totals and looks back inside keys of any size, as a scan over range partitions.

Rows are dealt by the full order (key, order columns, a hash of the row), so a partition is a stretch of
that order, and a key goes over as many partitions as its rows need. Each partition works on its own
stretch; what a stretch hands on is one row per partition and key. Nothing limits the number of
partitions, and rows of one instant and arrival are spread like any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.staging import stage

#: Rows that a task should hold at most, about. The session's shuffle partitions are the least number of tasks.
ROWS_PER_TASK = 2_000_000
PART, TIE = "_part", "_tie"
_PART, _KEY, _TIE = PART, "_key", TIE


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def spread(df: DataFrame, keys: list[str], order: list[str], rows_per_task: int | None = None, apart: bool = False) -> DataFrame:
    """`df` written in stretches of (keys, order, row hash), with `_part`, which grows along that order.

    A written table keeps the stretches as they are for every later reader, lost executors or not.
    `apart` gives each stretch a directory, for readers that want few of them.
    """
    plain = [f.name for f in df.schema.fields if _hashable(f.dataType)]
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-df.count() // (rows_per_task or ROWS_PER_TASK)))
    # The key as one struct: equal when its fields are, nulls included, and never null itself.
    full = df.withColumns({_KEY: F.struct(*keys), _TIE: F.xxhash64(*plain)})
    return stage(full.repartitionByRange(parts, *keys, *order, _TIE).withColumn(_PART, F.spark_partition_id()), "scan", by=_PART if apart else None)


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, rows_per_task: int | None = None) -> DataFrame:
    """`df` plus the sum of `value` from the start of the key up to and including the row.

    Rows that are equal in all of `order` follow one another in a fixed order of their own; nulls come first.
    """
    rows = spread(df.withColumn("_v", value), keys, order, rows_per_task)
    before = (
        rows.groupBy(_PART, _KEY)
        .agg(F.sum("_v").alias("_own"))
        .withColumn("_before", F.sum("_own").over(Window.partitionBy(_KEY).orderBy(_PART)) - F.col("_own"))
        .drop("_own")
    )
    stretch = Window.partitionBy(_PART, _KEY).orderBy(*order, _TIE).rowsBetween(Window.unboundedPreceding, 0)
    total = rows.withColumn("_local", F.sum("_v").over(stretch)).join(before, [_PART, _KEY])
    return total.withColumn(out, F.col("_before") + F.col("_local")).drop("_v", "_local", "_before", _PART, _KEY, _TIE)


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, rows_per_task: int | None = None) -> DataFrame:
    """`df` plus the value of the row before, in order, within the key (null on the first row)."""
    rows = spread(df, keys, order, rows_per_task)
    carried = (
        rows.groupBy(_PART, _KEY)
        .agg(F.max_by(F.struct(value), F.struct(*order, _TIE)).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(Window.partitionBy(_KEY).orderBy(_PART)))
        .drop("_last")
    )
    stretch = Window.partitionBy(_PART, _KEY).orderBy(*order, _TIE)
    seen = rows.withColumn("_prev", F.lag(F.struct(value)).over(stretch)).join(carried, [_PART, _KEY])
    return seen.withColumn(out, F.coalesce("_prev", "_carried")[value]).drop("_prev", "_carried", _PART, _KEY, _TIE)
