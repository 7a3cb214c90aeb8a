"""Size-bounded parts and cold recompression."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timeline import DAY, instant, micros
from ..operators.retention import partition_of
from ..operators.scan import running_total

DEFAULT_LEVEL = 19
PART_KEY = ("tenant", "dt")


def assign_parts(
    df: DataFrame, max_part_bytes: int, by: tuple[str, ...] = PART_KEY, order: tuple[str, ...] = ("ts", "arrival_seq"), nbytes: str = "nbytes"
) -> DataFrame:
    """`df` plus `part_id`: rows fill parts in time order up to an approximate size.

    A part is the running byte count, the row itself left out, divided by the cap, so a part passes
    the cap by one row at most. The count is a scan over range partitions: a huge tenant-day is spread over many tasks.
    """
    if max_part_bytes <= 0:
        raise ValueError("the part size must be positive")
    df = df if "dt" in df.columns else df.withColumn("dt", partition_of("ts"))
    total = running_total(df, list(by), list(order), F.col(nbytes), "_total")
    return total.withColumn("part_id", F.call_function("div", F.col("_total") - F.col(nbytes), F.lit(max_part_bytes).cast("long"))).drop("_total")


def write_parts(
    df: DataFrame,
    path: str,
    max_part_bytes: int,
    by: tuple[str, ...] = PART_KEY,
    level: int | None = None,
    mode: str = "append",
    order: tuple[str, ...] = ("ts", "arrival_seq"),
) -> None:
    """Write so that no file exceeds a part: each (partition, part) goes to one task, one file.

    A part is bounded by its cap, so no task is large, and rows inside a file are in time order.
    """
    write_assigned(assign_parts(df, max_part_bytes, by, order), path, by, level, mode)


def write_assigned(parts: DataFrame, path: str, by: tuple[str, ...] = PART_KEY, level: int | None = None, mode: str = "append") -> None:
    """Write rows that have a `part_id`, each part as one file."""
    day = parts.withColumn("dt", F.to_date("dt")) if dict(parts.dtypes)["dt"].startswith("timestamp") else parts
    writer = (
        day.repartition(*by, "part_id")
        .sortWithinPartitions(*by, "part_id", "ts")
        .write.mode(mode)
        .partitionBy(*by, "part_id")
        .option("compression", "zstd")
    )
    if level is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", str(level))
    writer.parquet(path)


def cold_parts(df: DataFrame, after_us: int, as_of: datetime | int, by: tuple[str, ...] = PART_KEY, ts: str = "ts") -> DataFrame:
    """Parts whose newest row is older than `after`. Reads the part key and the time only.

    A part that begins at the cut-off or later cannot be cold: a literal bound leaves it out of the scan.
    """
    if after_us <= 0:
        raise ValueError("the recompression age must be positive")
    cut = micros(as_of) - after_us
    day = -(-cut // DAY)
    kind = dict(df.dtypes).get("dt")
    if kind is None:
        df = df.filter(F.col(ts) < instant(day * DAY)).withColumn("dt", partition_of(ts))
    elif "dt" in by and kind == "date":
        df = df.filter(F.col("dt") < F.lit(date(1970, 1, 1) + timedelta(days=day)))
    elif "dt" in by and kind.startswith("timestamp"):
        df = df.filter(F.col("dt") < instant(cut))
    return (
        df.groupBy(*by)
        .agg(F.max(ts).alias("newest"), F.count("*").alias("n_rows"))
        .filter(F.col("newest") < instant(cut))
    )


def recompress(
    spark: SparkSession, source: str, target: str, after_us: int, level: int | None, as_of: datetime | int, by: tuple[str, ...] = PART_KEY
) -> DataFrame:
    """Rewrite the fully cold parts of a table partitioned by `by` with zstd; content is unchanged.

    Returns the parts rewritten; a part without a key is left alone. A second run replaces its own
    output. Only their directories are read: the part list is joined on the
    partition columns, which Spark turns into dynamic partition pruning. The unset level is the best
    ratio.
    """
    level = DEFAULT_LEVEL if level is None else level
    if not 1 <= level <= 19:
        raise ValueError("the zstd level must be within 1..19")
    table = spark.read.parquet(source)
    cold = cold_parts(table, after_us, as_of, by).dropna(subset=list(by))
    rows = table.join(cold.select(*by), list(by), "left_semi")
    (
        # No shuffle: tasks split files by size, so a large partition is many tasks.
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", str(level))
        .parquet(target)
    )
    return cold
