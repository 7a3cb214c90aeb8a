"""Continuous ingest and signal fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..functions.timeline import utc_timestamps
from ..schema import SIGNALS
from ..sources.signals import served


def ingest_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 32, name_filter: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Files arriving in a directory; `files_per_batch` bounds what a micro-batch holds unflushed."""
    reader = spark.readStream.format(fmt).schema(utc_timestamps(schema)).option("maxFilesPerTrigger", files_per_batch)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.load(path)


def flushed(writer: DataStreamWriter, checkpoint: str, flush_us: int | None) -> DataStreamWriter:
    """The flush interval is the trigger: no row waits longer for its commit."""
    writer = writer.option("checkpointLocation", checkpoint)
    if flush_us is None:
        return writer.trigger(availableNow=True)
    if flush_us <= 0:
        raise ValueError("the flush interval must be positive")
    return writer.trigger(processingTime=f"{max(1, flush_us // 1000)} milliseconds")


def write_samples(stream: DataFrame, path: str, checkpoint: str, flush_us: int | None = None) -> StreamingQuery:
    """Samples to day-partitioned Parquet, exactly once."""
    day = stream.withColumn("dt", F.to_date("ts"))
    return flushed(day.writeStream.format("parquet").partitionBy("dt").outputMode("append"), checkpoint, flush_us).start(path)


def write_updates(stream: DataFrame, path: str, checkpoint: str, flush_us: int | None = None) -> StreamingQuery:
    """Aggregates whenever they change, open windows included. A replayed batch overwrites its own output."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return flushed(stream.writeStream.outputMode("update").foreachBatch(write), checkpoint, flush_us).start()


def read_updates(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The state of every key as `write_updates` last wrote it."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    values = [c for c in schema.names if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
    return newest.select(*keys, "_row.*").select(*schema.names)


def write_signal_stream(
    stream: DataFrame, path: str, toggles: dict[str, bool | None] | None, checkpoint: str, flush_us: int | None = None, nbytes: str | None = None
) -> StreamingQuery:
    """Rows of enabled signals, a directory per batch and signal, and counts of all signals in `path/_counts`, which readers of `path` pass over.

    A batch is passed over once: counters observe the rows on their way to the files. A replayed batch
    overwrites its own rows and counts, so it changes nothing. Rows of an unknown or null signal are not
    stored; they are counted as `other`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, size = batch.sparkSession, F.col(nbytes) if nbytes else F.lit(None).cast("long")
        known = F.coalesce(F.col("signal").isin(*SIGNALS), F.lit(False))
        is_one = {**{s: F.col("signal") == s for s in SIGNALS}, "other": ~known}
        counts = [x for s, one in is_one.items() for x in (F.count_if(one).alias(f"{s}_rows"), F.sum(F.when(one, size)).alias(f"{s}_bytes"))]
        seen = Observation()
        out = served(batch.observe(seen, *counts), toggles)
        out.write.mode("overwrite").partitionBy("signal").parquet(f"{path}/batch={batch_id}")
        on = {s: (toggles or {}).get(s) is not False for s in SIGNALS} | {"other": False}
        found = [(s, on[s], int(seen.get.get(f"{s}_rows") or 0), seen.get.get(f"{s}_bytes")) for s in is_one]
        table = spark.createDataFrame([r for r in found if r[2]], COUNTS)
        table.write.mode("overwrite").parquet(f"{path}/_counts/batch={batch_id}")

    return flushed(stream.writeStream.foreachBatch(write), checkpoint, flush_us).start()


COUNTS = "signal string, served boolean, n_rows bigint, n_bytes bigint"


def read_signal_counts(spark: SparkSession, path: str) -> DataFrame:
    """What `write_signal_stream` counted: a row per batch and signal met, disabled ones included."""
    return spark.read.schema(f"{COUNTS}, batch bigint").parquet(f"{path}/_counts")
