"""Rows that come too late for the streaming rollup, repaired from the samples.

The rollup drops what lies behind its watermark. Beside it the samples are kept, with a table of dirty
buckets: those that a row may have missed. A repair works out the dirty buckets, and those still open
at the end, from the samples, reading only the days they lie in; a reader prefers repaired buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tiers import RollupTier
from ..functions.timeline import DAY, bucket_us, epoch_us, from_us
from ..operators.rollup import ARRIVAL, SERIES, _aggregate, _order
from ..sources.staging import stage
from .aggregates import rollup_stream
from .ingest import flushed


def _day(us):
    return F.date_format(from_us(bucket_us(us, DAY)), "yyyy-MM-dd")


def write_samples_and_dirt(stream: DataFrame, path: str, tier: RollupTier, delay_us: int, checkpoint: str, flush_us: int | None = None) -> StreamingQuery:
    """Samples to `path/raw` by day and batch, and the buckets that may have missed a row to `path/dirty`.

    A row counts as late if its bucket closed before the newest time seen so far, its own batch
    included, less the delay. The rollup has seen no more than that when it meets the row, however
    it cuts its batches, so every dropped row's bucket is dirty; a bucket too many costs work only.
    A replayed batch overwrites its own output. Samples without a time are kept and make nothing dirty.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = stage(batch.withColumn("day", F.coalesce(_day(epoch_us("ts")), F.lit("none"))), "arrived")
        dynamic = rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        dynamic.partitionBy("day", "batch").parquet(f"{path}/raw")
        newest = rows.agg(F.max(epoch_us("ts"))).first()[0]
        seen = spark.read.parquet(f"{path}/newest/batch={batch_id - 1}").first()["us"] if batch_id else None
        newest = max((x for x in (newest, seen) if x is not None), default=None)
        spark.createDataFrame([(newest,)], "us bigint").write.mode("overwrite").parquet(f"{path}/newest/batch={batch_id}")
        if newest is None:
            dirty = rows.limit(0)
        else:
            dirty = rows.where(bucket_us(epoch_us("ts"), tier.interval_us) + tier.interval_us <= newest - delay_us)
        buckets = dirty.select(bucket_us(epoch_us("ts"), tier.interval_us).alias("bucket_us")).distinct()
        buckets.write.mode("overwrite").parquet(f"{path}/dirty/batch={batch_id}")

    return flushed(stream.writeStream.foreachBatch(write), checkpoint, flush_us).start()


def write_rolled(stream: DataFrame, path: str, tier: RollupTier, delay_us: int, checkpoint: str, flush_us: int | None = None) -> StreamingQuery:
    """Closed buckets of the streaming rollup to `path/rolled`, a directory per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rolled/batch={batch_id}")

    rolled = rollup_stream(stream, tier, delay_us)
    return flushed(rolled.writeStream.outputMode("append").foreachBatch(write), checkpoint, flush_us).start()


def repair(spark: SparkSession, path: str, tier: RollupTier, delay_us: int, keys: tuple[str, ...] = SERIES, order_cols: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """Work out dirty and open buckets from the samples of their days; returns the buckets (`bucket_us`).

    Days come to the driver as text, one for each day touched. A repair may be repeated at any time.
    """
    newest = spark.read.parquet(f"{path}/newest").orderBy(F.desc("batch")).first()["us"]
    width = tier.interval_us
    dirty = spark.read.parquet(f"{path}/dirty").select("bucket_us")
    if newest is not None:  # buckets that the stream has not closed
        first = (newest - delay_us) // width * width
        days = F.sequence(F.lit(max(first, newest - newest % width - 10**15)), F.lit(newest - newest % width), F.lit(width))
        dirty = dirty.unionByName(spark.range(1).select(F.explode(days).alias("bucket_us")))
    buckets = stage(dirty.distinct(), "dirty-buckets")
    days = [r["day"] for r in buckets.select(F.explode(F.array(_day(F.col("bucket_us")), _day(F.col("bucket_us") + width - 1))).alias("day")).distinct().collect()]
    raw = spark.read.parquet(f"{path}/raw").where(F.col("day").isin(days)).withColumn("bucket_us", bucket_us(epoch_us("ts"), width))
    again = raw.join(buckets, "bucket_us", "left_semi").groupBy(*keys, "bucket_us").agg(_aggregate(tier.aggregate, "value", _order("ts", order_cols)).alias("value"))
    again.write.mode("overwrite").parquet(f"{path}/repaired")
    return buckets


def read_repaired(spark: SparkSession, path: str, tier: RollupTier, buckets: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """The rollup as of the last repair: streamed buckets, but repaired ones from the samples."""
    rolled = spark.read.parquet(f"{path}/rolled").withColumn("bucket_us", epoch_us("ts")).join(buckets, "bucket_us", "left_anti").select(*keys, "bucket_us", "value")
    rows = rolled.unionByName(spark.read.parquet(f"{path}/repaired").select(*keys, "bucket_us", "value"))
    return rows.select(*keys, from_us(F.col("bucket_us")).alias("ts"), "value", F.lit(tier.interval_us).cast("long").alias("resolution_us"))
