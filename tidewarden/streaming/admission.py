"""Streaming admission: a budget per key, carried from micro-batch to micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.timeline import bucket_us, epoch_us
from ..operators.admission import limit_rate_from, same_key
from ..operators.kernels import in_flight_state, rate_state
from ..sources.staging import stage
from .ingest import flushed


def _with_cost(stream: DataFrame, ts: str, nbytes: str) -> DataFrame:
    return stream.withColumns({"_us": epoch_us(ts), "_cost": F.col(nbytes).cast("long")})


def _tagged(stream: DataFrame) -> T.StructType:
    return T.StructType([*stream.schema.fields, T.StructField("verdict", T.StringType())])


def limit_rate_stream(
    stream: DataFrame, bytes_per_second: int, key: tuple[str, ...] = ("tenant",), ts: str = "ts", order: tuple[str, ...] = ("arrival_seq",), nbytes: str = "nbytes"
) -> DataFrame:
    """`stream` plus `verdict` under a token bucket per key.

    Rows are ordered inside a micro-batch, and batches follow one another; a row that arrives after
    later ones were decided is decided on arrival. A key's rows of one micro-batch are sorted in one
    task, which a bounded batch (`files_per_batch`) and many keys keep small; with a tenant that may
    fill the batch by itself use `write_rate_limited`.
    """
    return (
        _with_cost(stream, ts, nbytes)
        .groupBy(*key)
        .applyInPandasWithState(
            rate_state(int(bytes_per_second), list(order), stream.columns), _tagged(stream), "level long, since long", "append", GroupStateTimeout.NoTimeout
        )
    )


def limit_in_flight_stream(
    stream: DataFrame,
    max_bytes: int,
    flush_interval_us: int,
    key: tuple[str, ...] = ("tenant",),
    ts: str = "ts",
    order: tuple[str, ...] = ("arrival_seq",),
    nbytes: str = "nbytes",
) -> DataFrame:
    """`stream` plus `verdict`: bytes since the last flush stay within the cap.

    As with `limit_rate_stream`, a key's rows of one micro-batch are sorted in one task: bound the
    batch, and put the shard into the key of a busy tenant.
    """
    epochs = _with_cost(stream, ts, nbytes).withColumn("_epoch", bucket_us(epoch_us(ts), flush_interval_us))
    return epochs.groupBy(*key).applyInPandasWithState(
        in_flight_state(int(max_bytes), list(order), stream.columns), _tagged(stream), "epoch long, used long", "append", GroupStateTimeout.NoTimeout
    )


def write_rate_limited(
    stream: DataFrame,
    path: str,
    bytes_per_second: int,
    checkpoint: str,
    flush_us: int | None = None,
    key: tuple[str, ...] = ("tenant",),
    ts: str = "ts",
    order: tuple[str, ...] = ("arrival_seq",),
    nbytes: str = "nbytes",
) -> StreamingQuery:
    """Tagged rows to `path/rows`, one directory per batch, for keys of any size.

    Each micro-batch runs the table job, which cuts a large key into stretches. The credit left goes to
    `path/credit/batch=N`, where the next batch picks it up; a replayed batch starts from the same
    credit and overwrites its own output.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        before = batch.sparkSession.read.parquet(f"{path}/credit/batch={batch_id - 1}") if batch_id else None
        tagged, left = limit_rate_from(stage(batch, "bucket-batch"), before, bytes_per_second, key, ts, order, nbytes)
        if before is not None:
            silent = before.alias("b").join(left.alias("l"), same_key("b", "l", list(key)), "left_anti")
            left = left.unionByName(silent)
        tagged.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        left.write.mode("overwrite").parquet(f"{path}/credit/batch={batch_id}")

    return flushed(stream.writeStream.foreachBatch(write), checkpoint, flush_us).start()
