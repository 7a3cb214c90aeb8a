"""Streaming replica reconciliation that waits for the primary's copy."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.timeline import epoch_us

# Ship the processor with the job: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _opened(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


class PrimaryFirst(StatefulProcessor):
    """One row per (series, time): the primary's at once, else the first node's when the watermark passes the time.

    Per slot of series it holds two tables: points still waiting with their best copy, and, as numbers of
    series and times only, the points already given out, so that their later copies are dropped. Both go
    when the watermark passes them, so the state is what the delay covers. A batch sorts its own copies
    and the waiting ones; points given out are only looked up.
    """

    def __init__(self, columns: list[str], series_type: pa.DataType):
        self.columns, self.series_type = columns, series_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "waiting binary, sent binary")

    def _settle(self, rows: list[pd.DataFrame], watermark_ms: int):
        """Rows to give out now; the rest is held, with a timer for the earliest point."""
        passed, held = watermark_ms * 1000, self.held.get()
        if held:
            rows, sent = [_opened(held[0]).to_pandas(), *rows], _opened(held[1])
        else:
            sent = pa.table({"series": pa.array([], self.series_type).dictionary_encode(), "us": pa.array([], pa.int64())})
        rows = pd.concat([x for x in rows if len(x)] or rows[:1], ignore_index=True)
        own = pa.array(rows["series_id"], self.series_type, from_pandas=True).dictionary_encode()
        series = pa.chunked_array([*sent["series"].chunks, own]).unify_dictionaries().combine_chunks()
        code = series.indices.fill_null(-1).to_numpy()
        us = np.concatenate([sent["us"].to_numpy(), rows["us_"].to_numpy(np.int64)])
        before, second = len(sent), rows["second_"].to_numpy(bool)
        node = pd.factorize(rows["node"], sort=True)[0]
        order = np.lexsort((np.where(node < 0, len(node), node), second, us[before:], code[before:]))
        c, u = code[before:][order], us[before:][order]
        best = order[np.append(True, (c[1:] != c[:-1]) | (u[1:] != u[:-1]))[: len(order)]]
        points = np.concatenate([np.arange(before), before + best])
        best = best[~pd.DataFrame({"code": code[points], "us": us[points]}).duplicated().to_numpy()[before:]]
        old, second = us[before:][best] <= passed, second[best]
        kept, late = np.concatenate([np.flatnonzero(us[:before] > passed), before + best[~old & ~second]]), best[~old & second]
        ahead = np.concatenate([us[kept], us[before:][late]])
        if len(ahead):
            # Numbered again, so that series that are gone do not stay.
            given = pa.table({"series": series.take(pa.array(kept)).dictionary_decode().dictionary_encode(), "us": us[kept]})
            self.held.update((_packed(pa.Table.from_pandas(rows.iloc[late][[*self.columns, "second_", "us_"]], preserve_index=False)), _packed(given)))
            self.handle.registerTimer(max(watermark_ms + 1, -(-int(ahead.min()) // 1000)))
        elif held:
            self.held.clear()
        return rows.iloc[best[old | ~second]][self.columns]

    def handleInputRows(self, key, rows, timerValues):
        yield self._settle(list(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.held.exists():
            yield self._settle([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def dedup_stream_primary(copies: DataFrame, primaries: DataFrame, delay_us: int, shard_key: tuple[str, ...] = ("tenant", "shard"), slots: int = 64) -> DataFrame:
    """One row per (series_id, ts) of a stream of copies: the primary's, else that of the first node by name.

    `primaries` is (tenant, shard, node). A copy of a secondary waits until the primary's comes or the
    watermark, `delay_us` behind the newest time, passes it; copies behind the watermark are dropped. So
    arrivals in any order within the delay give the table job's rows, and the state holds what the delay
    covers: two tables for each of `slots`, rewritten when its series have rows, so take as many as keep them within
    some megabytes (a point given out takes 12 bytes and its series' name once). Needs the session's state store to be `STORE`. Copies without a time or a node come after all others of their point;
    those without a time are dropped, as no watermark passes them.
    """
    columns = copies.columns
    marked = copies.where("ts is not null").withWatermark("ts", f"{delay_us} microseconds").join(primaries.select(*shard_key, F.col("node").alias("_primary")), [*shard_key], "left")
    # Names with a leading underscore do not survive the way to pandas.
    marked = marked.select(*columns, (~F.col("node").eqNullSafe(F.col("_primary"))).alias("second_"), epoch_us("ts").alias("us_"))
    slot = F.pmod(F.xxhash64("series_id"), F.lit(slots))
    return marked.withColumn("slot_", slot).groupBy("slot_").transformWithStateInPandas(
        statefulProcessor=PrimaryFirst(columns, to_arrow_type(copies.schema["series_id"].dataType)), outputStructType=copies.schema, outputMode="Append", timeMode="EventTime"
    )
