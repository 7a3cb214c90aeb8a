"""A kept pyramid of aggregates: buckets of base * 2^level per series, so that any range is a few nodes a level.

Stored under one path, partitioned by level and by the stretch of time a directory covers. A range is
answered from at most two runs of nodes per level, each a literal bound that prunes directories and row
groups; raw rows are read for the two edges only. New days rewrite the directories on their path.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.timeline import DAY, bucket_us, epoch_us, from_us, instant, micros
from .rollup import ARRIVAL, SERIES
from .sidecar import _NEEDS, _RESULT, _combine, _raw_state, build_sidecar

STATE = ["n", "s", "mn", "mx", "first_v", "first_at", "last_v", "last_at"]


@dataclass(frozen=True)
class Pyramid:
    """Where it lives, the width of level 0, the number of levels, and the time that a directory of level 0 covers.

    A directory of level j covers 2^j times as much, or what one node covers if that is more.
    """

    path: str
    base: int
    levels: int = 10
    span: int = 8 * DAY
    keys: tuple[str, ...] = SERIES
    order_cols: tuple[str, ...] = ARRIVAL

    def __post_init__(self) -> None:
        if self.base <= 0 or self.levels < 1 or self.span % self.base:
            raise ValueError("the base must be positive and divide the span, and there must be a level")

    def width(self, level: int) -> int:
        return self.base << level

    def cell(self, level: int) -> int:
        return max(self.span << level, self.width(level))

    def refresh(self, raw: DataFrame, frm: datetime | int | None = None, to: datetime | int | None = None, ts: str = "ts", value: str = "value") -> None:
        """Work out anew all nodes that samples of [frm, to) have a share in, from `raw`, and only these directories.

        Without bounds everything is built. Repeating it changes nothing. Samples without a time are in no node.
        """
        spark, column = raw.sparkSession, F.col(ts)
        start, stop = (None if x is None else micros(x) for x in (frm, to))
        below = None
        for level in range(self.levels):
            width, cell = self.width(level), self.cell(level)
            low, high = None if start is None else start // cell * cell, None if stop is None else -(-stop // cell) * cell
            if level == 0:
                bounds = [column.isNotNull()] + ([column >= instant(low)] if low is not None else []) + ([column < instant(high)] if high is not None else [])
                nodes = build_sidecar(raw.where(reduce(lambda a, b: a & b, bounds)), width, self.keys, self.order_cols, ts, value)
            else:
                # A directory here covers whole ones of the level below, which are up to date.
                nodes = self._level(spark, level - 1, below, low, high)
                up = from_us(bucket_us(epoch_us("bucket_ts"), width))
                nodes = nodes.withColumn("bucket_ts", up).groupBy(*self.keys, "bucket_ts").agg(*_combine(STATE))
            below = nodes.schema
            out = nodes.withColumn("cell", bucket_us(epoch_us("bucket_ts"), cell))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{self.path}/level={level}")

    def _level(self, spark: SparkSession, level: int, schema, low: int | None, high: int | None) -> DataFrame:
        at = F.col("cell")
        rows = spark.read.schema(f"{_ddl(schema)}, cell bigint").parquet(f"{self.path}/level={level}")
        bounds = ([at + self.cell(level) > low] if low is not None else []) + ([at < high] if high is not None else [])
        return (rows.where(reduce(lambda a, b: a & b, bounds)) if bounds else rows).drop("cell")

    def nodes(self, start: int, stop: int) -> list[tuple[int, int, int]]:
        """(level, from, to): runs of nodes that make up [start, stop), which must be whole buckets of level 0."""
        out, level = [], 0
        while start < stop:
            width, up = self.width(level), self.width(level + 1)
            if level == self.levels - 1:
                out.append((level, start, stop))
                break
            # What does not fill a node of the next level stays here: one node on each side.
            if start % up:
                out.append((level, start, start + width))
                start += width
            if start < stop and stop % up:
                out.append((level, stop - width, stop))
                stop -= width
            level += 1
        return out

    def read(self, spark: SparkSession, start: int, stop: int) -> DataFrame | None:
        rows = None
        for level, a, b in self.nodes(start, stop):
            cell = self.cell(level)
            part = spark.read.parquet(f"{self.path}/level={level}").where(
                F.col("cell").between(a // cell * cell, (b - 1) // cell * cell) & (F.col("bucket_ts") >= instant(a)) & (F.col("bucket_ts") < instant(b))
            )
            part = part.select(*self.keys, *STATE)
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def range_aggregate(
        self, raw: DataFrame, frm: datetime | int, to: datetime | int, aggs: tuple[str, ...] = ("count", "sum", "min", "max"), ts: str = "ts", value: str = "value"
    ) -> DataFrame:
        """Aggregates per series over [frm, to), as from raw rows alone; sums may differ in their last bits."""
        start, stop = micros(frm), micros(to)
        columns, t = [c for a in aggs for c in _NEEDS[a]], F.col(ts)

        def within(a: int, b: int) -> Column:
            return (t >= instant(a)) & (t < instant(b))

        first, last = -(-start // self.base) * self.base, stop // self.base * self.base
        state = _raw_state(ts, value, self.order_cols)
        if first >= last:
            parts = raw.where(within(start, stop)).select(*self.keys, *state)
        else:
            edges = raw.where(within(start, first) | within(last, stop)).select(*self.keys, *state)
            parts = edges.unionByName(self.read(raw.sparkSession, first, last))
        return parts.select(*self.keys, *columns).groupBy(*self.keys).agg(*_combine(columns)).select(*self.keys, *[F.col(_RESULT[a]).alias(a) for a in aggs])


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
