"""Series ceilings on arriving data: a kept registry of admitted series.

The registry is a table of what was admitted, a directory per arrival. Beside it stands a sketch, one
bit per admitted series in bitmaps that every arrival adds to: a series whose bit is unset is surely
new, and only one whose bit is set is looked up in the registry itself. Either way the answer is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import series_id
from ..sources.staging import stage
from .admission import OVERFLOW, OVERFLOW_LABELS, same_key, series_arrivals
from .kernels import ACCEPTED, SHED
from .scan import running_total

#: Bits of one bitmap, which Spark's bitmap aggregates fix.
_BITS = 32_768
ENTRY = ("signal", "metric", "series_id")


@dataclass(frozen=True)
class Registry:
    """Where a registry lives, its admission key, and the number of bitmaps of its sketch.

    More bitmaps than series / 3,000 keep false alarms under a tenth; fewer only cost lookups.
    """

    path: str
    key: tuple[str, ...] = ("tenant",)
    bitmaps: int = 1024

    def schema(self, samples: DataFrame) -> str:
        return ", ".join([f"{k} {samples.schema[k].dataType.simpleString()}" for k in self.key] + ["signal string, metric string, series_id string, kind string"])

    def entries(self, spark: SparkSession, schema: str, before: int) -> DataFrame:
        """Admitted series, and the metrics that have an overflow series, of all arrivals before one."""
        if not before:
            return spark.createDataFrame([], schema)
        return spark.read.schema(f"{schema}, arrival int").parquet(f"{self.path}/entries").where(F.col("arrival") < before).drop("arrival")

    def _spot(self) -> Column:
        return F.pmod(F.xxhash64(*self.key, *ENTRY), F.lit(self.bitmaps * _BITS))

    def maybe_known(self, series: DataFrame, before: int) -> DataFrame:
        """`series` plus `maybe`: false only if it surely is not registered."""
        if not before:
            return series.withColumn("maybe", F.lit(False))
        sketch = series.sparkSession.read.schema("bitmap bigint, bits binary, arrival int").parquet(f"{self.path}/sketch")
        sketch = sketch.where(F.col("arrival") < before).groupBy("bitmap").agg(F.bitmap_or_agg("bits").alias("bits"))
        spot = series.withColumn("_spot", self._spot()).withColumns({"bitmap": F.expr(f"_spot div {_BITS}"), "_bit": F.expr(f"cast(_spot % {_BITS} AS int)")})
        byte = F.expr("cast(conv(hex(substring(bits, _bit div 8 + 1, 1)), 16, 10) AS int)")
        bit = F.expr("shiftright(_byte, _bit % 8) & 1")
        probed = spot.join(sketch, "bitmap", "left").withColumn("_byte", byte)
        return probed.withColumn("maybe", F.coalesce(bit == 1, F.lit(False))).drop("_spot", "_bit", "_byte", "bits", "bitmap")

    def add(self, entries: DataFrame, arrival: int) -> None:
        """Write what an arrival admitted; a repeated arrival overwrites its own."""
        entries.write.mode("overwrite").parquet(f"{self.path}/entries/arrival={arrival}")
        spots = entries.where("kind = 'series'").select(self._spot().alias("_spot"))
        bits = spots.groupBy(F.expr(f"_spot div {_BITS}").alias("bitmap")).agg(F.bitmap_construct_agg(F.expr(f"_spot % {_BITS}")).alias("bits"))
        bits.write.mode("overwrite").parquet(f"{self.path}/sketch/arrival={arrival}")


def admit(samples: DataFrame, registry: Registry, arrival: int, limits: DataFrame, order: str = "arrival_seq") -> DataFrame:
    """`samples` plus `verdict` after the arrivals before this one, and the registry with what is new.

    `limits` has the key's columns, max_series and max_series_soft; null or 0 is unlimited, and so is a
    key without a row. A series that is registered is never shed. New ones are ranked by first arrival,
    per key and signal, behind those registered. Past the soft budget a metrics series folds into its metric's overflow series, minted in order of first overflowing arrival while
    the ceiling lasts; other signals know the ceiling only. Arrivals in order give the verdicts of one
    arrival of everything; arrival N repeated gives what it gave. Nulls are keys and series like others.
    """
    spark, key, schema = samples.sparkSession, list(registry.key), registry.schema(samples)
    series = stage(registry.maybe_known(series_arrivals(samples, registry.key, order), arrival), "arriving-series")
    entries = registry.entries(spark, schema, arrival)
    known = series.where("maybe").alias("s").join(entries.where("kind = 'series'").alias("e"), same_key("s", "e", [*key, *ENTRY]), "left_semi")
    # Exact confirmation for the flagged only: what the lookup misses is a false alarm of the sketch.
    fresh = series.alias("s").join(known.alias("k"), same_key("s", "k", [*key, *ENTRY]), "left_anti").drop("maybe")
    group = [*key, "signal"]
    kept = entries.groupBy(*group).agg(F.count_if(F.col("kind") == "series").alias("_series"), F.count_if(F.col("kind") == OVERFLOW).alias("_minted"))
    budget = limits.select(*key, F.nullif(F.col("max_series"), F.lit(0)).cast("long").alias("_hard"), F.nullif(F.col("max_series_soft"), F.lit(0)).cast("long").alias("_soft"))
    ranked = running_total(stage(fresh, "fresh-series"), group, ["first_seq", "series_id"], F.lit(1), "_rank")
    ranked = _beside(_beside(ranked, kept, group), budget, key)
    place = F.col("_rank") + F.coalesce("_series", F.lit(0))
    soft = F.when((F.col("signal") == "metrics") & F.col("_hard").isNotNull(), F.col("_soft"))
    ranked = stage(ranked.withColumns({"_in": F.coalesce(place <= F.coalesce(soft, F.col("_hard")), F.lit(True)), "_folds": F.coalesce(place > soft, F.lit(False))}), "ranked-series")
    # Metrics without an overflow series yet, in order of their first overflowing arrival.
    minted = entries.where(F.col("kind") == OVERFLOW).select(*key, "metric")
    wanted = ranked.where("_folds").groupBy(*key, "metric").agg(F.min("first_seq").alias("_first"), F.first("_hard").alias("_hard"), F.first("_soft").alias("_soft"), F.max(F.coalesce("_minted", F.lit(0))).alias("_minted"))
    wanted = stage(wanted.alias("w").join(minted.alias("m"), same_key("w", "m", [*key, "metric"]), "left_anti"), "wanted-metrics")
    mint = running_total(wanted, key, ["_first", "metric"], F.lit(1), "_m").where(F.col("_m") + F.col("_minted") <= F.col("_hard") - F.col("_soft")).select(*key, "metric")
    folding = stage(minted.unionByName(mint), "overflow-metrics")
    out = ranked.where("not _in").alias("r").join(folding.withColumn("_over", F.lit(OVERFLOW)).alias("f"), same_key("r", "f", [*key, "metric"]), "left")
    verdicts = stage(out.select(*[f"r.{c}" for c in [*key, *ENTRY]], F.when(F.col("r._folds"), F.coalesce("f._over", F.lit(SHED))).otherwise(SHED).alias("verdict")), "series-verdicts")
    admitted = ranked.where("_in").select(*key, *ENTRY, F.lit("series").alias("kind"))
    overflow = mint.select(*key, F.lit("metrics").alias("signal"), "metric", F.lit(None).cast("string").alias("series_id"), F.lit(OVERFLOW).alias("kind"))
    registry.add(admitted.unionByName(overflow), arrival)
    tagged = samples.alias("d").join(verdicts.alias("v"), same_key("d", "v", [*key, *ENTRY]), "left").select("d.*", F.coalesce("v.verdict", F.lit(ACCEPTED)).alias("verdict"))
    return _folded(tagged)


def _beside(rows: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    columns = [c for c in more.columns if c not in key]
    return rows.alias("a").join(more.alias("b"), same_key("a", "b", key), "left").select("a.*", *[f"b.{c}" for c in columns])


def _folded(tagged: DataFrame) -> DataFrame:
    """Rows of an overflow series with the overflow labels and identity."""
    marker, folds = F.create_map(*[F.lit(x) for kv in OVERFLOW_LABELS.items() for x in kv]), F.col("verdict") == OVERFLOW
    own = series_id(F.col("tenant"), F.col("metric"), marker)
    tagged = tagged.withColumn("series_id", F.when(folds, own).otherwise(F.col("series_id")))
    return tagged.withColumn("labels", F.when(folds, marker).otherwise(F.col("labels"))) if "labels" in tagged.columns else tagged


def policy_limits(policies: DataFrame) -> DataFrame:
    """tenant, max_series and max_series_soft of a policy table."""
    return policies.select("tenant", F.col("limits.max_series").alias("max_series"), F.col("limits.max_series_soft").alias("max_series_soft"))
