"""Reads over several copies of the same samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

POINT = ("series_id", "ts")


def dedup_replicas(df: DataFrame, primaries: DataFrame, shard_key: tuple[str, ...] = ("tenant", "shard"), point: tuple[str, ...] = POINT) -> DataFrame:
    """One row per (series, ts): the primary's copy, else the copy of the first node by name.

    `primaries` is (tenant, shard, node). A minimum by rank keeps one candidate per point on the map
    side, so a point with very many copies is no hot spot, which a row_number window would make it.
    """
    rest = [c for c in df.columns if c not in point]
    ranked = df.join(primaries.select(*shard_key, F.col("node").alias("_primary")), [*shard_key], "left")
    rank = F.struct((~F.col("node").eqNullSafe(F.col("_primary"))).alias("second"), F.col("node").alias("node"))
    kept = ranked.groupBy(*point).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return kept.select(*point, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def quorum_audit(df: DataFrame, rf: int, point: tuple[str, ...] = POINT) -> DataFrame:
    """Points with too few copies for a quorum, or with copies that disagree.

    Disagreement is min <> max, so only the node count needs a distinct.
    """
    quorum = rf // 2 + 1
    return (
        df.groupBy(*point)
        .agg(F.count_distinct("node").alias("copies"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count_if(F.col("value").isNull()).alias("_nulls"))
        .withColumn("below_quorum", F.col("copies") < quorum)
        .withColumn("disagree", F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)) | ((F.col("_nulls") > 0) & F.col("_lo").isNotNull()))
        .filter("below_quorum or disagree")
        .select(*point, "copies", "below_quorum", "disagree")
    )
