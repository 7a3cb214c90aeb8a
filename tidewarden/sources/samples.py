"""Reading files as samples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import series_id_of
from ..functions.timeline import utc_timestamps


@dataclass(frozen=True)
class Mapping:
    """How the columns of a file become a sample; values are SQL expressions over the file."""

    tenant: str
    metric: str
    ts: str
    value: str
    labels: dict[str, str] = field(default_factory=dict)
    signal: str = "'metrics'"
    arrival_seq: str = "0"
    nbytes: str = "0"
    keep: tuple[str, ...] = ()


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A file-backed table with its timestamps as instants, so time filters reach the scan."""
    if fmt not in ("parquet", "orc"):
        raise ValueError("columnar files only: parquet or orc")
    found = spark.read.format(fmt).load(path).schema
    return spark.read.format(fmt).schema(utc_timestamps(found)).load(path)


def as_samples(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Project a table to the sample schema; unused columns never leave the scan."""
    labels: dict[str, Column] = {k: F.expr(v).cast("string") for k, v in sorted(mapping.labels.items())}
    tenant, metric = F.expr(mapping.tenant), F.expr(mapping.metric)
    entries = [x for k, v in labels.items() for x in (F.lit(k), v)]
    label_map = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return df.select(
        tenant.alias("tenant"),
        F.expr(mapping.signal).alias("signal"),
        metric.alias("metric"),
        label_map.alias("labels"),
        series_id_of(tenant, metric, labels).alias("series_id"),
        F.expr(mapping.ts).alias("ts"),
        F.expr(mapping.value).cast("double").alias("value"),
        F.expr(mapping.arrival_seq).cast("long").alias("arrival_seq"),
        F.expr(mapping.nbytes).cast("long").alias("nbytes"),
        *mapping.keep,
    )


def read_samples(spark: SparkSession, path: str, mapping: Mapping, fmt: str = "parquet") -> DataFrame:
    return as_samples(read_table(spark, path, fmt), mapping)
