"""Schemas shared by the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

SIGNALS = ("metrics", "logs", "traces", "profiles")

SAMPLES = T.StructType(
    [
        T.StructField("tenant", T.StringType()),
        T.StructField("signal", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("series_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("arrival_seq", T.LongType()),
        T.StructField("nbytes", T.LongType()),
    ]
)

RETENTION = "struct<max_age_us:bigint,max_bytes:bigint>"
LIMITS = (
    "struct<ingest_bytes_per_second:bigint,max_in_flight_bytes:bigint,"
    "max_series:bigint,max_series_soft:bigint,max_part_size:bigint>"
)
DOWNSAMPLE = "array<struct<after_us:bigint,interval_us:bigint,agg:string>>"
PRECISION = "array<struct<after_us:bigint,bits:int>>"
RECOMPRESS = "struct<after_us:bigint,level:int>"
SIGNAL_TOGGLES = "struct<metrics:boolean,logs:boolean,traces:boolean,profiles:boolean>"

# One row per tenant; absent (null) and zero differ, see the README.
POLICIES = (
    f"tenant string, retention {RETENTION}, limits {LIMITS}, downsample {DOWNSAMPLE}, "
    f"precision {PRECISION}, recompress {RECOMPRESS}, signals {SIGNAL_TOGGLES}, shards int, rf int"
)

# The same table as people write it: durations and quantities are text.
RAW_POLICIES = (
    "tenant string, max_age string, max_bytes string, ingest_bytes_per_second string, "
    "max_in_flight_bytes string, max_series bigint, max_series_soft bigint, max_part_size string, "
    "downsample array<struct<after:string,interval:string,agg:string>>, "
    "precision array<struct<after:string,bits:int>>, recompress struct<after:string,level:int>, "
    f"signals {SIGNAL_TOGGLES}, rf int, shards int"
)

# A configuration document as one row per leaf.
DOCUMENT_PATHS = "doc string, path array<string>, value_json string, kind string"
