"""Driver tables as inputs of the jobs."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.tiers import AGGREGATES
from ..functions.timeline import DAY, HOUR, MINUTE
from ..operators.placement import replica_nodes, with_shard
from ..schema import POLICIES
from ..sources.samples import Mapping, as_samples, read_table

EVENTS_AS_OF = datetime(2024, 1, 31)
LINEITEM_AS_OF = datetime(2001, 12, 1)

EVENTS = Mapping(
    tenant="concat('t', user_id % 4)",
    metric="event_type",
    labels={"user": "user_id"},
    ts="ts",
    value="value",
    arrival_seq="event_id",
    nbytes="octet_length(event_type) + octet_length(props) + 24",
)
#: One tenant per aggregate.
EVENTS_BY_AGGREGATE = replace(EVENTS, tenant="concat('g', user_id % 7)")
LINEITEM = Mapping(
    tenant="concat('s', l_suppkey % 4)",
    metric="concat(l_returnflag, '/', l_linestatus)",
    labels={"supplier": "l_suppkey"},
    ts="l_shipdate",
    value="l_extendedprice",
    arrival_seq="l_orderkey",
    nbytes="32 + l_linenumber",
    keep=("l_linenumber", "l_partkey"),
)
LINEITEM_ORDER = ("arrival_seq", "l_linenumber", "l_partkey", "value")

NODES = [("n0", "z0"), ("n1", "z0"), ("n2", "z1"), ("n3", "z1"), ("n4", "z2")]
RF = 3
SHARDS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_samples(table(spark, sf_dir, "events"), EVENTS)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_samples(table(spark, sf_dir, "lineitem"), LINEITEM)


def tenant_policies(spark: SparkSession) -> DataFrame:
    """Policies of four tenants; t1 has neither retention nor precision, t2 keeps forever."""
    rows = [
        ("t0", (10 * DAY + 7 * HOUR, None), None, [(DAY, 5 * MINUTE, None), (7 * DAY, HOUR, "avg")], [(3 * DAY, 32), (7 * DAY, 16)], None, None, 4, 3),
        ("t1", None, (120, None, 150, 100, None), [(2 * DAY, 30 * MINUTE, "max")], None, None, (None, False, None, None), 4, 3),
        ("t2", (0, None), (0, None, 100, 0, None), None, [(5 * DAY, 8)], None, (None, None, False, None), None, None),
        ("t3", (20 * DAY, None), (200, None, 1000, 20, None), [(DAY, HOUR, "sum"), (10 * DAY, 6 * HOUR, "count")], [(12 * DAY, 24)], None, None, 1, 2),
    ]
    return spark.createDataFrame(rows, POLICIES)


def aggregate_policies(spark: SparkSession) -> DataFrame:
    """A tenant for each aggregate, with buckets of two days; every other one drops partitions."""
    rows = [
        (f"g{i}", (12 * DAY + 7 * HOUR if i % 2 == 0 else 0, None), None, [(DAY, HOUR, a), (5 * DAY, 2 * DAY, a)], [(6 * DAY, 24)], None, None, None, None)
        for i, a in enumerate(AGGREGATES)
    ]
    return spark.createDataFrame(rows, POLICIES)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four signals in one table: events, documents, orders and pages."""
    ev = table(spark, sf_dir, "events").selectExpr("'metrics' AS signal", "event_id AS row_id", "concat('t', user_id % 4) AS tenant", "cast(octet_length(event_type) + octet_length(props) + 24 AS bigint) AS nbytes")
    docs = table(spark, sf_dir, "documents").selectExpr("'logs' AS signal", "doc_id AS row_id", "concat('t', doc_id % 4) AS tenant", "cast(octet_length(text) AS bigint) AS nbytes")
    orders = table(spark, sf_dir, "orders").selectExpr("'traces' AS signal", "o_orderkey AS row_id", "concat('t', o_custkey % 4) AS tenant", "cast(octet_length(o_orderpriority) + 32 AS bigint) AS nbytes")
    pages = table(spark, sf_dir, "pages").selectExpr("'profiles' AS signal", "page_id AS row_id", "concat('t', page_id % 4) AS tenant", "cast(octet_length(html) AS bigint) AS nbytes")
    return ev.unionByName(docs).unionByName(orders).unionByName(pages)


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replica copies of every event: some are missing, some disagree."""
    sharded = with_shard(events(spark, sf_dir), SHARDS)
    chosen = replica_nodes(F.concat_ws("/", "tenant", "shard"), NODES, RF)
    keys = sharded.select("tenant", "shard").distinct().withColumn("_nodes", chosen)
    spread = sharded.join(keys, ["tenant", "shard"]).select(
        "tenant", "shard", "series_id", "ts", "value", "arrival_seq", F.posexplode_outer("_nodes").alias("replica", "node")
    )
    odd = (F.col("arrival_seq") % 11 == 0) & (F.col("replica") == 2)
    return (
        spread.filter((F.col("arrival_seq") + F.col("replica")) % 7 != 0)
        .withColumn("value", F.when(odd, F.col("value") + 1).otherwise(F.col("value")))
        .drop("replica")
    )


# Written once, run by both engines: policies as every customer might have typed them.
RAW_POLICY_SQL = """
SELECT 'c' || c_custkey AS tenant,
  CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN (c_custkey % 900 + 1) || 'h'
    WHEN 3 THEN (c_custkey % 50) || 'h' || (c_custkey % 60) || 'm' WHEN 4 THEN '-' || (c_custkey % 9 + 1) || 'h'
    WHEN 5 THEN '1.5h' WHEN 6 THEN (c_custkey % 90 + 1) || 'm30s250ms' ELSE '720h0m0s' END AS max_age,
  CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN (c_custkey % 500 + 1) || 'Gi' WHEN 2 THEN (c_custkey % 100) || 'M'
    WHEN 3 THEN '-' || (c_custkey % 4 + 1) || 'Gi' WHEN 4 THEN '' || (c_custkey % 1000) WHEN 5 THEN '1.5Ki'
    ELSE (c_custkey % 9 + 1) || 'e3' END AS max_bytes,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN (c_custkey % 64 + 1) || 'Mi' WHEN 2 THEN '100m' WHEN 3 THEN '-1' ELSE '2k' END
    AS ingest_bytes_per_second,
  CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '1Gi' ELSE (c_custkey % 10) || 'Gi' END AS max_in_flight_bytes,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1000 ELSE c_custkey END AS max_series,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1000 WHEN 3 THEN 2000 WHEN 4 THEN 500 ELSE -1 END AS max_series_soft,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '256Mi' WHEN 2 THEN '-256Mi' ELSE '64M' END AS max_part_size,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '6h' WHEN 2 THEN '-1h' WHEN 3 THEN '24h' ELSE '48h' END AS d0_after,
  CASE c_custkey % 4 WHEN 0 THEN '0s' WHEN 1 THEN '1m' ELSE '5m' END AS d0_interval,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'avg' WHEN 2 THEN 'last' WHEN 3 THEN 'median' WHEN 4 THEN '' ELSE 'max' END AS d0_agg,
  CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '24h' ELSE '72h' END AS d1_after,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '72h' ELSE '168h' END AS p0_after,
  c_custkey % 70 AS p0_bits,
  CASE c_custkey % 2 WHEN 0 THEN NULL ELSE '72h' END AS p1_after,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '72h' WHEN 3 THEN '-1h' ELSE '1000h' END AS r_after,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 19 ELSE c_custkey % 30 END AS r_level,
  CASE WHEN c_custkey % 11 = 0 THEN false WHEN c_custkey % 3 = 0 THEN true END AS metrics,
  CASE WHEN c_custkey % 11 = 0 THEN false WHEN c_custkey % 4 = 0 THEN false END AS logs,
  CASE WHEN c_custkey % 11 = 0 THEN false END AS traces,
  c_custkey % 11 <> 0 AS profiles,
  CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 3 END AS rf,
  CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN -1 ELSE 4 END AS shards
FROM customer
"""


def _sql(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    # A private view name: nothing of the caller's session is replaced.
    view = f"tidewarden_{name}"
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    return spark.sql(text.replace(f"FROM {name}", f"FROM {view}"))


def raw_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    flat = _sql(spark, sf_dir, RAW_POLICY_SQL, "customer")

    def tiers(*entries):
        return F.filter(F.array(*entries), lambda t: t["after"].isNotNull())

    d0 = F.struct(c("d0_after").alias("after"), c("d0_interval").alias("interval"), c("d0_agg").alias("agg"))
    d1 = F.struct(c("d1_after").alias("after"), F.lit("1h").alias("interval"), F.lit("avg").alias("agg"))
    p0 = F.struct(c("p0_after").alias("after"), c("p0_bits").cast("int").alias("bits"))
    p1 = F.struct(c("p1_after").alias("after"), F.lit(16).alias("bits"))
    recompress = F.struct(c("r_after").alias("after"), c("r_level").cast("int").alias("level"))
    signals = F.struct("metrics", "logs", "traces", "profiles")
    return flat.select(
        "tenant", "max_age", "max_bytes", "ingest_bytes_per_second", "max_in_flight_bytes", "max_series", "max_series_soft", "max_part_size",
        tiers(d0, d1).alias("downsample"), tiers(p0, p1).alias("precision"),
        F.when(c("r_after").isNotNull(), recompress).alias("recompress"), signals.alias("signals"), "rf", "shards",
    )


# Document rows per customer k: (dotted path, JSON text or SQL for it, kind, condition). Both engines
# render the same list: one scan that explodes here, one branch per entry in the oracle.
BASE_DOCUMENT = [
    ("storage.backend", "'\"file\"'", "scalar", "true"),
    ("storage.cluster.rf", "'' || (k % 5)", "scalar", "k % 2 = 0"),
    ("storage.cluster", "'\"none\"'", "scalar", "k % 2 = 1"),
    ("ttl", "'\"720h\"'", "scalar", "k % 3 <> 0"),
    ("ttl", "'{}'", "empty_object", "k % 3 = 0"),
    ("etcd", "'[\"a\",\"b\"]'", "list", "true"),
    ("a.b.c", "'' || k", "scalar", "k % 4 = 0"),
    ("a", "'{}'", "empty_object", "k % 4 = 1"),
]
OVERRIDE_DOCUMENT = [
    ("storage.cluster.rf", "'5'", "scalar", "k % 10 <> 0 AND k % 3 = 0"),
    ("storage", "'null'", "null", "k % 10 = 0"),
    ("storage.dir", "'\"/x\"'", "scalar", "k % 10 <> 0 AND k % 5 = 1"),
    ("storage.cluster", "'{}'", "empty_object", "k % 10 <> 0 AND k % 3 = 1"),
    ("storage.policy", "'\"x\"'", "scalar", "k % 10 <> 0 AND k % 17 = 0"),
    ("storage.policy.retention.max_age", "'\"1h\"'", "scalar", "k % 10 <> 0 AND k % 17 <> 0 AND k % 19 = 0"),
    ("storage.policy.retention.max_bytes", "'7'", "scalar", "k % 10 <> 0 AND k % 17 <> 0 AND k % 19 = 0"),
    ("metrics_backend", "'\"other\"'", "scalar", "k % 13 = 0"),
    ("ttl.unit", "'\"h\"'", "scalar", "k % 2 = 0"),
    ("ttl", "'\"1h\"'", "scalar", "k % 2 = 1 AND k % 7 = 0"),
    ("etcd", "'[\"c\"]'", "list", "k % 4 = 2"),
    ("a", "'{}'", "empty_object", "k % 6 = 0"),
    ("a.b", "'1'", "scalar", "k % 6 = 1"),
]
POLICY_OVERRIDE = [
    ("retention.max_age", "'\"24h\"'", "scalar", "k % 3 = 0"),
    ("limits", "'null'", "null", "k % 3 = 1"),
    ("downsample", "'[{\"after\":\"6h\",\"interval\":\"1m\",\"agg\":\"max\"}]'", "list", "k % 4 = 0"),
    ("retention.max_bytes", "'\"500Gi\"'", "scalar", "k % 5 = 0"),
]


#: Policy documents as customers get them wrong.
BROKEN_POLICY = [
    ("downsample", "'\"oops\"'", "scalar", "k % 4 = 0"),
    ("downsample", "'[{\"after\":\"6h\",\"intervall\":\"1m\"},{\"after\":\"9h\",\"interval\":\"' || (k % 7 + 1) || 'm\"}]'", "list", "k % 4 = 1"),
    ("precision", "'[{\"after\":\"6h\",\"bits\":' || (k % 60 + 1) || '}]'", "list", "k % 7 = 0"),
    ("retention.max_agee", "'\"' || k || 'h\"'", "scalar", "k % 5 = 0"),
    ("retention.max_age", "'[\"1h\"]'", "list", "k % 5 = 1"),
    ("retention.max_bytes", "'\"' || k || 'Gi\"'", "scalar", "k % 5 = 2"),
    ("limits", "'' || k", "scalar", "k % 6 = 0"),
    ("limits", "'null'", "null", "k % 6 = 1"),
    ("signals", "'{}'", "empty_object", "k % 6 = 2"),
]


def document_sql(rules: list[tuple[str, str, str, str]], prefix: str = "d") -> str:
    """The oracle's rendering."""
    branches = [
        f"SELECT '{prefix}' || k AS doc, '{p}' AS p, {v} AS value_json, '{kind}' AS kind FROM (SELECT c_custkey AS k FROM customer) WHERE {when}"
        for p, v, kind, when in rules
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(branches) + ") rows"


def documents(spark: SparkSession, sf_dir: str, rules: list[tuple[str, str, str, str]], prefix: str = "d") -> DataFrame:
    entries = F.array(
        *[
            F.when(F.expr(when), F.struct(F.split(F.lit(p), "[.]").alias("path"), F.expr(v).alias("value_json"), F.lit(kind).alias("kind")))
            for p, v, kind, when in rules
        ]
    )
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k").select(F.concat(F.lit(prefix), "k").alias("doc"), F.explode(F.array_compact(entries)).alias("e"))
    return rows.select("doc", "e.path", "e.value_json", "e.kind")


DEFAULT_POLICY = [
    (["retention", "max_age"], '"720h"', "scalar"),
    (["limits", "max_series"], "1000000", "scalar"),
    (["limits", "max_in_flight_bytes"], '"1Gi"', "scalar"),
    (["downsample"], '[{"after":"24h","interval":"5m"},{"after":"168h","interval":"1h","agg":"avg"}]', "list"),
    (["signals", "profiles"], "false", "scalar"),
]


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat(event_type, '/', user_id % 20) AS cluster", "concat('n', user_id % 5) AS node", "ts", "value > 10 AS ready", "event_id AS seq"
    )


def desired_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted nodes per cluster: some clusters have no row, some rows no heartbeat."""
    wanted = table(spark, sf_dir, "customer").selectExpr("c_custkey % 20 AS k").distinct()
    return wanted.filter("k % 4 <> 0").selectExpr("concat('click/', k) AS cluster", "cast(k % 3 + 1 AS int) AS replicas").unionByName(
        wanted.selectExpr("concat('silent/', k) AS cluster", "cast(2 AS int) AS replicas")
    )


def condition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_type AS cluster", "CASE WHEN user_id % 5 = 0 THEN 'Available' ELSE 'Progressing' END AS condition",
        "ts", "event_id AS seq", "CASE WHEN value > 40 THEN 'True' ELSE 'False' END AS status",
    )
