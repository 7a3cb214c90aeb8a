"""Every job as a registered query over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import fingerprint, shard_of
from ..functions.mantissa import truncate_mantissa
from ..functions.tiers import PrecisionTier, RollupTier
from ..functions.timeline import DAY, HOUR, MINUTE, without_zone
from ..operators import admission, documents, fleet, placement, policy, precision, pyramid, registry, replicas, retention, rollup, sidecar, usage
from ..sources import parts, signals
from ..sources.samples import as_samples
from ..sources.staging import shared_folder, stage
from ..streaming import admission as stream_admission
from ..streaming import aggregates, ingest, repair
from ..streaming import replicas as stream_replicas
from . import inputs, merge_job
from .inputs import EVENTS_AS_OF, LINEITEM_AS_OF, LINEITEM_ORDER, NODES, RF, SHARDS

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

TIER_AGES = ((DAY, 5 * MINUTE), (7 * DAY, HOUR))
PRECISION_TIERS = [PrecisionTier(7 * DAY, 32), PrecisionTier(14 * DAY, 16), PrecisionTier(20 * DAY, 8)]
MAX_AGE = 10 * DAY + 7 * HOUR
RANGE = (datetime(2024, 1, 5, 7, 17), datetime(2024, 1, 19, 13, 41))


def register(name: str) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Instants are compared and printed in UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return without_zone(query(spark, sf_dir))

        REGISTRY[name] = run
        return query

    return keep


def tiers(agg: str | None) -> list[RollupTier]:
    return [RollupTier(after, interval, agg) for after, interval in TIER_AGES]


# --- sources and sinks -----------------------------------------------------------------------


@register("samples_scan")
def samples_scan(spark, sf_dir):
    ev = inputs.events(spark, sf_dir)
    return ev.select("tenant", "signal", "metric", F.col("labels")["user"].alias("user_label"), "series_id", "ts", "value", "arrival_seq", "nbytes")


@register("signal_route")
def signal_route(spark, sf_dir):
    routed = signals.route_signals(inputs.telemetry(spark, sf_dir), {"traces": False, "logs": True, "profiles": None})
    out = None
    for rows in routed.values():
        out = rows if out is None else out.unionByName(rows)
    return out.select("signal", "row_id", "nbytes")


@register("signal_route_by_tenant")
def signal_route_by_tenant(spark, sf_dir):
    served = signals.served_by_policy(inputs.telemetry(spark, sf_dir), inputs.tenant_policies(spark))
    return served.groupBy("tenant", "signal").agg(F.count("*").alias("n_rows"), F.sum("nbytes").alias("n_bytes"))


@register("part_assign")
def part_assign(spark, sf_dir):
    return parts.assign_parts(inputs.events(spark, sf_dir), 1000).select("tenant", "dt", "arrival_seq", "part_id")


@register("part_assign_ties")
def part_assign_ties(spark, sf_dir):
    rows = inputs.lineitem(spark, sf_dir).withColumn("dt", retention.partition_of("ts", 360 * DAY))
    return parts.assign_parts(rows, 20_000, order=("ts", *LINEITEM_ORDER)).groupBy("tenant", "dt", "part_id").agg(
        F.count("*").alias("n_rows"), F.sum("nbytes").alias("n_bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@register("cold_parts")
def cold_parts(spark, sf_dir):
    return parts.cold_parts(inputs.events(spark, sf_dir), 3 * DAY, EVENTS_AS_OF)


# --- retention -------------------------------------------------------------------------------


@register("retention_age")
def retention_age(spark, sf_dir):
    return retention.apply_retention(inputs.events(spark, sf_dir), MAX_AGE, EVENTS_AS_OF).select("tenant", "arrival_seq", "ts")


@register("retention_expired")
def retention_expired(spark, sf_dir):
    return retention.expired_partitions(inputs.events(spark, sf_dir), MAX_AGE, EVENTS_AS_OF)


@register("retention_overhang")
def retention_overhang(spark, sf_dir):
    return retention.retention_overhang(inputs.events(spark, sf_dir), MAX_AGE, EVENTS_AS_OF)


@register("retention_budget")
def retention_budget(spark, sf_dir):
    return retention.retention_budget_plan(inputs.events(spark, sf_dir), 50_000)


@register("retention_by_tenant")
def retention_by_tenant(spark, sf_dir):
    kept = retention.apply_retention_by_policy(inputs.events(spark, sf_dir), inputs.tenant_policies(spark), EVENTS_AS_OF)
    return kept.select("tenant", "arrival_seq", "ts")


# --- rollup ----------------------------------------------------------------------------------


@register("retention_by_tenant_pruned")
def retention_by_tenant_pruned(spark, sf_dir):
    """The same from a table in directories of tenant and day, of which the scan opens only those that stay."""
    rows = inputs.events(spark, sf_dir).withColumn("dt", F.to_date("ts"))
    path = f"{shared_folder(spark).rstrip('/')}/by-tenant-{uuid.uuid4().hex}"
    rows.repartition("tenant", "dt").write.partitionBy("tenant", "dt").parquet(path)
    kept = retention.apply_retention_by_policy(spark.read.schema(rows.schema).parquet(path), inputs.tenant_policies(spark), EVENTS_AS_OF, dt="dt")
    return kept.select("tenant", "arrival_seq", "ts")


@register("downsample_tiers")
def downsample_tiers(spark, sf_dir):
    return rollup.with_tier(inputs.events(spark, sf_dir), tiers(None), EVENTS_AS_OF).select("arrival_seq", "ts", "resolution_us")


def _downsample(agg: str) -> Query:
    def query(spark, sf_dir):
        out = rollup.downsample(inputs.events(spark, sf_dir), tiers(agg), EVENTS_AS_OF)
        return out.withColumn("value", F.round("value", 6))

    return query


for _agg in ("last", "first", "min", "max", "sum", "avg", "count"):
    register(f"downsample_{_agg}")(_downsample(_agg))


@register("downsample_lineitem")
def downsample_lineitem(spark, sf_dir):
    mixed = [RollupTier(365 * DAY, 7 * DAY, "last"), RollupTier(1095 * DAY, 28 * DAY, "avg")]
    out = rollup.downsample(inputs.lineitem(spark, sf_dir), mixed, LINEITEM_AS_OF, order_cols=LINEITEM_ORDER)
    return out.withColumn("value", F.round("value", 6))


@register("downsample_plan")
def downsample_plan(spark, sf_dir):
    return rollup.downsample_plan(inputs.events(spark, sf_dir), tiers(None), EVENTS_AS_OF)


@register("rollup_progressive")
def rollup_progressive(spark, sf_dir):
    keys = ("tenant", "metric")
    first, both = [RollupTier(DAY, 30 * MINUTE)], [RollupTier(DAY, 30 * MINUTE), RollupTier(7 * DAY, 4 * HOUR)]
    state = rollup.as_state(inputs.events(spark, sf_dir), keys)
    for as_of, step in ((datetime(2024, 1, 15, 3, 10), first), (datetime(2024, 1, 22, 5, 20), both), (EVENTS_AS_OF, both)):
        state = rollup.merge_rollup(state, step, as_of, keys)
    return state.select(
        *keys, "ts", "resolution_us", "n", rollup.state_value("sum").alias("s"), "mn", "mx", "first_v", "last_v"
    )


@register("downsample_by_tenant")
def downsample_by_tenant(spark, sf_dir):
    out = rollup.downsample_by_policy(inputs.events(spark, sf_dir), inputs.tenant_policies(spark), EVENTS_AS_OF)
    return out.withColumn("value", F.round("value", 6))


# --- precision -------------------------------------------------------------------------------


@register("precision_parts")
def precision_parts(spark, sf_dir):
    return precision.part_precision(inputs.events(spark, sf_dir), PRECISION_TIERS, EVENTS_AS_OF)


def _truncated(bits: int) -> Query:
    def query(spark, sf_dir):
        return inputs.events(spark, sf_dir).select("arrival_seq", truncate_mantissa(F.col("value"), bits).alias("value"))

    return query


for _bits in (8, 16, 32):
    register(f"precision_{_bits}")(_truncated(_bits))


@register("precision_apply")
def precision_apply(spark, sf_dir):
    out = precision.apply_precision(inputs.events(spark, sf_dir), PRECISION_TIERS, EVENTS_AS_OF)
    return out.select("tenant", "dt", "arrival_seq", "bits", "value")


@register("precision_report")
def precision_report(spark, sf_dir):
    out = precision.precision_report(inputs.events(spark, sf_dir), PRECISION_TIERS, EVENTS_AS_OF)
    return out.withColumns({c: F.round(c, 9) for c in ("max_rel_error", "mean_rel_error")})


# --- admission -------------------------------------------------------------------------------


@register("limit_series_hard")
def limit_series_hard(spark, sf_dir):
    return admission.limit_series(inputs.events(spark, sf_dir), 100).select("tenant", "arrival_seq", "series_id", "verdict")


@register("limit_series_soft")
def limit_series_soft(spark, sf_dir):
    return admission.limit_series(inputs.events(spark, sf_dir), 103, 100).select("tenant", "arrival_seq", "series_id", "verdict")


def _new_registry(spark: SparkSession) -> registry.Registry:
    return registry.Registry(f"{shared_folder(spark).rstrip('/')}/series-{uuid.uuid4().hex}")


@register("limit_series_incremental")
def limit_series_incremental(spark, sf_dir):
    """Three arrivals, each against what the earlier ones registered."""
    ev, kept, out = inputs.events(spark, sf_dir), _new_registry(spark), None
    tenants = ev.select("tenant").distinct().withColumns({"max_series": F.lit(103), "max_series_soft": F.lit(100)})
    last = ev.agg(F.max("arrival_seq")).first()[0] or 0
    for i in range(3):
        part = ev.where((F.col("arrival_seq") > last * i // 3 - (i == 0)) & (F.col("arrival_seq") <= last * (i + 1) // 3))
        tagged = registry.admit(part, kept, i, tenants)
        out = tagged if out is None else out.unionByName(tagged)
    return out.select("tenant", "arrival_seq", "series_id", "verdict")


@register("limit_series_by_policy")
def limit_series_by_policy(spark, sf_dir):
    limits = registry.policy_limits(inputs.tenant_policies(spark))
    return registry.admit(inputs.events(spark, sf_dir), _new_registry(spark), 0, limits).select("tenant", "arrival_seq", "series_id", "verdict")


def _replayed(rows: DataFrame) -> DataFrame:
    """The month replayed five thousand times faster, so that tenants do run out of credit."""
    return rows.withColumn("ts", F.timestamp_micros(F.expr("1704067200000000 + (unix_micros(ts) - 1704067200000000) div 5000")))


@register("limit_rate")
def limit_rate(spark, sf_dir):
    return admission.limit_rate(_replayed(inputs.events(spark, sf_dir)), 150).select("tenant", "arrival_seq", "ts", "verdict")


@register("limit_rate_by_policy")
def limit_rate_by_policy(spark, sf_dir):
    fast, tenants = _replayed(inputs.events(spark, sf_dir)), inputs.tenant_policies(spark)
    return admission.limit_rate_by_policy(fast, tenants).select("tenant", "arrival_seq", "ts", "verdict")


@register("limit_in_flight")
def limit_in_flight(spark, sf_dir):
    return admission.limit_in_flight(inputs.events(spark, sf_dir), 700, 6 * HOUR).select("tenant", "epoch", "arrival_seq", "verdict")


@register("partial_success")
def partial_success(spark, sf_dir):
    tagged = admission.limit_series(inputs.events(spark, sf_dir), 103, 100)
    return admission.partial_success(tagged.withColumn("batch", F.expr("arrival_seq div 500")))


@register("series_usage")
def series_usage(spark, sf_dir):
    return admission.series_usage(inputs.events(spark, sf_dir), inputs.tenant_policies(spark))


# --- sidecar, shards, replicas ---------------------------------------------------------------


@register("sidecar_build")
def sidecar_build(spark, sf_dir):
    out = sidecar.build_sidecar(inputs.events(spark, sf_dir), HOUR)
    return out.select("tenant", "metric", "series_id", "bucket_ts", "n", F.round("s", 6).alias("s"), "mn", "mx", "first_v", "last_v")


def _range(use_sidecar: bool) -> Query:
    def query(spark, sf_dir):
        ev = inputs.events(spark, sf_dir)
        side = sidecar.build_sidecar(ev, HOUR) if use_sidecar else None
        out = sidecar.range_aggregate(ev, side, *RANGE, HOUR, sidecar.AGGREGATES)
        return out.withColumn("sum", F.round("sum", 6))

    return query


register("range_agg_sidecar")(_range(True))
register("range_agg_raw")(_range(False))


@register("range_agg_pyramid")
def range_agg_pyramid(spark, sf_dir):
    """The range from a stored pyramid, of which the days from the 12th on came later."""
    ev, later = inputs.events(spark, sf_dir), datetime(2024, 1, 12)
    kept = pyramid.Pyramid(f"{shared_folder(spark).rstrip('/')}/pyramid-{uuid.uuid4().hex}", HOUR)
    kept.refresh(ev.where(F.col("ts") < F.lit(later)))
    kept.refresh(ev, frm=later, to=EVENTS_AS_OF)
    return kept.range_aggregate(ev, *RANGE, sidecar.AGGREGATES).withColumn("sum", F.round("sum", 6))


@register("series_churn")
def series_churn(spark, sf_dir):
    return usage.series_churn(usage.series_sketches(inputs.events(spark, sf_dir)))


@register("series_between")
def series_between(spark, sf_dir):
    return usage.series_between(usage.series_sketches(inputs.events(spark, sf_dir)), datetime(2024, 1, 5), datetime(2024, 1, 9))


@register("shard_assign")
def shard_assign(spark, sf_dir):
    return placement.with_shard(inputs.events(spark, sf_dir), SHARDS).select("tenant", "series_id", "arrival_seq", "shard")


@register("hrw_placement")
def hrw_placement(spark, sf_dir):
    users = inputs.table(spark, sf_dir, "events").selectExpr("concat('u', user_id) AS tenant", "event_type").distinct()
    keys = users.select("tenant", shard_of(F.col("event_type"), 2).alias("shard")).distinct()
    return placement.place_shards(keys, NODES, RF)


@register("node_load")
def node_load(spark, sf_dir):
    return placement.node_load(inputs.events(spark, sf_dir), NODES, RF, SHARDS).withColumn("skew", F.round("skew", 9))


@register("replica_dedup")
def replica_dedup(spark, sf_dir):
    rows = inputs.copies(spark, sf_dir)
    placed = placement.place_shards(rows.select("tenant", "shard").distinct(), NODES, RF)
    primaries = placed.filter("replica = 0").select("tenant", "shard", "node")
    return replicas.dedup_replicas(rows, primaries)


@register("quorum_audit")
def quorum_audit(spark, sf_dir):
    return replicas.quorum_audit(inputs.copies(spark, sf_dir), RF)


# --- policy tables and fleet -----------------------------------------------------------------


def _tier_text(col: str, *names: str):
    return F.array_join(F.transform(col, lambda t: F.concat_ws("/", *[t[n].cast("string") for n in names])), ";")


def _flat_policy(p: DataFrame) -> DataFrame:
    return p.select(
        "tenant",
        "retention.max_age_us", "retention.max_bytes",
        *[f"limits.{f}" for f in policy.LIMIT_FIELDS],
        _tier_text("downsample", "after_us", "interval_us", "agg").alias("downsample"),
        _tier_text("precision", "after_us", "bits").alias("precision"),
        F.col("recompress.after_us").alias("recompress_after_us"), F.col("recompress.level").alias("recompress_level"),
        *[F.col(f"signals.{s}").alias(s) for s in ("metrics", "logs", "traces", "profiles")],
        "rf", "shards",
    )


@register("policy_normalize")
def policy_normalize(spark, sf_dir):
    return _flat_policy(policy.normalize_policies(inputs.raw_policies(spark, sf_dir)))


@register("policy_violations")
def policy_violations(spark, sf_dir):
    return policy.policy_violations(policy.normalize_policies(inputs.raw_policies(spark, sf_dir)))


@register("policy_first_violation")
def policy_first_violation(spark, sf_dir):
    return policy.policy_violations(policy.normalize_policies(inputs.raw_policies(spark, sf_dir)), first_only=True)


@register("doc_flatten")
def doc_flatten(spark, sf_dir):
    props = inputs.table(spark, sf_dir, "events").selectExpr("event_id AS doc", "props AS body")
    return documents.flatten_documents(props).withColumn("path", F.array_join("path", "."))


@register("doc_merge")
def doc_merge(spark, sf_dir):
    base = inputs.documents(spark, sf_dir, inputs.BASE_DOCUMENT)
    override = inputs.documents(spark, sf_dir, inputs.OVERRIDE_DOCUMENT)
    return documents.merge_documents(base, override).withColumn("path", F.array_join("path", "."))


@register("reserved_paths")
def reserved_paths(spark, sf_dir):
    return documents.reserved_path_violations(inputs.documents(spark, sf_dir, inputs.OVERRIDE_DOCUMENT))


@register("reserved_path_report")
def reserved_path_report(spark, sf_dir):
    return documents.reserved_path_report(reserved_paths(spark, sf_dir))


@register("effective_policy")
def effective_policy(spark, sf_dir):
    tenants = inputs.table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS tenant")
    overrides = inputs.documents(spark, sf_dir, inputs.POLICY_OVERRIDE, "c")
    flat = _flat_policy(policy.effective_policies(tenants, inputs.DEFAULT_POLICY, overrides))
    return flat.select("tenant", "max_age_us", "max_bytes", "max_series", "max_in_flight_bytes", "downsample", "profiles")


@register("policy_document_violations")
def policy_document_violations(spark, sf_dir):
    return policy.document_violations(inputs.documents(spark, sf_dir, inputs.BROKEN_POLICY, "c"))


@register("config_drift")
def config_drift(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "customer")
    desired = c.selectExpr("concat('c', c_custkey) AS cluster", "concat('{\"rf\":', c_custkey % 3, '}') AS document")
    seen = c.filter("c_custkey % 10 <> 0").selectExpr("concat('c', c_custkey) AS cluster", "concat('{\"rf\":', c_custkey % 4 % 3, '}') AS document")
    gone = c.filter("c_custkey % 50 = 0").selectExpr("concat('x', c_custkey) AS cluster", "'{}' AS document")
    observed = seen.unionByName(gone).select("cluster", fingerprint(F.col("document")).alias("fingerprint"))
    return documents.config_drift(desired, observed)


@register("fleet_status")
def fleet_status(spark, sf_dir):
    return fleet.fleet_status(inputs.heartbeats(spark, sf_dir), inputs.desired_sizes(spark, sf_dir), datetime(2024, 1, 20), ("seq",))


@register("condition_transitions")
def condition_transitions(spark, sf_dir):
    return fleet.condition_transitions(inputs.condition_rows(spark, sf_dir))


# --- streams, drained once -------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # As a pattern the path may be one file or a directory of part files; a plain file path is refused.
    return as_samples(ingest.ingest_stream(spark, f"{path[:-1]}[{path[-1]}]", schema), inputs.EVENTS)


def _drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream to its end into a table of the shared folder and read that table."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").outputMode("append")
    ingest.flushed(writer, f"{root}/checkpoint", None).start(f"{root}/table").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table")


def _drain_updates(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """`_drain` for aggregates: the last state of every key, windows still open at the end included."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    ingest.write_updates(stream, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return ingest.read_updates(spark, f"{root}/table", stream.schema, keys)


def _history_us(spark: SparkSession, sf_dir: str) -> int:
    """The table's whole span: the delay that loses no row when its files come in any order."""
    us = F.unix_micros("ts")
    return (inputs.events(spark, sf_dir).agg(F.max(us) - F.min(us)).first()[0] or 0) + MINUTE


@register("stream_ingest")
def stream_ingest(spark, sf_dir):
    root = f"{shared_folder(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    ingest.write_samples(_event_stream(spark, sf_dir), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/table").groupBy("tenant", "dt").agg(
        F.count("*").alias("n_rows"), F.sum("nbytes").alias("n_bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@register("stream_rollup")
def stream_rollup(spark, sf_dir):
    rolled = aggregates.rollup_stream(_event_stream(spark, sf_dir), RollupTier(0, HOUR, "last"), _history_us(spark, sf_dir))
    return _drain_updates(rolled, "rollup", ["tenant", "metric", "series_id", "ts"])


@register("stream_dedup")
def stream_dedup(spark, sf_dir):
    three = _event_stream(spark, sf_dir).select("tenant", "series_id", "ts", F.explode(F.expr("array('n0', 'n1', 'n2')")).alias("node"))
    return _drain(aggregates.dedup_stream(three, _history_us(spark, sf_dir)).select("tenant", "series_id", "ts"), "dedup")


def _arriving(rows: DataFrame, label: str, parts: int = 6, last: DataFrame | None = None) -> DataFrame:
    """`rows` as a stream of `parts` micro-batches that each hold rows of all times; `last` is a batch behind them."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    rows.repartition(parts, F.xxhash64("arrival_seq", "ts")).write.parquet(path)
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(path)
    return ingest.ingest_stream(spark, path, rows.schema, files_per_batch=1)


@register("stream_repair")
def stream_repair(spark, sf_dir):
    """Files in any order against a delay of a day: most rows are late, and the repaired table is the batch rollup."""
    root, tier, delay = f"{shared_folder(spark).rstrip('/')}/repair-{uuid.uuid4().hex}", RollupTier(0, HOUR, "last"), DAY
    stream = _arriving(inputs.events(spark, sf_dir), "late")
    repair.write_rolled(stream, root, tier, delay, f"{root}/checkpoint-rolled").awaitTermination()
    repair.write_samples_and_dirt(stream, root, tier, delay, f"{root}/checkpoint-raw").awaitTermination()
    return repair.read_repaired(spark, root, tier, repair.repair(spark, root, tier, delay))


@register("stream_dedup_primary")
def stream_dedup_primary(spark, sf_dir):
    rows = inputs.copies(spark, sf_dir)
    placed = placement.place_shards(rows.select("tenant", "shard").distinct(), NODES, RF)
    # Written once: every micro-batch joins it, and would place the table's shards anew.
    primaries = stage(placed.filter("replica = 0").select("tenant", "shard", "node"), "primaries")
    delay = _history_us(spark, sf_dir)
    # Something newer than all rows by more than the delay: the watermark passes them.
    end = rows.groupBy().agg(F.timestamp_micros(F.max(F.unix_micros("ts")) + 2 * delay).alias("ts")).where("ts is not null")
    end = end.select(*[F.col(c) if c == "ts" else F.lit("end").alias(c) if c == "series_id" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream_replicas.STORE)
    stream = stream_replicas.dedup_stream_primary(_arriving(rows, "copies", last=end), primaries, delay)
    return _drain(stream, "dedup-primary").where("series_id <> 'end'")


@register("stream_limit_rate")
def stream_limit_rate(spark, sf_dir):
    fast = _replayed(_event_stream(spark, sf_dir)).select("tenant", "arrival_seq", "ts", "nbytes")
    return _drain(stream_admission.limit_rate_stream(fast, 150), "rate").select("tenant", "arrival_seq", "ts", "verdict")


@register("stream_limit_rate_sliced")
def stream_limit_rate_sliced(spark, sf_dir):
    root = f"{shared_folder(spark).rstrip('/')}/sliced-{uuid.uuid4().hex}"
    fast = _replayed(_event_stream(spark, sf_dir)).select("tenant", "arrival_seq", "ts", "nbytes")
    stream_admission.write_rate_limited(fast, root, 150, f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/rows").select("tenant", "arrival_seq", "ts", "verdict")


@register("stream_limit_in_flight")
def stream_limit_in_flight(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).select("tenant", "arrival_seq", "ts", "nbytes")
    return _drain(stream_admission.limit_in_flight_stream(rows, 700, 6 * HOUR), "in-flight").select("tenant", "arrival_seq", "verdict")


@register("stream_signals")
def stream_signals(spark, sf_dir):
    """Four signals in one stream, two of them off: per signal what was written, beside what the batches counted."""
    root = f"{shared_folder(spark).rstrip('/')}/signals-{uuid.uuid4().hex}"
    rows = inputs.telemetry(spark, sf_dir)
    rows.repartition(4, F.xxhash64("row_id")).write.parquet(f"{root}/in")
    stream = ingest.ingest_stream(spark, f"{root}/in", rows.schema, files_per_batch=1)
    toggles = {"traces": False, "logs": True, "profiles": False}
    for attempt in range(2):  # all batches once more from the start: they overwrite what they wrote
        ingest.write_signal_stream(stream, f"{root}/out", toggles, f"{root}/checkpoint-{attempt}", nbytes="nbytes").awaitTermination()
    written = spark.read.parquet(f"{root}/out").groupBy("signal").agg(F.count("*").alias("n_rows"), F.sum("nbytes").alias("n_bytes"))
    counted = ingest.read_signal_counts(spark, f"{root}/out").groupBy("signal").agg(F.sum("n_rows").alias("counted_rows"), F.sum("n_bytes").alias("counted_bytes"), F.max("served").alias("served"))
    return counted.join(written, "signal", "left")


@register("stream_partial_success")
def stream_partial_success(spark, sf_dir):
    odd = F.when(F.col("arrival_seq") % 3 == 0, admission.SHED).otherwise(admission.ACCEPTED)
    tagged = _event_stream(spark, sf_dir).withColumn("verdict", odd)
    counted = aggregates.partial_success_stream(tagged, HOUR, _history_us(spark, sf_dir))
    return _drain_updates(counted, "partial", ["tenant", "window_ts"])


# --- the composed job ------------------------------------------------------------------------


@register("merge_lifecycle")
def merge_lifecycle(spark, sf_dir):
    policies = inputs.tenant_policies(spark)
    out = merge_job.merged(inputs.events(spark, sf_dir), policies, EVENTS_AS_OF, merge_job.bit_widths(policies))
    return out.select("tenant", "metric", "series_id", "ts", F.round("value", 6).alias("value"), "resolution_us", "dt", "bits")


@register("merge_lifecycle_twice")
def merge_lifecycle_twice(spark, sf_dir):
    """A merge, new samples, another merge: the table of a single merge at the later date."""
    keys, earlier = ("tenant", "metric"), datetime(2024, 1, 22, 3, 10)
    policies = inputs.aggregate_policies(spark)
    states = rollup.as_state(as_samples(inputs.table(spark, sf_dir, "events"), inputs.EVENTS_BY_AGGREGATE), keys)
    before, new = states.filter(F.col("ts") < F.lit(earlier)), states.filter((F.col("ts") >= F.lit(earlier)) | F.col("ts").isNull())
    first = merge_job.merge_states(before, policies, earlier, keys)
    second = merge_job.merge_states(first.unionByName(new, allowMissingColumns=True), policies, EVENTS_AS_OF, keys)
    out = merge_job.published(second, policies, EVENTS_AS_OF, merge_job.bit_widths(policies))
    return out.select("tenant", "metric", "ts", F.round("value", 6).alias("value"), "resolution_us", "n", "dt", "bits")
