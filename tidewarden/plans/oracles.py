"""Independent SQL for the registered queries, written for DuckDB on the same tables."""

from __future__ import annotations

from ..functions.timeline import DAY, HOUR, MINUTE
from ..operators.documents import RESERVED_PATHS
from . import inputs

EV = """ev AS (
  SELECT 't' || (user_id % 4) AS tenant, 'metrics' AS signal, event_type AS metric, CAST(user_id AS VARCHAR) AS user_label,
    md5('t' || (user_id % 4) || chr(31) || event_type || chr(31) || 'user=' || user_id) AS series_id,
    ts, value, event_id AS arrival_seq, CAST(strlen(event_type) + strlen(props) + 24 AS BIGINT) AS nbytes
  FROM events)"""

LI = """li AS (
  SELECT 's' || (l_suppkey % 4) AS tenant, l_returnflag || '/' || l_linestatus AS metric,
    md5('s' || (l_suppkey % 4) || chr(31) || l_returnflag || '/' || l_linestatus || chr(31) || 'supplier=' || l_suppkey) AS series_id,
    l_shipdate AS ts, l_extendedprice AS value, l_orderkey AS arrival_seq, l_linenumber, l_partkey,
    CAST(32 + l_linenumber AS BIGINT) AS nbytes
  FROM lineitem)"""

POL = f"""pol(tenant, max_age_us, max_series, max_series_soft) AS (VALUES
  ('t0', CAST({10 * DAY + 7 * HOUR} AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)), ('t1', NULL, 150, 100), ('t2', 0, 100, 0), ('t3', {20 * DAY}, 1000, 20)),
ptier(tenant, after_us, interval_us, agg) AS (VALUES
  ('t0', {DAY}, {5 * MINUTE}, 'last'), ('t0', {7 * DAY}, {HOUR}, 'avg'), ('t1', {2 * DAY}, {30 * MINUTE}, 'max'),
  ('t3', {DAY}, {HOUR}, 'sum'), ('t3', {10 * DAY}, {6 * HOUR}, 'count')),
pbits(tenant, after_us, bits) AS (VALUES ('t0', {3 * DAY}, 32), ('t0', {7 * DAY}, 16), ('t2', {5 * DAY}, 8), ('t3', {12 * DAY}, 24))"""

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
DAY_OF = "date_trunc('day', ts)"
CUTOFF = f"({AS_OF} - INTERVAL 247 HOUR)"

TELEMETRY = """tel AS (
  SELECT 'metrics' AS signal, event_id AS row_id, 't' || (user_id % 4) AS tenant, CAST(strlen(event_type) + strlen(props) + 24 AS BIGINT) AS nbytes FROM events
  UNION ALL SELECT 'logs', doc_id, 't' || (doc_id % 4), CAST(strlen(text) AS BIGINT) FROM documents
  UNION ALL SELECT 'traces', o_orderkey, 't' || (o_custkey % 4), CAST(strlen(o_orderpriority) + 32 AS BIGINT) FROM orders
  UNION ALL SELECT 'profiles', page_id, 't' || (page_id % 4), CAST(strlen(html) AS BIGINT) FROM pages)"""


def bucket(width: str, ts: str = "ts") -> str:
    return f"make_timestamp(epoch_us({ts}) - epoch_us({ts}) % {width})"


def shard(series: str, n: int) -> str:
    return f"CAST(CAST('0x' || substr(md5({series}), 1, 8) AS BIGINT) % {n} AS INTEGER)"


AGGS = {
    "last": "arg_max(value, (ts, arrival_seq))",
    "first": "arg_min(value, (ts, arrival_seq))",
    "min": "min(value)",
    "max": "max(value)",
    "sum": "sum(value)",
    "avg": "avg(value)",
    "count": "CAST(count(value) AS DOUBLE)",
}

TIERED = f"""tiered AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-24 00:00:00' THEN {HOUR}
  WHEN ts < TIMESTAMP '2024-01-30 00:00:00' THEN {5 * MINUTE} ELSE 0 END AS resolution_us FROM ev)"""


def downsample(agg: str) -> str:
    return f"""WITH {EV}, {TIERED}
SELECT tenant, metric, series_id, ts, round(value, 6) AS value, CAST(resolution_us AS BIGINT) AS resolution_us FROM tiered WHERE resolution_us = 0
UNION ALL
SELECT tenant, metric, series_id, {bucket('resolution_us')} AS b, round({AGGS[agg]}, 6), CAST(resolution_us AS BIGINT)
FROM tiered WHERE resolution_us > 0 GROUP BY tenant, metric, series_id, b, resolution_us"""


LI_LAST = "arg_max(value, (ts, arrival_seq, l_linenumber, l_partkey, value))"

PARTS = f"""parts AS (SELECT tenant, {DAY_OF} AS dt, max(ts) AS newest, count(*) AS n_rows,
  epoch_us({AS_OF}) - epoch_us(max(ts)) AS age_us FROM ev GROUP BY ALL),
pb AS (SELECT *, CASE WHEN age_us > {20 * DAY} THEN 8 WHEN age_us > {14 * DAY} THEN 16 WHEN age_us > {7 * DAY} THEN 32 END AS bits FROM parts)"""


def trunc(value: str, bits: str) -> str:
    """Truncation by powers of two, the exponent found from log2 and corrected."""
    e0 = f"floor(log2(abs({value})))"
    e = f"(CASE WHEN abs({value}) < pow(2.0, {e0}) THEN {e0} - 1 WHEN abs({value}) >= pow(2.0, {e0} + 1) THEN {e0} + 1 ELSE {e0} END)"
    return (
        f"(CASE WHEN {value} IS NULL OR {value} = 0 THEN {value} "
        f"ELSE sign({value}) * floor((abs({value}) / pow(2.0, {e})) * pow(2.0, {bits} - 1)) / pow(2.0, {bits} - 1) * pow(2.0, {e}) END)"
    )


SERIES_RANK = """firsts AS (SELECT tenant, metric, series_id, min(arrival_seq) AS first_seq FROM ev GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY first_seq, series_id) AS rk FROM firsts)"""
SOFT = f"""{SERIES_RANK},
over_metric AS (SELECT tenant, metric, row_number() OVER (PARTITION BY tenant ORDER BY min(first_seq)) AS m FROM ranked WHERE rk > 100 GROUP BY tenant, metric),
verdicts AS (SELECT r.tenant, r.series_id, CASE WHEN rk <= 100 THEN 'accepted' WHEN m <= 3 THEN 'overflow' ELSE 'shed' END AS verdict
  FROM ranked r LEFT JOIN over_metric USING (tenant, metric)),
tagged AS (SELECT ev.tenant, arrival_seq, nbytes,
  CASE WHEN verdict = 'overflow' THEN md5(ev.tenant || chr(31) || metric || chr(31) || 'overflow=true') ELSE ev.series_id END AS series_id, verdict
  FROM ev JOIN verdicts v ON v.tenant = ev.tenant AND v.series_id = ev.series_id)"""

NODES = "nodes(node, zone) AS (VALUES " + ", ".join(f"('{n}', '{z}')" for n, z in inputs.NODES) + ")"


def placed(keys: str) -> str:
    return f"""{NODES},
scored AS (SELECT tenant, shard, node, zone, md5(tenant || '/' || shard || '|' || node) AS h FROM ({keys}) k CROSS JOIN nodes),
turns AS (SELECT *, row_number() OVER (PARTITION BY tenant, shard, zone ORDER BY h DESC, node DESC) AS turn FROM scored),
placed AS (SELECT tenant, shard, CAST(row_number() OVER (PARTITION BY tenant, shard ORDER BY turn, h DESC, node DESC) - 1 AS INTEGER) AS replica, node FROM turns
  QUALIFY replica < {inputs.RF})"""


SHARDED = f"sh AS (SELECT *, {shard('series_id', inputs.SHARDS)} AS shard FROM ev)"
COPIES = f"""{EV}, {SHARDED}, {placed('SELECT DISTINCT tenant, shard FROM sh')},
copies AS (SELECT sh.tenant, sh.shard, series_id, ts, CASE WHEN arrival_seq % 11 = 0 AND replica = 2 THEN value + 1 ELSE value END AS value,
  arrival_seq, node FROM sh JOIN placed p ON p.tenant = sh.tenant AND p.shard = sh.shard WHERE (arrival_seq + replica) % 7 <> 0)"""


def dur(col: str) -> str:
    return f"""CASE WHEN {col} IS NOT NULL THEN CAST((CASE WHEN {col} LIKE '-%' THEN -1 ELSE 1 END) * ceil(coalesce(list_sum(list_transform(
      regexp_extract_all({col}, '[0-9.]+(?:ns|us|ms|s|m|h)'), lambda x: CAST(regexp_extract(x, '^[0-9.]+') AS DOUBLE) *
      CASE regexp_extract(x, '[a-z]+$') WHEN 'h' THEN 3600000000 WHEN 'm' THEN 60000000 WHEN 's' THEN 1000000 WHEN 'ms' THEN 1000 WHEN 'us' THEN 1 ELSE 0.001 END)), 0)) AS BIGINT) END"""


def qty(col: str) -> str:
    number = f"CAST(regexp_extract({col}, '[0-9.]+') AS DOUBLE)"
    return f"""CASE WHEN {col} IS NOT NULL THEN CAST((CASE WHEN {col} LIKE '-%' THEN -1 ELSE 1 END) * ceil({number} *
      CASE WHEN regexp_matches({col}, 'e[0-9]+$') THEN pow(10, CAST(regexp_extract({col}, 'e([0-9]+)$', 1) AS INTEGER))
      ELSE CASE regexp_extract({col}, '[A-Za-z]*$') WHEN '' THEN 1 WHEN 'k' THEN 1000 WHEN 'M' THEN 1000000 WHEN 'Ki' THEN 1024 WHEN 'Mi' THEN 1048576
        WHEN 'Gi' THEN 1073741824 WHEN 'm' THEN 0.001 END END) AS BIGINT) END"""


QTY_FIELDS = ("max_bytes", "ingest_bytes_per_second", "max_in_flight_bytes", "max_part_size")
NORM = f"""raw AS ({inputs.RAW_POLICY_SQL}),
norm AS (SELECT tenant, {dur('max_age')} AS max_age_us, {', '.join(f'{qty(f)} AS {f}' for f in QTY_FIELDS)}, max_series, max_series_soft,
  {dur('d0_after')} AS d0, {dur('d0_interval')} AS d0i, nullif(d0_agg, '') AS d0_agg, {dur('d1_after')} AS d1,
  {dur('p0_after')} AS p0, p0_bits, {dur('p1_after')} AS p1, {dur('r_after')} AS recompress_after_us,
  CASE WHEN r_after IS NOT NULL THEN CAST(r_level AS INTEGER) END AS recompress_level, metrics, logs, traces, profiles,
  CAST(rf AS INTEGER) AS rf, CAST(shards AS INTEGER) AS shards FROM raw),
dtier AS (SELECT tenant, max_age_us, 0 AS i, d0 AS after_us, d0i AS interval_us, d0_agg AS agg FROM norm WHERE d0 IS NOT NULL
  UNION ALL SELECT tenant, max_age_us, CASE WHEN d0 IS NULL THEN 0 ELSE 1 END, d1, {HOUR}, 'avg' FROM norm WHERE d1 IS NOT NULL),
btier AS (SELECT tenant, max_age_us, 0 AS i, p0 AS after_us, p0_bits AS bits FROM norm WHERE p0 IS NOT NULL
  UNION ALL SELECT tenant, max_age_us, CASE WHEN p0 IS NULL THEN 0 ELSE 1 END, p1, 16 FROM norm WHERE p1 IS NOT NULL)"""

_PAST = "max_age_us > 0 AND after_us >= max_age_us"
FOUND = f"""{NORM},
found(tenant, grp, tier, rule, field, other_tier) AS (
  SELECT tenant, 1, NULL, 1, 'signals', NULL FROM norm WHERE NOT (coalesce(metrics, true) OR coalesce(logs, true) OR coalesce(traces, true) OR coalesce(profiles, true))
  UNION ALL SELECT tenant, 2, NULL, 2, 'retention.max_age', NULL FROM norm WHERE max_age_us < 0
  UNION ALL SELECT tenant, 3, NULL, 3, 'retention.max_bytes', NULL FROM norm WHERE max_bytes < 0
  UNION ALL SELECT tenant, 4, NULL, 4, 'limits.ingest_bytes_per_second', NULL FROM norm WHERE ingest_bytes_per_second < 0
  UNION ALL SELECT tenant, 5, NULL, 5, 'limits.max_in_flight_bytes', NULL FROM norm WHERE max_in_flight_bytes < 0
  UNION ALL SELECT tenant, 6, NULL, 6, 'limits.max_part_size', NULL FROM norm WHERE max_part_size < 0
  UNION ALL SELECT tenant, 7, NULL, 7, 'limits.max_series_soft', NULL FROM norm WHERE max_series_soft > 0 AND coalesce(max_series, 0) <= 0
  UNION ALL SELECT tenant, 8, NULL, 8, 'limits.max_series_soft', NULL FROM norm WHERE max_series_soft > 0 AND max_series > 0 AND max_series_soft > max_series
  UNION ALL SELECT tenant, 9, i, 9, 'downsample.after', NULL FROM dtier WHERE after_us < 0
  UNION ALL SELECT tenant, 9, i, 10, 'downsample.interval', NULL FROM dtier WHERE interval_us <= 0
  UNION ALL SELECT tenant, 9, b.i, 11, 'downsample.after', a.i FROM dtier a JOIN dtier b USING (tenant) WHERE a.i < b.i AND a.after_us = b.after_us
  UNION ALL SELECT tenant, 12, i, 12, 'precision.after', NULL FROM btier WHERE after_us < 0
  UNION ALL SELECT tenant, 12, b.i, 13, 'precision.after', a.i FROM btier a JOIN btier b USING (tenant) WHERE a.i < b.i AND a.after_us = b.after_us
  UNION ALL SELECT tenant, 14, NULL, 14, 'recompress.after', NULL FROM norm WHERE recompress_after_us <= 0
  UNION ALL SELECT tenant, 15, i, 15, 'downsample.after', NULL FROM dtier WHERE {_PAST}
  UNION ALL SELECT tenant, 16, i, 16, 'precision.after', NULL FROM btier WHERE {_PAST}
  UNION ALL SELECT tenant, 17, NULL, 17, 'recompress.after', NULL FROM norm WHERE max_age_us > 0 AND recompress_after_us >= max_age_us
  UNION ALL SELECT tenant, 0, i, 18, 'downsample.agg', NULL FROM dtier WHERE agg NOT IN ('last', 'first', 'min', 'max', 'sum', 'avg', 'count')
  UNION ALL SELECT tenant, 0, i, 19, 'precision.bits', NULL FROM btier WHERE bits NOT BETWEEN 1 AND 63
  UNION ALL SELECT tenant, 0, NULL, 20, 'recompress.level', NULL FROM norm WHERE recompress_level NOT BETWEEN 1 AND 19
  UNION ALL SELECT tenant, 0, NULL, 21, 'limits.max_series', NULL FROM norm WHERE max_series < 0
  UNION ALL SELECT tenant, 0, NULL, 22, 'limits.max_series_soft', NULL FROM norm WHERE max_series_soft < 0
  UNION ALL SELECT tenant, 0, NULL, 23, 'rf', NULL FROM norm WHERE rf < 1
  UNION ALL SELECT tenant, 0, NULL, 24, 'shards', NULL FROM norm WHERE shards < 0)"""
FINDING = "tenant, CAST(rule AS INTEGER) AS rule, field, CAST(tier AS INTEGER) AS tier, CAST(other_tier AS INTEGER) AS other_tier, rule = 1 AS retryable"

MERGE = f"""base AS ({inputs.document_sql(inputs.BASE_DOCUMENT)}), override AS ({inputs.document_sql(inputs.OVERRIDE_DOCUMENT)}),
eff AS (SELECT * FROM override o WHERE kind <> 'empty_object' OR NOT EXISTS (
  SELECT 1 FROM base b WHERE b.doc = o.doc AND (starts_with(b.p, o.p || '.') OR (b.p = o.p AND b.kind = 'empty_object'))))"""

RESERVED = "reserved(path, hint) AS (VALUES " + ", ".join(f"('{p}', '{h}')" for p, h in RESERVED_PATHS.items()) + ")"
FOUND_PATHS = f"""o AS ({inputs.document_sql(inputs.OVERRIDE_DOCUMENT)}), {RESERVED},
hits AS (SELECT DISTINCT doc, r.path, hint FROM o JOIN reserved r ON o.p = r.path OR starts_with(o.p, r.path || '.')),
wipes AS (SELECT DISTINCT doc, p AS path FROM o WHERE kind <> 'empty_object' AND EXISTS (SELECT 1 FROM reserved r WHERE starts_with(r.path, o.p || '.')))"""

ORACLES: dict[str, str] = {
    "samples_scan": f"WITH {EV} SELECT tenant, signal, metric, user_label, series_id, ts, value, arrival_seq, nbytes FROM ev",
    "signal_route": f"WITH {TELEMETRY} SELECT signal, row_id, nbytes FROM tel WHERE signal <> 'traces'",
    "signal_route_by_tenant": f"""WITH {TELEMETRY} SELECT tenant, signal, count(*) AS n_rows, CAST(sum(nbytes) AS BIGINT) AS n_bytes FROM tel
WHERE NOT (tenant = 't1' AND signal = 'logs') AND NOT (tenant = 't2' AND signal = 'traces') GROUP BY ALL""",
    "part_assign": f"""WITH {EV}, p AS (SELECT *, {DAY_OF} AS dt FROM ev)
SELECT tenant, dt, arrival_seq, CAST((sum(nbytes) OVER (PARTITION BY tenant, dt ORDER BY ts, arrival_seq ROWS UNBOUNDED PRECEDING) - nbytes) // 1000 AS BIGINT) AS part_id FROM p""",
    "part_assign_ties": f"""WITH {LI}, p AS (SELECT *, {bucket(str(360 * DAY))} AS dt FROM li),
q AS (SELECT *, CAST((sum(nbytes) OVER (PARTITION BY tenant, dt ORDER BY ts, arrival_seq, l_linenumber, l_partkey, value ROWS UNBOUNDED PRECEDING) - nbytes) // 20000 AS BIGINT) AS part_id FROM p)
SELECT tenant, dt, part_id, count(*) AS n_rows, CAST(sum(nbytes) AS BIGINT) AS n_bytes, min(ts) AS first_ts, max(ts) AS last_ts FROM q GROUP BY ALL""",
    "cold_parts": f"WITH {EV} SELECT tenant, {DAY_OF} AS dt, max(ts) AS newest, count(*) AS n_rows FROM ev GROUP BY ALL HAVING max(ts) < {AS_OF} - INTERVAL 72 HOUR",
    "retention_age": f"WITH {EV} SELECT tenant, arrival_seq, ts FROM ev WHERE {DAY_OF} + INTERVAL 1 DAY > {CUTOFF}",
    "retention_expired": f"WITH {EV} SELECT {DAY_OF} AS dt, count(*) AS n_rows FROM ev WHERE NOT ({DAY_OF} + INTERVAL 1 DAY > {CUTOFF}) GROUP BY ALL",
    "retention_overhang": f"""WITH {EV} SELECT tenant, {DAY_OF} AS dt, count(*) AS n_rows, CAST(sum(nbytes) AS BIGINT) AS n_bytes FROM ev
WHERE {DAY_OF} + INTERVAL 1 DAY > {CUTOFF} AND ts < {CUTOFF} GROUP BY ALL""",
    "retention_budget": f"""WITH {EV}, p AS (SELECT tenant, {DAY_OF} AS dt, CAST(sum(nbytes) AS BIGINT) AS n_bytes FROM ev GROUP BY ALL)
SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY tenant ORDER BY dt DESC) AS BIGINT) AS running_bytes,
  sum(n_bytes) OVER (PARTITION BY tenant ORDER BY dt DESC) > 50000 AS would_drop FROM p""",
    **{
        k: f"""WITH {EV}, {POL} SELECT ev.tenant, arrival_seq, ts FROM ev LEFT JOIN pol USING (tenant)
  WHERE coalesce(max_age_us, 0) = 0 OR epoch_us({DAY_OF}) + {DAY} > epoch_us({AS_OF}) - max_age_us"""
        for k in ("retention_by_tenant", "retention_by_tenant_pruned")
    },
    "downsample_tiers": f"WITH {EV}, {TIERED} SELECT arrival_seq, ts, CAST(resolution_us AS BIGINT) AS resolution_us FROM tiered",
    **{f"downsample_{a}": downsample(a) for a in AGGS},
    "downsample_lineitem": f"""WITH {LI}, t AS (SELECT *, CASE WHEN ts < TIMESTAMP '2001-12-01' - INTERVAL 1095 DAY THEN {28 * DAY}
  WHEN ts < TIMESTAMP '2001-12-01' - INTERVAL 365 DAY THEN {7 * DAY} ELSE 0 END AS resolution_us FROM li)
SELECT tenant, metric, series_id, ts, round(value, 6) AS value, CAST(resolution_us AS BIGINT) AS resolution_us FROM t WHERE resolution_us = 0
UNION ALL SELECT tenant, metric, series_id, {bucket('resolution_us')} AS b,
  round(CASE WHEN resolution_us = {7 * DAY} THEN {LI_LAST} ELSE avg(value) END, 6), CAST(resolution_us AS BIGINT)
FROM t WHERE resolution_us > 0 GROUP BY tenant, metric, series_id, b, resolution_us""",
    "downsample_plan": f"""WITH {EV}, {TIERED} SELECT CAST(resolution_us AS BIGINT) AS resolution_us, count(*) AS n_rows,
  count(DISTINCT (series_id, epoch_us(ts) // resolution_us)) AS n_buckets FROM tiered WHERE resolution_us > 0 GROUP BY ALL""",
    "rollup_progressive": f"""WITH {EV}, t AS (SELECT *, CASE WHEN epoch_us(ts) < epoch_us({AS_OF}) - {7 * DAY} THEN {4 * HOUR}
  WHEN epoch_us(ts) < epoch_us({AS_OF}) - {DAY} THEN {30 * MINUTE} ELSE 0 END AS resolution_us FROM ev)
SELECT tenant, metric, CASE WHEN resolution_us = 0 THEN ts ELSE {bucket('greatest(resolution_us, 1)')} END AS ts, CAST(resolution_us AS BIGINT) AS resolution_us,
  count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,9))) AS DOUBLE) AS s, min(value) AS mn, max(value) AS mx,
  arg_min(value, (t.ts, arrival_seq)) AS first_v, arg_max(value, (t.ts, arrival_seq)) AS last_v
FROM t GROUP BY tenant, metric, CASE WHEN resolution_us = 0 THEN ts ELSE {bucket('greatest(resolution_us, 1)')} END, resolution_us,
  CASE WHEN resolution_us = 0 THEN arrival_seq END""",
    "downsample_by_tenant": f"""WITH {EV}, {POL}, t AS (SELECT ev.*, p.interval_us, p.after_us, p.agg FROM ev LEFT JOIN ptier p
  ON p.tenant = ev.tenant AND epoch_us({AS_OF}) - epoch_us(ts) > p.after_us
  QUALIFY row_number() OVER (PARTITION BY arrival_seq ORDER BY p.interval_us DESC NULLS LAST, p.after_us DESC) = 1)
SELECT tenant, metric, series_id, ts, round(value, 6) AS value, CAST(0 AS BIGINT) AS resolution_us FROM t WHERE interval_us IS NULL
UNION ALL SELECT tenant, metric, series_id, {bucket('interval_us')} AS b, round(CASE agg {' '.join(f"WHEN '{n}' THEN {e}" for n, e in AGGS.items())} END, 6),
  CAST(interval_us AS BIGINT) FROM t WHERE interval_us IS NOT NULL GROUP BY tenant, metric, series_id, b, interval_us, agg""",
    "precision_parts": f"WITH {EV}, {PARTS} SELECT tenant, dt, newest, n_rows, age_us, CAST(bits AS INTEGER) AS bits FROM pb",
    **{f"precision_{b}": f"SELECT event_id AS arrival_seq, {trunc('value', str(b))} AS value FROM events" for b in (8, 16, 32)},
    "precision_apply": f"""WITH {EV}, {PARTS} SELECT ev.tenant, dt, arrival_seq, CAST(bits AS INTEGER) AS bits,
  CASE WHEN bits IS NULL THEN value ELSE {trunc('value', 'coalesce(bits, 52)')} END AS value
FROM ev JOIN pb ON pb.tenant = ev.tenant AND pb.dt = {DAY_OF}""",
    "precision_report": f"""WITH {EV}, {PARTS}, v AS (SELECT bits, value, {trunc('value', 'bits')} AS tv
  FROM ev JOIN pb ON pb.tenant = ev.tenant AND pb.dt = {DAY_OF} WHERE bits IS NOT NULL)
SELECT CAST(bits AS INTEGER) AS bits, count(*) AS n_rows, round(max(CASE WHEN value = 0 THEN 0 ELSE abs((value - tv) / value) END), 9) AS max_rel_error,
  round(avg(CASE WHEN value = 0 THEN 0 ELSE abs((value - tv) / value) END), 9) AS mean_rel_error,
  count(DISTINCT value) AS distinct_before, count(DISTINCT tv) AS distinct_after FROM v GROUP BY bits""",
    "limit_series_hard": f"""WITH {EV}, {SERIES_RANK} SELECT ev.tenant, arrival_seq, ev.series_id, CASE WHEN rk <= 100 THEN 'accepted' ELSE 'shed' END AS verdict
FROM ev JOIN ranked r ON r.tenant = ev.tenant AND r.series_id = ev.series_id""",
    "limit_series_soft": f"WITH {EV}, {SOFT} SELECT tenant, arrival_seq, series_id, verdict FROM tagged",
    "limit_series_incremental": f"WITH {EV}, {SOFT} SELECT tenant, arrival_seq, series_id, verdict FROM tagged",
    "limit_series_by_policy": f"""WITH {EV}, {POL}, {SERIES_RANK},
placed AS (SELECT r.*, nullif(max_series, 0) AS hard, CASE WHEN max_series > 0 THEN nullif(max_series_soft, 0) END AS soft FROM ranked r LEFT JOIN pol USING (tenant)),
over_metric AS (SELECT tenant, metric, row_number() OVER (PARTITION BY tenant ORDER BY min(first_seq)) AS m FROM placed WHERE rk > soft GROUP BY tenant, metric),
verdicts AS (SELECT p.tenant, p.series_id, CASE WHEN rk > soft AND m <= hard - soft THEN 'overflow' WHEN rk > coalesce(soft, hard) THEN 'shed' ELSE 'accepted' END AS verdict
  FROM placed p LEFT JOIN over_metric USING (tenant, metric))
SELECT ev.tenant, arrival_seq, CASE WHEN verdict = 'overflow' THEN md5(ev.tenant || chr(31) || metric || chr(31) || 'overflow=true') ELSE ev.series_id END AS series_id, verdict
FROM ev JOIN verdicts v ON v.tenant = ev.tenant AND v.series_id = ev.series_id""",
    "series_churn": f"""WITH {EV}, d AS (SELECT DISTINCT tenant, metric, {DAY_OF} AS dt, series_id FROM ev),
f AS (SELECT *, dt = min(dt) OVER (PARTITION BY tenant, metric, series_id) AS fresh FROM d),
g AS (SELECT tenant, metric, dt, count(*) AS n_series, CAST(count(*) FILTER (fresh) AS BIGINT) AS n_new FROM f GROUP BY ALL)
SELECT *, CAST(sum(n_new) OVER (PARTITION BY tenant, metric ORDER BY dt) AS BIGINT) AS n_so_far FROM g""",
    "series_between": f"WITH {EV} SELECT tenant, count(DISTINCT series_id) AS n_series FROM ev WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09' GROUP BY ALL",
    **{
        k: f"""WITH RECURSIVE {EV}, rates(tenant, rate) AS (VALUES {rates}),
fast AS (SELECT tenant, rate, arrival_seq, nbytes, 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 5000 AS us FROM ev LEFT JOIN rates USING (tenant)),
o AS MATERIALIZED (SELECT *, (us // 1000000) * rate + (us % 1000000) * rate // 1000000 AS clock, row_number() OVER (PARTITION BY tenant ORDER BY us, arrival_seq) AS rn
  FROM fast WHERE rate > 0),
r AS (SELECT tenant, rn, arrival_seq, us, clock, CASE WHEN nbytes <= rate THEN rate - nbytes ELSE rate END AS level, nbytes <= rate AS ok FROM o WHERE rn = 1
  UNION ALL SELECT o.tenant, o.rn, o.arrival_seq, o.us, o.clock,
    CASE WHEN o.nbytes <= least(rate, r.level + o.clock - r.clock) THEN least(rate, r.level + o.clock - r.clock) - o.nbytes ELSE least(rate, r.level + o.clock - r.clock) END,
    o.nbytes <= least(rate, r.level + o.clock - r.clock)
  FROM r JOIN o ON o.tenant = r.tenant AND o.rn = r.rn + 1)
SELECT tenant, arrival_seq, make_timestamp(us) AS ts, CASE WHEN ok THEN 'accepted' ELSE 'shed' END AS verdict FROM r
UNION ALL SELECT tenant, arrival_seq, make_timestamp(us), 'accepted' FROM fast WHERE coalesce(rate, 0) = 0"""
        for k, rates in (
            ("limit_rate", "('t0', 150), ('t1', 150), ('t2', 150), ('t3', 150)"),
            ("limit_rate_by_policy", "('t0', NULL), ('t1', 120), ('t2', 0), ('t3', 200)"),
        )
    },
    "limit_in_flight": f"""WITH {EV}, e AS (SELECT *, {bucket(str(6 * HOUR))} AS epoch FROM ev)
SELECT tenant, epoch, arrival_seq, CASE WHEN sum(nbytes) OVER (PARTITION BY tenant, epoch ORDER BY ts, arrival_seq ROWS UNBOUNDED PRECEDING) <= 700
  THEN 'accepted' ELSE 'shed' END AS verdict FROM e""",
    "partial_success": f"""WITH {EV}, {SOFT} SELECT tenant, arrival_seq // 500 AS batch, count(*) FILTER (verdict <> 'shed') AS accepted_rows,
  count(*) FILTER (verdict = 'shed') AS rejected_rows, CAST(coalesce(sum(nbytes) FILTER (verdict <> 'shed'), 0) AS BIGINT) AS accepted_bytes,
  CAST(coalesce(sum(nbytes) FILTER (verdict = 'shed'), 0) AS BIGINT) AS rejected_bytes,
  CASE WHEN count(*) FILTER (verdict = 'shed') > 0 THEN 'RESOURCE_EXHAUSTED' END AS reason FROM tagged GROUP BY tenant, batch""",
    "series_usage": f"""WITH {EV}, {POL}, u AS (SELECT tenant, metric, count(DISTINCT series_id) AS n_series FROM ev GROUP BY ALL),
w AS (SELECT tenant, CAST(sum(n_series) AS BIGINT) AS tenant_series FROM u GROUP BY ALL)
SELECT u.tenant, metric, n_series, tenant_series, max_series, max_series_soft,
  coalesce(max_series_soft, 0) > 0 AND tenant_series > coalesce(max_series_soft, 0) AS over_soft,
  coalesce(max_series, 0) > 0 AND tenant_series > coalesce(max_series, 0) AS over_hard
FROM u JOIN w USING (tenant) LEFT JOIN pol USING (tenant)""",
    "sidecar_build": f"""WITH {EV} SELECT tenant, metric, series_id, {bucket(str(HOUR))} AS bucket_ts, count(value) AS n, round(sum(value), 6) AS s, min(value) AS mn,
  max(value) AS mx, {AGGS['first']} AS first_v, {AGGS['last']} AS last_v FROM ev GROUP BY tenant, metric, series_id, bucket_ts""",
    **{
        k: f"""WITH {EV} SELECT tenant, metric, series_id, count(value) AS count, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max,
  {AGGS['first']} AS first, {AGGS['last']} AS last FROM ev
WHERE ts >= TIMESTAMP '2024-01-05 07:17:00' AND ts < TIMESTAMP '2024-01-19 13:41:00' GROUP BY ALL"""
        for k in ("range_agg_sidecar", "range_agg_raw", "range_agg_pyramid")
    },
    "shard_assign": f"WITH {EV}, {SHARDED} SELECT tenant, series_id, arrival_seq, shard FROM sh",
    "hrw_placement": f"WITH {placed('SELECT DISTINCT chr(117) || user_id AS tenant, ' + shard('event_type', 2) + ' AS shard FROM events')} SELECT tenant, shard, replica, node FROM placed",
    "node_load": f"""WITH {EV}, {SHARDED}, {placed('SELECT DISTINCT tenant, shard FROM sh')},
sizes AS (SELECT tenant, shard, count(*) AS n_rows, sum(nbytes) AS n_bytes, count(DISTINCT series_id) AS n_series FROM sh GROUP BY ALL),
l AS (SELECT node, sum(n_rows) AS n_rows, sum(n_bytes) AS n_bytes, sum(n_series) AS n_series FROM sizes JOIN placed USING (tenant, shard) GROUP BY ALL)
SELECT n.node, n.zone, CAST(coalesce(n_rows, 0) AS BIGINT) AS n_rows, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_series, 0) AS BIGINT) AS n_series,
  round(coalesce(n_bytes, 0) / avg(coalesce(n_bytes, 0)) OVER (), 9) AS skew FROM nodes n LEFT JOIN l USING (node)""",
    "replica_dedup": f"""WITH {COPIES} SELECT c.* FROM copies c LEFT JOIN placed p ON p.tenant = c.tenant AND p.shard = c.shard AND p.replica = 0
QUALIFY row_number() OVER (PARTITION BY series_id, ts ORDER BY c.node <> p.node, c.node) = 1""",
    "quorum_audit": f"""WITH {COPIES}, q AS (SELECT series_id, ts, count(DISTINCT node) AS copies, count(DISTINCT node) < 2 AS below_quorum, count(DISTINCT value) > 1 AS disagree
FROM copies GROUP BY ALL) SELECT * FROM q WHERE below_quorum OR disagree""",
    "policy_normalize": f"""WITH {NORM}, dt AS (SELECT tenant, string_agg(concat_ws('/', after_us, interval_us, agg), ';' ORDER BY i) AS downsample FROM dtier GROUP BY tenant),
bt AS (SELECT tenant, string_agg(concat_ws('/', after_us, bits), ';' ORDER BY i) AS precision FROM btier GROUP BY tenant)
SELECT tenant, max_age_us, max_bytes, ingest_bytes_per_second, max_in_flight_bytes, CAST(max_series AS BIGINT) AS max_series, CAST(max_series_soft AS BIGINT) AS max_series_soft,
  max_part_size, downsample, precision, recompress_after_us, recompress_level, metrics, logs, traces, profiles, rf, shards
FROM norm LEFT JOIN dt USING (tenant) LEFT JOIN bt USING (tenant)""",
    "policy_violations": f"WITH {FOUND} SELECT {FINDING} FROM found",
    "policy_first_violation": f"""WITH {FOUND} SELECT {FINDING} FROM found
QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY grp, tier NULLS FIRST, rule) = 1""",
    "doc_flatten": "SELECT event_id AS doc, 'k' AS path, regexp_extract(props, '[0-9]+') AS value_json, 'scalar' AS kind FROM events",
    "doc_merge": f"""WITH {MERGE} SELECT doc, p AS path, value_json, kind FROM base b WHERE NOT EXISTS (
  SELECT 1 FROM eff o WHERE o.doc = b.doc AND (o.p = b.p OR starts_with(b.p, o.p || '.') OR starts_with(o.p, b.p || '.')))
UNION ALL SELECT doc, p, value_json, kind FROM eff""",
    "reserved_paths": f"""WITH {FOUND_PATHS} SELECT doc, path, 'reserved' AS kind, hint FROM hits
UNION ALL SELECT doc, path, 'ancestor_clobber', 'wipes owned paths below it' FROM wipes""",
    "reserved_path_report": f"""WITH {FOUND_PATHS} SELECT doc, count(*) AS n_paths,
  'not open to tenants: ' || string_agg(path || ' (' || hint || ')', ', ' ORDER BY path) AS message FROM hits GROUP BY doc""",
    "effective_policy": f"""SELECT 'c' || c_custkey AS tenant, CASE WHEN c_custkey % 3 = 0 THEN {DAY} ELSE {30 * DAY} END AS max_age_us,
  CASE WHEN c_custkey % 5 = 0 THEN 536870912000 END AS max_bytes, CAST(CASE WHEN c_custkey % 3 <> 1 THEN 1000000 END AS BIGINT) AS max_series,
  CAST(CASE WHEN c_custkey % 3 <> 1 THEN 1073741824 END AS BIGINT) AS max_in_flight_bytes,
  CASE WHEN c_custkey % 4 = 0 THEN '{6 * HOUR}/{MINUTE}/max' ELSE '{DAY}/{5 * MINUTE};{7 * DAY}/{HOUR}/avg' END AS downsample, false AS profiles FROM customer""",
    "config_drift": """WITH d AS (SELECT 'c' || c_custkey AS cluster, substr(sha256('{"rf":' || (c_custkey % 3) || '}'), 1, 16) AS f FROM customer),
o AS (SELECT 'c' || c_custkey AS cluster, substr(sha256('{"rf":' || (c_custkey % 4 % 3) || '}'), 1, 16) AS f FROM customer WHERE c_custkey % 10 <> 0
  UNION ALL SELECT 'x' || c_custkey, substr(sha256('{}'), 1, 16) FROM customer WHERE c_custkey % 50 = 0)
SELECT coalesce(d.cluster, o.cluster) AS cluster, d.f AS desired_fingerprint, o.f AS observed_fingerprint, d.f IS DISTINCT FROM o.f AS needs_rollout
FROM d FULL JOIN o ON d.cluster = o.cluster""",
    "fleet_status": """WITH h AS (SELECT event_type || '/' || (user_id % 20) AS cluster, 'n' || (user_id % 5) AS node, arg_max(value > 10, (ts, event_id)) AS up
  FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY ALL),
r AS (SELECT cluster, count(*) FILTER (up) AS ready FROM h GROUP BY cluster),
k AS (SELECT DISTINCT c_custkey % 20 AS k FROM customer),
w AS (SELECT 'click/' || k AS cluster, k % 3 + 1 AS want FROM k WHERE k % 4 <> 0 UNION ALL SELECT 'silent/' || k, 2 FROM k),
s AS (SELECT coalesce(r.cluster, w.cluster) AS cluster, CAST(coalesce(want, 3) AS BIGINT) AS desired, CAST(coalesce(ready, 0) AS BIGINT) AS ready FROM r FULL JOIN w ON r.cluster = w.cluster)
SELECT *, CASE WHEN ready = 0 THEN 'Pending' WHEN ready < desired THEN 'Progressing' ELSE 'Ready' END AS phase, ready > 0 AS available, ready < desired AS progressing FROM s""",
    "condition_transitions": """WITH c AS (SELECT event_type AS cluster, CASE WHEN user_id % 5 = 0 THEN 'Available' ELSE 'Progressing' END AS condition, ts, event_id AS seq,
  CASE WHEN value > 40 THEN 'True' ELSE 'False' END AS status FROM events),
l AS (SELECT *, lag(status) OVER (PARTITION BY cluster, condition ORDER BY ts, seq) AS previous FROM c)
SELECT cluster, condition, ts AS transition_ts, previous, status FROM l WHERE status IS DISTINCT FROM previous""",
}

_MERGE_TRUNC = trunc("value", "bits")
ORACLES["merge_lifecycle"] = f"""WITH {EV}, {POL},
kept AS (SELECT ev.* FROM ev LEFT JOIN pol USING (tenant) WHERE coalesce(max_age_us, 0) = 0 OR epoch_us({DAY_OF}) + {DAY} > epoch_us({AS_OF}) - max_age_us),
t AS (SELECT kept.*, p.interval_us, p.agg FROM kept LEFT JOIN ptier p ON p.tenant = kept.tenant AND epoch_us({AS_OF}) - epoch_us(ts) > p.after_us
  QUALIFY row_number() OVER (PARTITION BY arrival_seq ORDER BY p.interval_us DESC NULLS LAST, p.after_us DESC) = 1),
rolled AS (SELECT tenant, metric, series_id, ts, value, 0 AS resolution_us FROM t WHERE interval_us IS NULL
  UNION ALL SELECT tenant, metric, series_id, {bucket('interval_us')} AS b, CASE agg {' '.join(f"WHEN '{n}' THEN {e}" for n, e in AGGS.items())} END, interval_us
  FROM t WHERE interval_us IS NOT NULL GROUP BY tenant, metric, series_id, b, interval_us, agg),
ages AS (SELECT tenant, {DAY_OF} AS dt, epoch_us({AS_OF}) - epoch_us(max(ts)) AS age_us FROM kept GROUP BY ALL),
bits AS (SELECT a.tenant, dt, min(bits) AS bits FROM ages a JOIN pbits b ON b.tenant = a.tenant AND age_us > after_us GROUP BY ALL)
SELECT r.tenant, metric, series_id, ts, round(CASE WHEN bits IS NULL THEN value ELSE {_MERGE_TRUNC} END, 6) AS value, CAST(resolution_us AS BIGINT) AS resolution_us,
  {DAY_OF} AS dt, CAST(bits AS INTEGER) AS bits FROM rolled r LEFT JOIN bits b ON b.tenant = r.tenant AND b.dt = {DAY_OF}"""

# One merge at the later date. Cut-offs sit on multiples of their intervals, counted from 1970.
_END, _WIDE = f"epoch_us({AS_OF})", 2 * DAY
_CUT = f"(({_END} - {5 * DAY}) // {_WIDE} * {_WIDE})"
_KEEP = f"(({_END} - {12 * DAY + 7 * HOUR}) // {_WIDE} * {_WIDE})"
ORACLES["merge_lifecycle_twice"] = f"""WITH t AS (SELECT user_id % 7 AS g, event_type AS metric, ts, value, event_id AS arrival_seq,
  CASE WHEN epoch_us(ts) < {_CUT} THEN {_WIDE} WHEN ts < {AS_OF} - INTERVAL 1 DAY THEN {HOUR} ELSE 0 END AS width
  FROM events WHERE user_id % 7 % 2 = 1 OR ts IS NULL OR epoch_us(ts) >= {_KEEP}),
rolled AS (SELECT g, metric, ts, value, width, CAST(value IS NOT NULL AS BIGINT) AS n, ts AS newest FROM t WHERE width = 0
  UNION ALL SELECT g, metric, {bucket('greatest(width, 1)')} AS b, CASE g {' '.join(f"WHEN {i} THEN {e}" for i, e in enumerate(AGGS.values()))} END, width, count(value), max(ts)
  FROM t WHERE width > 0 GROUP BY g, metric, b, width),
ages AS (SELECT g, {DAY_OF} AS dt, {_END} - epoch_us(max(newest)) AS age_us FROM rolled GROUP BY ALL)
SELECT 'g' || r.g AS tenant, metric, ts, round(CASE WHEN age_us > {6 * DAY} THEN {trunc('value', '24')} ELSE value END, 6) AS value,
  CAST(width AS BIGINT) AS resolution_us, CAST(n AS BIGINT) AS n, dt, CASE WHEN age_us > {6 * DAY} THEN 24 END AS bits
FROM rolled r JOIN ages a ON a.g = r.g AND a.dt IS NOT DISTINCT FROM {DAY_OF}"""

ORACLES |= {
    "stream_ingest": f"WITH {EV} SELECT tenant, CAST(ts AS DATE) AS dt, count(*) AS n_rows, CAST(sum(nbytes) AS BIGINT) AS n_bytes, min(ts) AS first_ts, max(ts) AS last_ts FROM ev GROUP BY ALL",
    "stream_rollup": f"""WITH {EV}, b AS (SELECT *, {bucket(str(HOUR))} AS bucket_ts FROM ev)
SELECT tenant, metric, series_id, bucket_ts AS ts, {AGGS['last']} AS value, CAST({HOUR} AS BIGINT) AS resolution_us
FROM b WHERE ts IS NOT NULL GROUP BY tenant, metric, series_id, bucket_ts""",
    "stream_dedup": f"WITH {EV} SELECT DISTINCT tenant, series_id, ts FROM ev",
    "stream_dedup_primary": ORACLES["replica_dedup"],
    "stream_limit_rate": ORACLES["limit_rate"],
    "stream_limit_rate_sliced": ORACLES["limit_rate"],
    "stream_limit_in_flight": ORACLES["limit_in_flight"].replace("SELECT tenant, epoch, arrival_seq", "SELECT tenant, arrival_seq"),
    "stream_partial_success": f"""WITH {EV}, w AS (SELECT *, {bucket(str(HOUR))} AS window_ts, arrival_seq % 3 = 0 AS shed FROM ev)
SELECT tenant, window_ts, count(*) FILTER (NOT shed) AS accepted_rows, count(*) FILTER (shed) AS rejected_rows,
  CAST(coalesce(sum(nbytes) FILTER (NOT shed), 0) AS BIGINT) AS accepted_bytes, CAST(coalesce(sum(nbytes) FILTER (shed), 0) AS BIGINT) AS rejected_bytes,
  CASE WHEN count(*) FILTER (shed) > 0 THEN 'RESOURCE_EXHAUSTED' END AS reason
FROM w WHERE ts IS NOT NULL GROUP BY tenant, window_ts""",
}
ORACLES["stream_repair"] = ORACLES["stream_rollup"]
ORACLES["stream_signals"] = f"""WITH {TELEMETRY}, s AS (SELECT signal, count(*) AS counted_rows, CAST(sum(nbytes) AS BIGINT) AS counted_bytes, signal IN ('metrics', 'logs') AS served FROM tel GROUP BY signal)
SELECT *, CASE WHEN served THEN counted_rows END AS n_rows, CASE WHEN served THEN counted_bytes END AS n_bytes FROM s"""
#: Problems by path, as the rules of the documents are written above.
ORACLES["policy_document_violations"] = f"""WITH d AS ({inputs.document_sql(inputs.BROKEN_POLICY, 'c')})
SELECT doc, p AS path, 'wrong kind' AS problem, CAST(NULL AS INTEGER) AS tier, CAST(NULL AS VARCHAR) AS field FROM d
WHERE (p = 'downsample' AND kind = 'scalar') OR (p = 'retention.max_age' AND kind = 'list') OR (p = 'limits' AND kind = 'scalar')
UNION ALL SELECT doc, p, 'unknown path', NULL, NULL FROM d WHERE p = 'retention.max_agee'
UNION ALL SELECT doc, p, problem, 0, field FROM d, (VALUES ('unknown field', 'intervall'), ('missing field', 'interval')) v(problem, field) WHERE p = 'downsample' AND kind = 'list'"""
