"""Shards, placement, replicas, sidecar and fleet status."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewarden.functions.hashing import shard_of
from tidewarden.functions.timeline import HOUR
from tidewarden.operators.fleet import condition_transitions, fleet_status
from tidewarden.operators.placement import node_load, place_shards, read_nodes
from tidewarden.operators.replicas import dedup_replicas, quorum_audit
from tidewarden.operators.sidecar import AGGREGATES, build_sidecar, range_aggregate

T0 = datetime(2024, 1, 1)


def keys(spark, n=200):
    return spark.range(n).selectExpr("concat('t', id) AS tenant", "0 AS shard")


def placed(spark, nodes, rf):
    out = {}
    for r in place_shards(keys(spark), nodes, rf).orderBy("replica").collect():
        out.setdefault(r["tenant"], []).append(r["node"])
    return out


def test_zones_before_repeats(spark):
    nodes = [("a", "z0"), ("b", "z0"), ("c", "z0"), ("d", "z1"), ("e", "z2")]
    zone = dict(nodes)
    for chosen in placed(spark, nodes, 3).values():
        assert len({zone[n] for n in chosen}) == 3
    for chosen in placed(spark, nodes, 4).values():
        assert len(set(chosen)) == 4 and len({zone[n] for n in chosen[:3]}) == 3
    assert all(len(c) == 5 for c in placed(spark, nodes, 9).values())


def test_a_new_node_moves_only_its_own_keys(spark):
    nodes = [(n, "z") for n in "abcd"]
    before, after = placed(spark, nodes, 2), placed(spark, [*nodes, ("e", "z")], 2)
    moved = [k for k in before if before[k] != after[k]]
    assert 0 < len(moved) < len(before)
    assert all("e" in after[k] and set(after[k]) - {"e"} <= set(before[k]) for k in moved)


def test_one_shard(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("s"))
    for n in (None, 0, 1):
        assert df.select(shard_of(F.col("s"), n).alias("x")).distinct().collect() == [(0,)]
    assert df.select(shard_of(F.col("s"), 4).alias("x")).distinct().count() == 4


def test_load_counts_every_copy(samples):
    df = samples([("t", "m", u, u, 0) for u in range(40)])
    load = node_load(df, [("a", "z0"), ("b", "z1"), ("c", "z1")], 2, 4).collect()
    assert sum(r["n_rows"] for r in load) == 80 and sum(r["n_series"] for r in load) == 80
    assert abs(sum(r["skew"] for r in load) / 3 - 1) < 1e-9


def test_node_list_is_checked(spark, monkeypatch):
    monkeypatch.setattr("tidewarden.operators.placement.MAX_NODES", 3)
    with pytest.raises(ValueError):
        read_nodes(spark.range(4).selectExpr("cast(id AS string) AS node", "'z' AS zone"))


COPIES = "series_id string, ts timestamp, tenant string, shard int, node string, value double"


def test_primary_copy_wins(spark):
    rows = [("s", T0, "t", 0, n, v) for n, v in (("a", 1.0), ("b", 2.0), ("c", 3.0))] + [("r", T0, "t", 0, "c", 5.0), ("r", T0, "t", 0, "a", 4.0)]
    df = spark.createDataFrame(rows, COPIES)
    primary = spark.createDataFrame([("t", 0, "b")], "tenant string, shard int, node string")
    got = {r["series_id"]: (r["node"], r["value"]) for r in dedup_replicas(df, primary).collect()}
    assert got == {"s": ("b", 2.0), "r": ("a", 4.0)}


def test_quorum(spark):
    rows = [("ok", T0, "t", 0, n, 1.0) for n in "abc"] + [("few", T0, "t", 0, "a", 1.0), ("few", T0, "t", 0, "a", 1.0)]
    rows += [("odd", T0, "t", 0, "a", 1.0), ("odd", T0, "t", 0, "b", 2.0), ("hole", T0, "t", 0, "a", None), ("hole", T0, "t", 0, "b", 2.0)]
    got = {r["series_id"]: (r["copies"], r["below_quorum"], r["disagree"]) for r in quorum_audit(spark.createDataFrame(rows, COPIES), 3).collect()}
    assert got == {"few": (1, True, False), "odd": (2, False, True), "hole": (2, False, True)}


@pytest.mark.parametrize("frm,to", [(0, 10 * 3600), (61, 7205), (10, 20), (3600, 7200), (1, 3600), (0, 5)])
def test_sidecar_range_equals_raw(samples, frm, to):
    df = samples([("t", "m", i % 3, i * 97, i / 4) for i in range(300)])
    a, b = (T0 + timedelta(seconds=s) for s in (frm, to))
    raw = range_aggregate(df, None, a, b, HOUR, AGGREGATES)
    fast = range_aggregate(df, build_sidecar(df, HOUR), a, b, HOUR, AGGREGATES)
    assert sorted(map(tuple, raw.collect())) == sorted(map(tuple, fast.collect()))


def test_phases(spark):
    want = [("c0", 0, 3, "Pending", False, True), ("c2", 2, 3, "Progressing", True, True), ("c3", 3, 3, "Ready", True, False), ("c4", 4, 3, "Ready", True, False)]
    beats = [(c, f"n{i}", T0, True) for c, ready, *_ in want for i in range(ready)]
    # An older heartbeat and one after the as-of time do not count.
    beats += [("c2", "n0", T0 - timedelta(hours=1), False), ("c2", "n9", T0 + timedelta(hours=1), True), ("lone", "n0", T0, True)]
    desired = spark.createDataFrame([(c, 3) for c, *_ in want], "cluster string, replicas int")
    out = fleet_status(spark.createDataFrame(beats, "cluster string, node string, ts timestamp, ready boolean"), desired, T0)
    got = {r["cluster"]: (r["ready"], r["desired"], r["phase"], r["available"], r["progressing"]) for r in out.collect()}
    assert got == {c: tuple(rest) for c, *rest in want} | {"lone": (1, 3, "Progressing", True, True)}


def test_repeats_do_not_move_the_transition(spark):
    rows = [("c", "Ready", T0 + timedelta(minutes=i), i, s) for i, s in enumerate("TTFFFTTTF")]
    out = condition_transitions(spark.createDataFrame(rows, "cluster string, condition string, ts timestamp, seq long, status string"))
    assert [(r["transition_ts"].minute, r["previous"], r["status"]) for r in out.orderBy("transition_ts").collect()] == [
        (0, None, "T"), (2, "T", "F"), (5, "F", "T"), (8, "T", "F"),
    ]
