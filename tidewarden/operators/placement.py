"""Shards and their rendezvous placement on nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import shard_of

MAX_NODES = 4096


def with_shard(df: DataFrame, shards: int | None, series: str = "series_id") -> DataFrame:
    """`df` plus `shard`, a stable function of the series; 0 or 1 shards put all in shard 0."""
    return df.withColumn("shard", shard_of(F.col(series), shards))


def read_nodes(nodes: DataFrame) -> list[tuple[str, str]]:
    """The node list of a cluster. It becomes part of the plan, so its size is checked."""
    rows = nodes.select("node", "zone").distinct().limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError(f"a cluster of more than {MAX_NODES} nodes")
    return sorted((r["node"], r["zone"]) for r in rows)


def replica_nodes(key: Column, nodes: list[tuple[str, str]], rf: int) -> Column:
    """The RF nodes of a key, best first: highest hash, distinct zones before a zone repeats.

    Every node is hashed with the key; inside a zone nodes line up by hash, and zones then take
    turns, the better hash first. All of it happens in the row, so keys are never paired with nodes
    by a join.
    """
    if rf < 1:
        raise ValueError("the replication factor must be at least 1")
    by_zone: dict[str, list[str]] = {}
    for node, zone in nodes:
        by_zone.setdefault(zone, []).append(node)
    ranked = []
    for members in by_zone.values():
        scored = F.transform(
            F.array(*[F.lit(m) for m in sorted(members)]),
            lambda n: F.struct(F.md5(F.concat_ws("|", key, n)).alias("hash"), n.alias("node")),
        )
        best = F.slice(F.sort_array(scored, asc=False), 1, rf)
        ranked.append(F.transform(best, lambda s, i: F.struct((-i).alias("turn"), s["hash"].alias("hash"), s["node"].alias("node"))))
    line = F.sort_array(F.concat(*ranked), asc=False)
    return F.transform(F.slice(line, 1, rf), lambda s: s["node"])


def place_shards(keys: DataFrame, nodes: list[tuple[str, str]], rf: int) -> DataFrame:
    """One row (tenant, shard, replica, node) per copy; replica 0 is the primary.

    `keys` holds distinct (tenant, shard) pairs.
    """
    chosen = replica_nodes(F.concat_ws("/", "tenant", "shard"), nodes, rf)
    # Outer: a plain explode adds a size check on the array, which sinks below the caller's distinct
    # and would place every row instead of every key.
    return keys.select("tenant", "shard", F.posexplode_outer(chosen).alias("replica", "node"))


def shard_sizes(df: DataFrame, shards: int | None, series: str = "series_id") -> DataFrame:
    """Rows, bytes and series per (tenant, shard); one shuffle by series, then a tiny one.

    The shard is a function of the series, so it is hashed once per series, not once per row.
    """
    return (
        df.groupBy("tenant", series)
        .agg(F.count("*").alias("_rows"), F.sum("nbytes").alias("_bytes"))
        .withColumn("shard", shard_of(F.col(series), shards))
        .groupBy("tenant", "shard")
        .agg(F.sum("_rows").alias("n_rows"), F.sum("_bytes").alias("n_bytes"), F.count("*").alias("n_series"))
    )


def node_load(df: DataFrame, nodes: list[tuple[str, str]], rf: int, shards: int | None, series: str = "series_id") -> DataFrame:
    """Load the placement puts on each node, and its ratio to the mean over all nodes."""
    sizes = shard_sizes(df, shards, series)
    chosen = replica_nodes(F.concat_ws("/", "tenant", "shard"), nodes, rf)
    load = (
        sizes.withColumn("node", F.explode_outer(chosen))
        .groupBy("node")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_series").alias("n_series"))
    )
    everyone = df.sparkSession.createDataFrame(nodes, "node string, zone string")
    idle = F.lit(0).cast("long")
    full = everyone.join(load, "node", "left").select(
        "node", "zone", *[F.coalesce(c, idle).alias(c) for c in ("n_rows", "n_bytes", "n_series")]
    )
    # One row per node, so the window is bounded by MAX_NODES.
    mean = F.avg("n_bytes").over(Window.partitionBy(F.lit(0)))
    return full.withColumn("skew", F.try_divide(F.col("n_bytes").cast("double"), mean))
