"""Stable identifiers: the same text always gives the same series, shard and node order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_FIELD = "\x1f"
_ENTRY = "\x1e"


def series_id(tenant: Column, metric: Column, labels: Column) -> Column:
    """Identity of a series: tenant, metric and the label entries in key order."""
    entries = F.array_sort(F.map_entries(labels))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), _ENTRY)
    return F.md5(F.concat_ws(_FIELD, tenant, metric, text))


def series_id_of(tenant: Column, metric: Column, labels: dict[str, Column]) -> Column:
    """`series_id` for labels whose names are known when the plan is built.

    The same identity, without a map, a sort or a lambda in the row, so it stays in generated code.
    """
    text = F.concat_ws(_ENTRY, *[F.concat(F.lit(f"{k}="), labels[k]) for k in sorted(labels)]) if labels else F.lit("")
    return F.md5(F.concat_ws(_FIELD, tenant, metric, text))


def shard_of(key: Column, shards: int | Column | None) -> Column:
    """Shard of a key; null, 0 and 1 shards all mean shard 0."""
    n = F.lit(shards) if shards is None or isinstance(shards, int) else shards
    prefix = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    spread = F.when(F.coalesce(n, F.lit(0)) > 1, F.pmod(prefix, n.cast("long"))).otherwise(F.lit(0)).cast("int")
    # Never null, so a join on it adds no null check that would hash every row twice.
    return F.coalesce(spread, F.lit(0))


def fingerprint(document: Column) -> Column:
    """Short digest of a rendered document."""
    return F.substring(F.sha2(document, 256), 1, 16)
