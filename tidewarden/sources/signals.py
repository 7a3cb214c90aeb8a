"""Signal routing: rows of a disabled signal are neither served nor stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import SIGNALS


def enabled_signals(toggles: dict[str, bool | None] | None) -> list[str]:
    """Signals that are on; an unset toggle means on. All off is an error."""
    toggles = toggles or {}
    unknown = set(toggles) - set(SIGNALS)
    if unknown:
        raise ValueError(f"unknown signals: {sorted(unknown)}")
    on = [s for s in SIGNALS if toggles.get(s) is not False]
    if not on:
        raise ValueError("at least one signal must be enabled")
    return on


def served(df: DataFrame, toggles: dict[str, bool | None] | None) -> DataFrame:
    """Rows of enabled signals, with a literal filter that prunes a table partitioned by signal."""
    return df.filter(F.col("signal").isin(*enabled_signals(toggles)))


def route_signals(df: DataFrame, toggles: dict[str, bool | None] | None) -> dict[str, DataFrame]:
    return {s: df.filter(F.col("signal") == s) for s in enabled_signals(toggles)}


def served_by_policy(df: DataFrame, policies: DataFrame) -> DataFrame:
    """Rows whose tenant serves their signal; no policy row means every signal is on."""
    on: Column = F.lit(True)
    for s in SIGNALS:
        on = F.when(F.col("signal") == s, F.coalesce(F.col("_toggles")[s], F.lit(True))).otherwise(on)
    return df.join(policies.select("tenant", F.col("signals").alias("_toggles")), "tenant", "left").filter(on).drop("_toggles")


def write_signals(df: DataFrame, path: str, toggles: dict[str, bool | None] | None, mode: str = "append") -> None:
    """One pass over the input; each signal lands in its own directory."""
    served(df, toggles).write.mode(mode).partitionBy("signal").parquet(path)
