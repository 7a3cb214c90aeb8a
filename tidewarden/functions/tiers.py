"""Age tiers as constant CASE expressions and literal cut-offs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .timeline import floor_us, instant

AGGREGATES = ("last", "first", "min", "max", "sum", "avg", "count")
DEFAULT_AGGREGATE = "last"


@dataclass(frozen=True)
class RollupTier:
    """Samples older than `after_us` become one row per `interval_us` bucket."""

    after_us: int
    interval_us: int
    agg: str | None = None

    def __post_init__(self) -> None:
        if self.interval_us <= 0:
            raise ValueError("a rollup interval must be positive")
        if self.after_us < 0:
            raise ValueError("a tier age must not be negative")
        if self.agg is not None and self.agg not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.agg!r}")

    @property
    def aggregate(self) -> str:
        return self.agg or DEFAULT_AGGREGATE

    def cutoff_us(self, as_of_us: int, snapped: bool = False) -> int:
        """Rows strictly before this instant are past the tier's age."""
        cut = as_of_us - self.after_us
        return floor_us(cut, self.interval_us) if snapped else cut


@dataclass(frozen=True)
class PrecisionTier:
    """Parts older than `after_us` keep `bits` mantissa bits."""

    after_us: int
    bits: int

    def __post_init__(self) -> None:
        if not 1 <= self.bits <= 63:
            raise ValueError("bits must be within 1..63")
        if self.after_us < 0:
            raise ValueError("a tier age must not be negative")


def coarsest_first(tiers: list[RollupTier]) -> list[RollupTier]:
    """Tiers by choice order: widest interval, then larger age. Input order never matters."""
    seen: set[int] = set()
    for t in tiers:
        if t.after_us in seen:
            raise ValueError(f"two rollup tiers share the age {t.after_us}us")
        seen.add(t.after_us)
    return sorted(tiers, key=lambda t: (t.interval_us, t.after_us), reverse=True)


def tier_index(ts: Column, tiers: list[RollupTier], as_of_us: int, snapped: bool = False) -> Column:
    """Index into `coarsest_first(tiers)` of the tier a sample takes; null = stays raw."""
    out = None
    for i, t in enumerate(coarsest_first(tiers)):
        hit = ts < instant(t.cutoff_us(as_of_us, snapped))
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def tier_interval(ts: Column, tiers: list[RollupTier], as_of_us: int, snapped: bool = False) -> Column:
    """Interval in microseconds of the tier a sample takes; 0 = stays raw."""
    out = None
    for t in coarsest_first(tiers):
        hit = ts < instant(t.cutoff_us(as_of_us, snapped))
        width = F.lit(t.interval_us).cast("long")
        out = F.when(hit, width) if out is None else out.when(hit, width)
    raw = F.lit(0).cast("long")
    return raw if out is None else out.otherwise(raw)


def raw_from_us(tiers: list[RollupTier], as_of_us: int, snapped: bool = False) -> int | None:
    """Samples at or after this instant are younger than every tier (None: there are no tiers)."""
    return max((t.cutoff_us(as_of_us, snapped) for t in tiers), default=None)


def precision_bits(age_us: Column, tiers: list[PrecisionTier]) -> Column:
    """Fewest bits among the tiers an age has exceeded; null = lossless."""
    out = None
    for t in sorted(tiers, key=lambda t: (t.bits, t.after_us)):
        hit = age_us > t.after_us
        out = F.when(hit, F.lit(t.bits)) if out is None else out.when(hit, F.lit(t.bits))
    return F.lit(None).cast("int") if out is None else out
