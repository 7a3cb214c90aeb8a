"""Text units: durations ("1h30m") to microseconds, quantities ("1.5Gi") to bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Duration units and their length in nanoseconds.
DURATION_UNITS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}

# Quantity suffixes that multiply and suffixes that divide.
QUANTITY_MULTIPLIERS = {
    "": 1,
    "k": 10**3,
    "M": 10**6,
    "G": 10**9,
    "T": 10**12,
    "P": 10**15,
    "E": 10**18,
    "Ki": 2**10,
    "Mi": 2**20,
    "Gi": 2**30,
    "Ti": 2**40,
    "Pi": 2**50,
    "Ei": 2**60,
}
QUANTITY_DIVISORS = {"m": 10**3, "u": 10**6, "n": 10**9}

_NUMBER = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
_DURATION = rf"^[+-]?(?:0|(?:{_NUMBER}(?:ns|us|µs|μs|ms|s|m|h))+)$"
_DURATION_ITEM = rf"{_NUMBER}(?:ns|us|µs|μs|ms|s|m|h)"
_QUANTITY = rf"^[+-]?{_NUMBER}(?:[KMGTPE]i|[numkMGTPE]|[eE][+-]?[0-9]+)?$"
_EXPONENT = rf"^[+-]?{_NUMBER}[eE][+-]?[0-9]+$"
_MAX_LONG = 2**63 - 1


def _lookup(key: Column, table: dict[str, int], sql_type: str) -> Column:
    """Value of a unit; a constant map, so the key is worked out once."""
    entries = [x for k, v in table.items() for x in (F.lit(k), F.lit(v).cast(sql_type))]
    return F.try_element_at(F.create_map(*entries), key)


def _checked(text: Column, pattern: str, value: Column, what: str, strict: bool) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"not a {what}: "), text)).cast("long") if strict else F.lit(None).cast("long")
    return F.when(text.isNull(), F.lit(None).cast("long")).when(text.rlike(pattern), value).otherwise(bad)


def _sign(text: Column) -> Column:
    return F.when(text.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("long")


def duration_us(text: Column, strict: bool = True) -> Column:
    """Microseconds of a duration text; null stays null.

    A part finer than a microsecond rounds away from zero, so a non-zero duration never turns into
    the "disabled" value 0. Malformed text fails the job, or gives null with `strict=False`.
    """
    items = F.regexp_extract_all(text, F.lit(f"({_DURATION_ITEM})"), F.lit(1))
    nanos = F.aggregate(
        items,
        F.lit(0).cast("decimal(38,9)"),
        lambda acc, item: (
            acc
            + F.regexp_extract(item, r"^([0-9.]+)", 1).cast("decimal(19,9)")
            * _lookup(F.regexp_extract(item, r"([a-zµμ]+)$", 1), DURATION_UNITS, "decimal(14,0)")
        ).cast("decimal(38,9)"),
    )
    return _checked(text, _DURATION, _sign(text) * F.ceil(nanos / 1000).cast("long"), "duration", strict)


def quantity_bytes(text: Column, strict: bool = True) -> Column:
    """Whole bytes of a quantity text, fractions rounded away from zero; null stays null."""
    body = F.regexp_replace(text, r"^[+-]", "")
    number = F.regexp_extract(body, rf"^({_NUMBER})", 1).cast("decimal(28,9)")
    suffix = F.regexp_extract(body, r"([A-Za-z]*)$", 1)
    magnitude = (
        F.when(text.rlike(_EXPONENT), F.ceil(body.cast("decimal(38,9)")))
        .when(suffix.isin(*QUANTITY_DIVISORS), F.ceil(number / _lookup(suffix, QUANTITY_DIVISORS, "decimal(10,0)")))
        .otherwise(F.ceil(number * _lookup(suffix, QUANTITY_MULTIPLIERS, "decimal(20,0)")))
    )
    # Values past the 64-bit range saturate.
    whole = F.least(magnitude.cast("decimal(38,0)"), F.lit(_MAX_LONG).cast("decimal(38,0)")).cast("long")
    return _checked(text, _QUANTITY, _sign(text) * whole, "quantity", strict)
