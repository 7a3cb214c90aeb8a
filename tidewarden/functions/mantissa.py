"""Lossy float precision as plain arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def truncate_mantissa(value: Column, bits: int) -> Column:
    """Keep `bits` significant binary digits of a double (leading 1 included), towards zero.

    53 or more bits is the identity. Truncation, unlike rounding, composes: 32 then 16 is 16. Zero,
    NaN and infinities pass through; subnormals keep relative, not absolute, digits. The scaled
    mantissa stays in [1, 2), so no intermediate overflows.
    """
    if not 1 <= bits <= 63:
        raise ValueError(f"bits must be within 1..63, got {bits}")
    if bits >= 53:
        return value
    a = F.abs(value)
    guess = F.floor(F.log2(a)).cast("double")
    # log2 may land one off next to a power of two.
    exponent = (
        F.when(a < F.pow(F.lit(2.0), guess), guess - 1)
        .when(a >= F.pow(F.lit(2.0), guess + 1), guess + 1)
        .otherwise(guess)
    )
    unit = F.pow(F.lit(2.0), exponent)
    steps = float(2 ** (bits - 1))
    kept = F.signum(value) * F.floor((a / unit) * F.lit(steps)).cast("double") / F.lit(steps) * unit
    passes = value.isNull() | F.isnan(value) | (a == 0) | (a == F.lit(float("inf")))
    return F.when(passes, value).otherwise(kept)


def truncate_by_width(value: Column, bits: Column, widths: list[int]) -> Column:
    """`truncate_mantissa` with the width in a column, over the known distinct widths."""
    out = None
    for w in sorted({w for w in widths if w < 53}):
        branch = truncate_mantissa(value, w)
        out = F.when(bits == w, branch) if out is None else out.when(bits == w, branch)
    return value if out is None else out.otherwise(value)
