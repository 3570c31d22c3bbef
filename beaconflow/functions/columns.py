"""Small column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column | str) -> Column:
    """Normalise a double for comparison: 6 decimals below 1e4, else 10 significant digits.

    Large magnitudes (epoch seconds ~1.7e9) have no stable 6th decimal across
    engines; scaling to [1, 10), rounding to 9 decimals and scaling back gives
    identical results for nearly equal inputs.  -0.0 becomes 0.0.
    """
    x = F.col(c) if isinstance(c, str) else c
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    big = F.round(x / p, 9) * p
    return (F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x)
            .when(F.abs(x) < F.lit(1e4), F.round(x, 6)).otherwise(big) + F.lit(0.0))


def d(x) -> Column:
    """Double literal."""
    return F.lit(float(x)).cast("double")


def nan_to_null(c: Column | str) -> Column:
    """NaN -> NULL, so that only NULL means missing downstream."""
    col = F.col(c) if isinstance(c, str) else c
    return F.nanvl(col, F.lit(None).cast("double"))


def argmax(arr: Column) -> Column:
    """0-based position of the largest element; the first one wins ties."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def pct(n: Column | str, total: Column | str, digits: int = 2) -> Column:
    """100 * n / total rounded half-up to ``digits`` decimals, in exact integer arithmetic
    (a double-based round can land on either side of a .5 boundary in different engines)."""
    n_ = (F.col(n) if isinstance(n, str) else n).cast("decimal(20,0)")
    t_ = (F.col(total) if isinstance(total, str) else total).cast("decimal(20,0)")
    scaled = n_ * F.lit(2 * 10 ** (digits + 2)).cast("decimal(10,0)") + t_
    return F.call_function("div", scaled, t_ * F.lit(2).cast("decimal(1,0)")) / F.lit(float(10 ** digits))
