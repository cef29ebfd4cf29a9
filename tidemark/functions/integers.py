"""Exact integer helpers: floors for negatives, clamps and returns in basis points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a: Column, b: Column | int) -> Column:
    """The floor of a / b for bigint a and positive b; null where b isn't positive."""
    a = a.cast("long")
    b = F.lit(b).cast("long") if isinstance(b, int) else F.when(b > 0, b.cast("long"))
    return F.call_function("div", a - F.pmod(a, b), b)


def return_bps(start: Column, end: Column) -> Column:
    """Floored return from start to end in basis points; null for a start that isn't positive."""
    return floor_div((end.cast("long") - start.cast("long")) * 10_000, start)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def round_to_spacing(tick: Column, spacing: Column, up: bool = False) -> Column:
    """The multiple of the spacing at or below (above) a tick."""
    down = floor_div(tick, spacing) * spacing
    return F.when(F.lit(up) & (down != tick), down + spacing).otherwise(down).cast("long")


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)
