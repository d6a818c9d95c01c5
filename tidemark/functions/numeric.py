"""Numbers as column expressions: rounding half up, ratios, windows of change, expected click-through rate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import CTR_CURVE


def half_up(x: Column, digits: int = 0) -> Column:
    """Round with halves toward plus infinity on the scaled double: half_up(-2.5) is -2. Spark's round() differs."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where whole is not positive."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def weighted_position(position: Column, impressions: Column, where: Column | None = None) -> Column:
    """An aggregate: impression-weighted mean position, null without impressions."""
    weight = impressions if where is None else F.when(where, impressions)
    return F.try_divide(F.sum(position * weight), F.nullif(F.sum(weight), F.lit(0)).cast("double"))


def percent_change(before: Column, after: Column) -> Column:
    return F.when(before > 0, (after - before).cast("double") / before * 100.0)


def expected_ctr(position: Column) -> Column:
    """Piecewise-linear over CTR_CURVE, constant beyond its ends; null for null."""
    out = F.when(position <= CTR_CURVE[0][0], F.lit(CTR_CURVE[0][1]))
    for (p0, c0), (p1, c1) in zip(CTR_CURVE, CTR_CURVE[1:], strict=False):
        out = out.when(position <= p1, F.lit(c0) + (position - p0) / float(p1 - p0) * (F.lit(c1) - F.lit(c0)))
    return out.when(position.isNotNull(), F.lit(CTR_CURVE[-1][1]))


def unit_interval(x: Column) -> Column:
    """x within 0 and 1; 0 for null, NaN and infinities."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))).otherwise(F.lit(0.0))


def log_scaled(x: Column, low: float, high: float) -> Column:
    return unit_interval(F.log(F.greatest(x, F.lit(1)).cast("double") / float(low)) / F.log(F.lit(float(high)) / float(low)))
