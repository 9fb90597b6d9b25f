"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normal quantile of the 95 % interval.
Z = 1.96


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def wilson_lower(successes: Column, n: Column) -> Column:
    """Lower bound of the Wilson score interval; 0 for no trials."""
    p = successes / n
    bound = (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4.0 * n * n))) / (1 + Z * Z / n)
    return F.when(n > 0, bound).otherwise(F.lit(0.0))


def trust_level(n: Column, bound: Column) -> Column:
    return F.when(n == 0, "advisory").when(bound >= 0.9, "autonomous").when(bound >= 0.5, "supervised").otherwise("advisory")


def interpolate(points: list[tuple[float, float]], x: Column) -> Column:
    """Piecewise linear through ``points`` sorted by x, constant outside."""
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)).otherwise(out)
    return F.when(x <= points[0][0], F.lit(points[0][1])).otherwise(out)
