"""Statistics as column expressions: proportions with intervals, ratings, tails, trends, crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.96


def dbl(x: Column | float) -> Column:
    """A double column, so that no literal turns a ratio into a decimal."""
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles, null where b is 0 or null."""
    return F.try_divide(dbl(a), F.nullif(dbl(b), dbl(0.0)))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson score interval (low, high) of a proportion, clipped to [0, 1]; (0, 1) for n = 0."""
    p, m, zz = ratio(hits, n), F.nullif(dbl(n), dbl(0.0)), z * z
    denominator = 1 + zz / m
    centre = (p + zz / (2 * m)) / denominator
    half = z * F.sqrt(p * (1 - p) / m + zz / (4 * m * m)) / denominator
    return F.coalesce(F.greatest(dbl(0.0), centre - half), dbl(0.0)), F.coalesce(F.least(dbl(1.0), centre + half), dbl(1.0))


def rating(value: Column, direction: str, green: float | tuple | None, amber: float | tuple | None) -> Column:
    """green, amber, red, info or insufficient_data. direction: lower, higher, band (both limits are pairs) or info."""
    if direction == "info" or green is None:
        shown = F.lit("info")
    elif direction == "band":
        shown = F.when(value.between(*green), "green").when(value.between(*amber), "amber").otherwise("red")
    elif direction == "lower":
        shown = F.when(value <= green, "green").when(value <= amber, "amber").otherwise("red")
    else:
        shown = F.when(value >= green, "green").when(value >= amber, "amber").otherwise("red")
    return F.when(value.isNull(), "insufficient_data").otherwise(shown)


def size_band(n: Column) -> Column:
    """A public band for a count; 0 falls into the first."""
    return F.when(n < 20, "1-19").when(n < 100, "20-99").when(n < 1000, "100-999").when(n < 10_000, "1k-10k").otherwise("10k+")


def poisson_tail(rate: Column, k: Column) -> Column:
    """P(N >= k) for a Poisson count: 1 for k <= 0, else 0 for rate <= 0."""
    below = F.aggregate(
        F.sequence(F.lit(0), F.greatest(k, F.lit(1)).cast("int") - 1),
        F.struct(dbl(0.0).alias("sum"), F.exp(-dbl(rate)).alias("term")),
        lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * dbl(rate) / (i + 1)).alias("term")),
        lambda a: a["sum"],
    )
    return F.when(k <= 0, dbl(1.0)).when(rate <= 0, dbl(0.0)).otherwise(F.greatest(dbl(0.0), 1 - below))


def trend(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least squares per group: (<by>, points, last_x, slope, intercept); slope and intercept null under 3 points or for one x."""
    enough = (F.count(y) >= 3) & (F.max(x) > F.min(x))
    return points.groupBy(*by).agg(
        F.count(y).alias("points"),
        F.max(x).alias("last_x"),
        F.when(enough, F.regr_slope(F.col(y), F.col(x))).alias("slope"),
        F.when(enough, F.regr_intercept(F.col(y), F.col(x))).alias("intercept"),
    )


def crossing(slope: Column, intercept: Column, level: float, last_x: Column, rising: bool) -> Column:
    """Where the line reaches ``level`` after ``last_x``, null if it runs the other way or did so before."""
    at = F.try_divide(dbl(level) - intercept, F.nullif(slope, dbl(0.0)))
    return F.when((slope > 0) if rising else (slope < 0), F.when(at > last_x, at))


def ewma(values: Column, alpha: float) -> Column:
    """The exponentially weighted mean of an array, from its first value on; null for an empty one."""
    return F.when(
        F.size(values) > 0,
        F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values), F.lit(1))), F.get(values, F.lit(0)), lambda a, v: alpha * v + (1 - alpha) * a),
    )


def sound(x: Column) -> Column:
    """A quantity as it is, or null where it is no finite number of 0 or more."""
    return F.when(~F.isnan(x) & (x >= 0) & (x < float("inf")), x)
