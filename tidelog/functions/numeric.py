"""Column functions on numbers. NULL stands for missing; NaN and infinities become NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column) -> Column:
    """What can't be read as a finite number is NULL."""
    return finite(x.try_cast("double"))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def within(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x where it lies in [low, high], else NULL."""
    test = F.lit(True)
    test = test & (x >= low) if low is not None else test
    return F.when(test & (x <= high) if high is not None else test, x)


def clip(x: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """x moved into [low, high]; a missing x stays missing (greatest and least alone would skip it)."""
    y = x
    y = F.greatest(y, F.lit(low)) if low is not None else y
    y = F.least(y, F.lit(high)) if high is not None else y
    return F.when(x.isNotNull(), y)


def ratio(x: Column, y: Column) -> Column:
    """x / y, NULL where y is 0."""
    return finite(F.try_divide(x, y))


def bounded_ratio(x: Column, y: Column, low: float, high: float, default: float) -> Column:
    return clip(F.coalesce(ratio(x, y), F.lit(default)), low, high)


def code_name(x: Column, names: dict[int, str]) -> Column:
    pairs = [F.lit(v) for item in names.items() for v in item]
    return F.element_at(F.create_map(*pairs), x)


def bands(x: Column, edges: list[float], labels: list[str], right_closed: bool = False, missing: str | None = None) -> Column:
    """The label of the interval that x falls into; len(labels) == len(edges) + 1."""
    out = F.when(x.isNull(), F.lit(missing))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(x <= edge if right_closed else x < edge, label)
    return out.otherwise(labels[-1])


def draught(x: Column) -> Column:
    """Tenths of a metre; 255 and above mean 25.5 or more, 0 and below unknown."""
    return F.when(x >= 255, 25.5).when(x > 0, x / 10.0)


def movement(sog: Column) -> Column:
    return F.when(sog.isNull(), "SOG_UNKNOWN").when(sog <= 0.5, "STOPPED").when(sog <= 5, "SLOW").otherwise("MOVING")


def row_mean(*xs: Column) -> Column:
    present = F.array_compact(F.array(*xs))
    return ratio(F.aggregate(present, F.lit(0.0), lambda a, b: a + b), F.size(present).cast("double"))


def row_std(*xs: Column) -> Column:
    """Sample deviation over the columns that are present; NULL for fewer than two."""
    present, mean = F.array_compact(F.array(*xs)), row_mean(*xs)
    squares = F.aggregate(present, F.lit(0.0), lambda a, b: a + (b - mean) * (b - mean))
    return F.when(F.size(present) > 1, F.sqrt(squares / (F.size(present) - 1)))


def row_median(*xs: Column) -> Column:
    present = F.array_sort(F.array_compact(F.array(*xs)))
    n = F.size(present)
    low, high = F.get(present, ((n - 1) / 2).cast("int")), F.get(present, (n / 2).cast("int"))
    return (low + high) / 2.0


def row_spread(*xs: Column) -> Column:
    return F.greatest(*xs) - F.least(*xs)


def argmin(xs: list[Column], names: list[str]) -> Column:
    """The name of the least column, the first on ties; missing ones don't compete."""
    least = F.least(*xs)
    return reduce(lambda out, pair: out.when(pair[0] == least, pair[1]), zip(xs, names, strict=True), F.when(least.isNull(), F.lit(None).cast("string")))


def zero_filled(x: Column) -> Column:
    return F.coalesce(finite(x), F.lit(0.0))
