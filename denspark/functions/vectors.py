"""Vector functions over scalar coordinate columns.

A point is a list of columns, so that every expression stays inside generated code; sums
run from the first dimension to the last, which fixes the floating-point result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Sequence[Column]


def columns(dim: int, prefix: str = "c", table: str | None = None) -> list[Column]:
    return [F.col(f"{table}.{prefix}{i}" if table else f"{prefix}{i}") for i in range(dim)]


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(lambda s, x: s + x, parts)


def dist_sqr(a: Point, b: Point) -> Column:
    return _sum([(x - y) * (x - y) for x, y in zip(a, b, strict=True)])


def dist(a: Point, b: Point) -> Column:
    return F.sqrt(dist_sqr(a, b))


def dot(a: Point, b: Point) -> Column:
    return _sum([x * y for x, y in zip(a, b, strict=True)])


def subtract(a: Point, b: Point) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def scale(a: Point, by: float | Column) -> list[Column]:
    return [x * by for x in a]


def divide(a: Point, by: float | Column) -> list[Column]:
    return [x / by for x in a]


def multiply(a: Point, b: Point) -> list[Column]:
    return [x * y for x, y in zip(a, b, strict=True)]


def midpoint(a: Point, b: Point) -> list[Column]:
    return [(x + y) / 2 for x, y in zip(a, b, strict=True)]


def normalize(a: Point) -> list[Column]:
    size = F.sqrt(dot(a, a))
    return [x / size for x in a]


def min_coords(a: Point, b: Point) -> list[Column]:
    return [F.least(x, y) for x, y in zip(a, b, strict=True)]


def max_coords(a: Point, b: Point) -> list[Column]:
    return [F.greatest(x, y) for x, y in zip(a, b, strict=True)]


def same(a: Point, b: Point) -> Column:
    return reduce(lambda s, x: s & x, [x == y for x, y in zip(a, b, strict=True)])


def orthant(a: Point, centre: Sequence[float]) -> Column:
    """Bit i is set where coordinate i is over the centre's."""
    return _sum([F.when(x > F.lit(float(m)), F.lit(1 << i)).otherwise(F.lit(0)) for i, (x, m) in enumerate(zip(a, centre, strict=True))])


def out_of_box(a: Point, centre: Sequence[float], half: float) -> Column:
    return reduce(lambda s, x: s | x, [(x < F.lit(float(m) - half)) | (x > F.lit(float(m) + half)) for x, m in zip(a, centre, strict=True)])


def in_box(a: Point, low: Sequence[float], high: Sequence[float]) -> Column:
    return reduce(lambda s, x: s & x, [x.between(F.lit(float(u)), F.lit(float(v))) for x, u, v in zip(a, low, high, strict=True)])


def shown(a: Point) -> Column:
    return F.concat_ws(" ", *[x.cast("string") for x in a])


def cell_index(a: Point, origin: Sequence[float], side: float) -> list[Column]:
    """Grid indices; floor of a double is a long in Spark."""
    return [F.floor((x - F.lit(float(m))) / F.lit(float(side))).cast("long") for x, m in zip(a, origin, strict=True)]
