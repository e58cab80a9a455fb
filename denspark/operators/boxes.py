"""Bounding boxes: (g, l0.., h0..) tables and the relations of two boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from denspark.operators.points import dimension


def bounding_box(points: DataFrame, by: str | None = None) -> DataFrame:
    dim = dimension(points)
    corners = [F.min(f"c{i}").alias(f"l{i}") for i in range(dim)] + [F.max(f"c{i}").alias(f"h{i}") for i in range(dim)]
    return points.groupBy(by).agg(*corners) if by else points.agg(*corners)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda s, x: s & x, parts)


def relation(dim: int, a: str = "a", b: str = "b") -> Column:
    """'include' if b's box lies in a's, 'exclude' if they are apart, else 'overlap'."""
    col = lambda t, c: F.col(f"{t}.{c}")
    inside = _all([(col(a, f"l{i}") <= col(b, f"l{i}")) & (col(b, f"h{i}") <= col(a, f"h{i}")) for i in range(dim)])
    meet = _all([(col(a, f"l{i}") <= col(b, f"h{i}")) & (col(b, f"l{i}") <= col(a, f"h{i}")) for i in range(dim)])
    return F.when(inside, F.lit("include")).when(meet, F.lit("overlap")).otherwise(F.lit("exclude"))


def box_distance(dim: int, a: str = "a", b: str = "b") -> Column:
    """Least distance of two boxes."""
    gaps = [F.greatest(F.col(f"{a}.l{i}") - F.col(f"{b}.h{i}"), F.col(f"{b}.l{i}") - F.col(f"{a}.h{i}"), F.lit(0.0)) for i in range(dim)]
    return F.sqrt(reduce(lambda s, x: s + x, [g * g for g in gaps]))


def box_far_distance(dim: int, a: str = "a", b: str = "b") -> Column:
    """Diagonal of the box around both."""
    spans = [F.greatest(F.col(f"{a}.h{i}"), F.col(f"{b}.h{i}")) - F.least(F.col(f"{a}.l{i}"), F.col(f"{b}.l{i}")) for i in range(dim)]
    return F.sqrt(reduce(lambda s, x: s + x, [g * g for g in spans]))


def diagonal(dim: int, a: str = "a") -> Column:
    return F.sqrt(reduce(lambda s, x: s + x, [(F.col(f"{a}.h{i}") - F.col(f"{a}.l{i}")) * (F.col(f"{a}.h{i}") - F.col(f"{a}.l{i}")) for i in range(dim)]))


def longest_side(dim: int, a: str = "a") -> Column:
    return F.greatest(*[F.col(f"{a}.h{i}") - F.col(f"{a}.l{i}") for i in range(dim)])


def well_separated(dim: int, s: float = 2.0, a: str = "a", b: str = "b") -> Column:
    """Whether the balls around two boxes, each with half its box's diagonal as radius, are apart by s times the larger radius or more."""
    one, other = diagonal(dim, a) / 2.0, diagonal(dim, b) / 2.0
    mid = [(F.col(f"{a}.l{i}") + F.col(f"{a}.h{i}")) / 2.0 - (F.col(f"{b}.l{i}") + F.col(f"{b}.h{i}")) / 2.0 for i in range(dim)]
    apart = F.sqrt(reduce(lambda x, y: x + y, [m * m for m in mid]))
    return apart - one - other >= s * F.greatest(one, other)
