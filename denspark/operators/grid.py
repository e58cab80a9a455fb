"""The grid: cells of side ``eps / sqrt(dim)``, whose diagonal is eps, counted from the least corner."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from denspark.functions.vectors import cell_index, columns
from denspark.operators.points import dimension
from denspark.operators.scans import dense_rank_over


def side_of(eps: float, dim: int) -> float:
    return eps / math.sqrt(dim)


def keys(dim: int) -> list[str]:
    return [f"k{i}" for i in range(dim)]


def min_corner(points: DataFrame) -> DataFrame:
    return points.agg(*[F.min(f"c{i}").alias(f"m{i}") for i in range(dimension(points))])


def with_cells(points: DataFrame, origin: Sequence[float], side: float) -> DataFrame:
    """Points with their cell's indices k0, k1, ..."""
    dim = dimension(points)
    return points.withColumns(dict(zip(keys(dim), cell_index(columns(dim), origin, side), strict=True)))


def cells(celled: DataFrame) -> DataFrame:
    """Cells that hold points, and how many."""
    return celled.groupBy(*keys(dimension(celled))).agg(F.count("*").alias("n"))


def dense_cells(celled: DataFrame, min_samples: int) -> DataFrame:
    """Cells whose points are all core, because a cell's points are all within eps of each other."""
    return cells(celled).where(F.col("n") >= min_samples)


def cell_centres(cell_table: DataFrame, origin: Sequence[float], side: float, dim: int) -> DataFrame:
    return cell_table.select(*keys(dim), *[(F.lit(side / 2) + F.lit(float(m)) + F.col(f"k{i}") * F.lit(side)).alias(f"x{i}") for i, m in enumerate(origin)])


def cell_at(celled: DataFrame, at: Sequence[float], origin: Sequence[float], side: float) -> DataFrame:
    """The points of the cell that holds a place; none if it holds no point."""
    here = [math.floor((x - m) / side) for x, m in zip(at, origin, strict=True)]
    return celled.where(reduce(lambda s, x: s & x, [F.col(k) == i for k, i in zip(keys(len(here)), here, strict=True)]))


def cell_number(cell_table: DataFrame, number: int, dim: int) -> DataFrame:
    """The cell that comes at a place, from 0, in the order of the indices; none beyond the last."""
    return dense_rank_over(cell_table.withColumn("__cell", F.struct(*keys(dim))), "__cell", "__number").where(F.col("__number") == number + 1).drop("__cell", "__number")


def offsets(dim: int, within: int) -> list[tuple[int, ...]]:
    """Index offsets whose squares sum to at most ``within``."""
    reach = math.isqrt(within)
    return [o for o in itertools.product(range(-reach, reach + 1), repeat=dim) if sum(x * x for x in o) <= within]


def neighbour_cells(cell_table: DataFrame, dim: int, within: int | None = None) -> DataFrame:
    """Pairs of cells (k.., q..), itself included, whose centres are at most ``sqrt(within)`` sides apart.

    ``dim + 3`` by default, which in two dimensions is every cell that eps can reach.
    """
    step = F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"o{i}") for i, x in enumerate(o)]) for o in offsets(dim, dim + 3 if within is None else within)])).alias("o")
    names = [f"q{i}" for i in range(dim)]
    asked = cell_table.select(*keys(dim), step).select(*keys(dim), *[(F.col(f"k{i}") + F.col(f"o.o{i}")).alias(q) for i, q in enumerate(names)])
    return asked.join(cell_table.select(*[F.col(k).alias(q) for k, q in zip(keys(dim), names, strict=True)]), names, "inner").select(*keys(dim), *names)


def neighbour_points(celled: DataFrame, within: int | None = None) -> DataFrame:
    """Cells and the points of their neighbour cells: (k.., id)."""
    dim = dimension(celled)
    near = neighbour_cells(cells(celled), dim, within)
    owned = celled.select(*[F.col(f"k{i}").alias(f"q{i}") for i in range(dim)], "id")
    return near.join(owned, [f"q{i}" for i in range(dim)]).select(*keys(dim), "id")
