"""Joins by distance.

A bare distance predicate would be planned as a nested loop, so the join is given bucket
keys: on up to three dimensions, those with the largest extent, buckets a little wider
than eps; the left side asks the buckets next to its own.  The buckets only prefilter,
the distance decides, so the result is exact in any dimension.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from denspark.functions.vectors import cell_index, columns, dist_sqr, in_box
from denspark.operators.points import Extent, dimension
from denspark.storage import checkpointed

#: Dimensions that are bucketed; 3 ** this is how often the left side is repeated.
BLOCKED = 3
#: Guard against rounding at a bucket's edge.
WIDER = 1.0000001
#: Pairs that a last round of ``knn`` may compare without any radius.
ALL_PAIRS = 1 << 24


def _bucketed(points: DataFrame, box: Extent, eps: float) -> tuple[DataFrame, list[str]]:
    dim = dimension(points)
    widest = sorted(range(dim), key=lambda i: (box.low[i] - box.high[i], i))[:BLOCKED]
    index = cell_index([F.col(f"c{i}") for i in widest], [box.low[i] for i in widest], eps * WIDER)
    names = [f"b{i}" for i in range(len(widest))]
    return points.withColumns(dict(zip(names, index, strict=True))), names


def eps_join(left: DataFrame, right: DataFrame, box: Extent, eps: float, halved: bool = False) -> DataFrame:
    """Pairs of rows of two point tables within eps: all columns, the right ones with an ``r_`` before them, and ``d2``.

    halved: of a table with itself, each pair in one order only, a row with itself included;
    a bucket asks itself and the half of the buckets next to it that come after it.
    """
    dim = dimension(left)
    asking, names = _bucketed(left, box, eps)
    held, _ = _bucketed(right, box, eps)
    own = (0,) * len(names)
    steps = F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(names, o, strict=True)], F.lit(o == own).alias("own")) for o in itertools.product((-1, 0, 1), repeat=len(names)) if not halved or o >= own])
    asking = asking.withColumn("step", F.explode(steps)).withColumns({n: F.col(n) + F.col(f"step.{n}") for n in names} | ({"own": F.col("step.own")} if halved else {})).drop("step")
    held = held.select(*names, *[F.col(c).alias(f"r_{c}") for c in right.columns])
    near = asking.join(held, names).drop(*names)
    if halved:
        near = near.where(~F.col("own") | (F.col("id") <= F.col("r_id")))
    d2 = dist_sqr(columns(dim), columns(dim, "r_c"))
    return near.withColumn("d2", d2).where(F.col("d2") <= F.lit(float(eps) * float(eps)))


def eps_pairs(points: DataFrame, box: Extent, eps: float) -> DataFrame:
    """(a, b, d2) for all ordered pairs within eps, each point with itself included.

    A pair is found once and given in both orders one after the other, where its distance
    compresses to one.
    """
    both = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), "d2")
    pairs = eps_join(points.select("id", *columns(dimension(points))), points, box, eps, halved=True)
    one = F.col("own") & (F.col("id") == F.col("r_id"))
    return pairs.select(F.inline(F.when(one, F.array(both("id", "r_id"))).otherwise(F.array(both("id", "r_id"), both("r_id", "id")))))


def eps_counts(points: DataFrame, box: Extent, eps: float) -> DataFrame:
    """(id, n): how many points are within eps of each, itself included.

    Equal points are one place with a multiplicity, so their pairs aren't made.
    """
    at = [f"c{i}" for i in range(dimension(points))]
    places = checkpointed(points.groupBy(*at).agg(F.count("*").alias("times")))
    counted = eps_join(places.select(*at), places, box, eps).groupBy(*at).agg(F.sum("r_times").alias("n"))
    return points.join(counted, at).select("id", "n")


def eps_links(points: DataFrame, box: Extent, eps: float) -> DataFrame:
    """Links (a, b) that join the same points into the same components as ``eps_pairs``, without the pairs of equal points.

    The least ids of different places within eps are linked once; every other point is
    linked with the least id of its place.
    """
    at = [f"c{i}" for i in range(dimension(points))]
    places = checkpointed(points.groupBy(*at).agg(F.min("id").alias("id")))
    between = eps_join(places, places, box, eps).where("id < r_id").select(F.col("id").alias("a"), F.col("r_id").alias("b"))
    copies = points.join(places.withColumnRenamed("id", "place"), at).where("id <> place").select(F.col("place").alias("a"), F.col("id").alias("b"))
    return between.unionByName(copies)


def nearest_within(left: DataFrame, right: DataFrame, box: Extent, eps: float) -> DataFrame:
    """(id, near, d2): the nearest right point within eps of each left one, ties to the least id; null where there is none."""
    best = eps_join(left, right, box, eps).groupBy("id").agg(F.min(F.struct("d2", "r_id")).alias("best"))
    return left.select("id").join(best, "id", "left").select("id", F.col("best.r_id").alias("near"), F.col("best.d2").alias("d2"))


def range_query(points: DataFrame, at: list[float], radius: float) -> DataFrame:
    """Points within the closed ball around a place."""
    d2 = dist_sqr(columns(dimension(points)), [F.lit(float(x)) for x in at])
    return points.withColumn("d2", d2).where(F.col("d2") <= F.lit(float(radius) * float(radius)))


def box_query(points: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    return points.where(in_box(columns(dimension(points)), low, high))


def first_radius(points: DataFrame, box: Extent, k: int) -> float:
    """A radius within which a point has about k neighbours where most points are.

    Begins with what even density over the whole extent would give, and shrinks it for as
    long as buckets of that width hold far more, counted over distinct points and weighted
    by them; so a few far points don't make it cover the mass of the others.
    """
    dim = len(box.low)
    widths = [h - m for h, m in zip(box.high, box.low, strict=True)]
    least = (sum(w * w for w in widths) ** 0.5 or 1.0) * 1e-9
    radius = max(max(widths) * (2.0 * k / box.rows) ** (1.0 / dim), least)
    distinct = points.select(*columns(dim)).distinct()
    while radius > least:
        bucketed, names = _bucketed(distinct, box, radius)
        held = bucketed.groupBy(*names).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
        if held <= 16 * k:
            break
        radius = max(radius / max(2.0, (held / (2.0 * k)) ** (1.0 / len(names))), least)
    return radius


def knn(queries: DataFrame, points: DataFrame, k: int, box: Extent | None = None, start: float | None = None) -> DataFrame:
    """(id, near, d2, rank): the k nearest points of each query, ties to the lesser id, itself included if it is one of them.

    Searches within a radius and doubles it for the queries that have found fewer than k,
    so no query is compared with all points unless the data force it, or so few are left
    that this is cheap.
    """
    from denspark.operators.points import extent

    box = box or extent(points)
    here = extent(queries)
    if not here.rows or not box.rows:
        return queries.select("id", F.lit(None).cast("long").alias("near"), F.lit(None).cast("double").alias("d2"), F.lit(None).cast("int").alias("rank")).limit(0)
    # Equal queries have one answer, and of equal points only the k least ids can be in any.
    at = [f"c{i}" for i in range(len(box.low))]
    held = points.withColumn("__nth", F.row_number().over(Window.partitionBy(*at).orderBy("id"))).where(F.col("__nth") <= k).drop("__nth")
    held = checkpointed(held)
    rows = held.count()
    asked = checkpointed(queries.groupBy(*at).agg(F.min("id").alias("id")))
    radius = start or first_radius(held, box, k)
    box = Extent(box.rows, tuple(map(min, box.low, here.low)), tuple(map(max, box.high, here.high)))
    spread = sum((h - m) ** 2 for h, m in zip(box.high, box.low, strict=True)) ** 0.5 or 1.0
    wanted, left, parts = min(k, box.rows), asked, []
    by = Window.partitionBy("id").orderBy("d2", "r_id")
    while True:
        near = eps_join(left, held, box, radius).select("id", "r_id", "d2")
        ranked = near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= wanted)
        ranked = checkpointed(ranked)
        full = ranked.where(F.col("rank") == wanted).select("id")
        parts.append(ranked.join(full, "id", "left_semi"))
        left = checkpointed(left.join(full, "id", "left_anti"))
        remaining = left.count()
        if not remaining:
            break
        radius = 2 * max(radius, spread) if remaining * rows <= ALL_PAIRS else 2 * radius
    out = reduce(DataFrame.unionByName, parts).join(asked, "id").select(*at, F.col("r_id").alias("near"), "d2", "rank")
    return queries.select("id", *at).join(out, at).select("id", "near", "d2", "rank")


def closest_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """(u, v, d2): the closest pair of two sets, ties to the lesser ids."""
    near = knn(left, right, 1)
    return near.agg(F.min(F.struct("d2", F.col("id").alias("u"), F.col("near").alias("v"))).alias("best")).select("best.u", "best.v", "best.d2")
