"""Density-based clustering as a chain of relational stages.

points -> distinct places -> cells -> core places -> cell links -> components -> labels

Equal points are one place with a multiplicity, so heaps of equal points cost nothing.
Places of cells with ``min_samples`` points or more are core without a distance test.
Components are found over cells, not points.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from denspark.functions.vectors import columns, dist_sqr
from denspark.operators.components import least_reachable
from denspark.operators.grid import keys, side_of, with_cells
from denspark.operators.neighbors import eps_join
from denspark.operators.points import Extent, check_parameters, dimension, extent, to_points
from denspark.operators.scans import dense_rank_over
from denspark.storage import checkpointed


class Stages:
    """The stages of one run over a table of points; each is a DataFrame, made when first asked for."""

    def __init__(self, points: DataFrame, eps: float, min_samples: int, neighbor_rule: str = "exact"):
        check_parameters(eps, min_samples)
        if neighbor_rule not in ("exact", "centre_radius"):
            raise ValueError("neighbor_rule is 'exact' or 'centre_radius'")
        self.points, self.eps, self.min_samples, self.rule = points, float(eps), int(min_samples), neighbor_rule
        self.dim = dimension(points)
        self.side = side_of(self.eps, self.dim)
        self.box: Extent = extent(points)
        self.coordinates = [f"c{i}" for i in range(self.dim)]
        self._made: dict[str, DataFrame] = {}
        #: Seconds that each stage took which is kept, the stages that it asked for included.
        self.seconds: dict[str, float] = {}

    def _once(self, name: str, make, keep: bool = True) -> DataFrame:
        """keep: write it, because it is read more than once."""
        if name not in self._made:
            began = time.monotonic()
            self._made[name] = checkpointed(make()) if keep else make()
            if keep:
                self.seconds[name] = time.monotonic() - began
        return self._made[name]

    def _near(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs within eps; under the centre-radius rule only those of cells that it looks at."""
        pairs = eps_join(left, right, self.box, self.eps)
        if self.rule == "exact":
            return pairs
        apart = reduce(lambda s, x: s + x, [(F.col(k) - F.col(f"r_{k}")) * (F.col(k) - F.col(f"r_{k}")) for k in keys(self.dim)])
        return pairs.where(apart <= self.dim + 3)

    @property
    def places(self) -> DataFrame:
        """Distinct points: id (the least of them), coordinates, cell, times, and whether the cell is dense."""

        def make() -> DataFrame:
            distinct = self.points.groupBy(*self.coordinates).agg(F.count("*").alias("times"), F.min("id").alias("id"))
            celled = with_cells(distinct, self.box.low, self.side)
            dense = celled.groupBy(*keys(self.dim)).agg((F.sum("times") >= self.min_samples).alias("dense"))
            return celled.join(dense, keys(self.dim))

        return self._once("places", make)

    def of_points(self, places: DataFrame) -> DataFrame:
        """The rows of a table of places, for each of a place's points once, with the point's id."""
        if self.places.count() == self.box.rows:  # no two points are equal: a place's id is its point's
            return places
        at = self.points.join(self.places.select(*self.coordinates, F.col("id").alias("__place")), self.coordinates).select(F.col("id").alias("__point"), "__place")
        return at.join(places, F.col("__place") == F.col("id")).select(F.col("__point").alias("id"), *[c for c in places.columns if c != "id"])

    @property
    def core(self) -> DataFrame:
        """Places that have ``min_samples`` points or more within eps, themselves included."""

        def make() -> DataFrame:
            sparse = self.places.where(~F.col("dense"))
            counted = self._near(sparse, self.places).groupBy("id").agg(F.sum("r_times").alias("n")).where(F.col("n") >= self.min_samples)
            return self.places.where("dense").unionByName(sparse.join(counted.select("id"), "id", "left_semi").select(*self.places.columns))

        return self._once("core", make)

    @property
    def core_cells(self) -> DataFrame:
        """Cells with a core place; ``cell`` is the least id of their core places, and their core's box."""
        return self._once(
            "core_cells",
            lambda: self.core.groupBy(*keys(self.dim)).agg(F.min("id").alias("cell"), *[F.min(c).alias(f"l{i}") for i, c in enumerate(self.coordinates)], *[F.max(c).alias(f"h{i}") for i, c in enumerate(self.coordinates)]),
        )

    @property
    def owned(self) -> DataFrame:
        """Core places with the number of their cell."""
        return self._once("owned", lambda: self.core.join(self.core_cells.select(*keys(self.dim), "cell"), keys(self.dim)))

    @property
    def cell_edges(self) -> DataFrame:
        """Pairs of core cells (a < b) with core places within eps of each other.

        A few places of each cell, the extreme ones, settle most pairs; only the places of
        pairs that are still open, and whose boxes are near enough, are compared in full.
        """

        def make() -> DataFrame:
            ends = [f(F.struct(F.col(c).alias("by"), *self.coordinates, "id")) for c in self.coordinates for f in (F.min, F.max)]
            scouts = self.owned.groupBy("cell", *keys(self.dim)).agg(F.array_distinct(F.array(*[F.struct(*[e[x].alias(x) for x in self.coordinates], e["id"].alias("id")) for e in ends])).alias("p"))
            scouts = scouts.select("cell", *keys(self.dim), F.explode("p").alias("p")).select("cell", *keys(self.dim), *[F.col(f"p.{x}").alias(x) for x in self.coordinates], F.col("p.id").alias("id"))
            between = (F.col("cell") < F.col("r_cell"))
            quick = checkpointed(self._near(scouts, scouts).where(between).select(F.col("cell").alias("a"), F.col("r_cell").alias("b")).distinct())
            # Cells that the quick links have already put together need no further look.
            labels = least_reachable(quick)
            part = self.owned.join(labels.select(F.col("vertex").alias("cell"), F.col("label")), "cell", "left").withColumn("label", F.coalesce("label", "cell"))
            part = part.select("id", *self.coordinates, *keys(self.dim), "cell", "label")
            open_ = checkpointed(self._near_other(part))
            if open_.isEmpty():
                return quick
            apart = self._near(open_, open_).where(between & (F.col("label") != F.col("r_label")))
            return quick.union(apart.select(F.col("cell").alias("a"), F.col("r_cell").alias("b")).distinct())

        return self._once("cell_edges", make, keep=False)

    def _near_other(self, part: DataFrame) -> DataFrame:
        """Places whose cell has a cell of another label in eps's reach; the rest can't link anything new."""
        blocked = min(self.dim, 3)
        reach = int(self.dim**0.5) + 2
        names = [f"z{i}" for i in range(blocked)]
        boxes = part.select("cell", "label", *keys(self.dim)).distinct().withColumns({z: F.floor(F.col(f"k{i}") / reach).cast("long") for i, z in enumerate(names)})
        steps = F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(z) for z, x in zip(names, o, strict=True)]) for o in itertools.product((-1, 0, 1), repeat=blocked)])).alias("o")
        asking = boxes.select("cell", "label", *keys(self.dim), *names, steps).withColumns({z: F.col(z) + F.col(f"o.{z}") for z in names}).drop("o")
        held = boxes.select(*names, F.col("label").alias("r_label"), *[F.col(k).alias(f"r_{k}") for k in keys(self.dim)])
        gap = [F.greatest(F.abs(F.col(k) - F.col(f"r_{k}")) - 1, F.lit(0)) for k in keys(self.dim)]
        apart = reduce(lambda s, x: s + x, [g * g for g in gap])
        asked = asking.join(held, names).where((F.col("label") != F.col("r_label")) & (apart <= self.dim)).select("cell").distinct()
        return part.join(asked, "cell", "left_semi")

    @property
    def components(self) -> DataFrame:
        """(cell, root): the connected components of the core cells."""

        def make() -> DataFrame:
            labels = least_reachable(self.cell_edges)
            return self.core_cells.select("cell").join(labels.select(F.col("vertex").alias("cell"), F.col("label").alias("root")), "cell", "left").select("cell", F.coalesce("root", "cell").alias("root"))

        return self._once("components", make)

    @property
    def numbered(self) -> DataFrame:
        """(root, label): clusters counted from 0 in the order of their greatest core cell."""

        def make() -> DataFrame:
            greatest = self.components.join(self.core_cells, "cell").groupBy("root").agg(F.max(F.struct(*keys(self.dim))).alias("cell"))
            return dense_rank_over(greatest, "cell", "label").select("root", (F.col("label") - 1).cast("int").alias("label"))

        return self._once("numbered", make, keep=False)

    @property
    def core_labels(self) -> DataFrame:
        """(id, coordinates, cell, label) of core places; ``of_points`` has their points."""
        return self._once("core_labels", lambda: self.owned.join(self.components, "cell").join(self.numbered, "root").select("id", *self.coordinates, *keys(self.dim), "label"))

    @property
    def border_labels(self) -> DataFrame:
        """(id, label) of places that aren't core but within eps of one: the label of the nearest, ties to the least id."""

        def make() -> DataFrame:
            others = self.places.join(self.core.select("id"), "id", "left_anti").select("id", *self.coordinates, *keys(self.dim))
            near = self._near(others, self.core_labels)
            return near.groupBy("id").agg(F.min_by("r_label", F.struct("d2", "r_id")).alias("label"))

        return self._once("border_labels", make, keep=False)

    @property
    def labels(self) -> DataFrame:
        """(id, label, is_core) of all points; noise is -1."""

        def make() -> DataFrame:
            placed = self.core_labels.select("id", "label", F.lit(True).alias("is_core")).unionByName(self.border_labels.select("id", "label", F.lit(False).alias("is_core")))
            if self.places.count() == self.box.rows:  # no two points are equal: a place's id is its point's
                return self.places.select("id").join(placed, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("is_core", F.lit(False)).alias("is_core"))
            every = self.places.select("id", *self.coordinates).join(placed, "id", "left").drop("id")
            return self.points.join(every, self.coordinates).select("id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("is_core", F.lit(False)).alias("is_core"))

        return self._once("labels", make, keep=False)


def cluster(points: DataFrame, eps: float, min_samples: int, neighbor_rule: str = "exact") -> DataFrame:
    """(id, label, is_core) for a table of points (id, c0, ...)."""
    stages = Stages(points, eps, min_samples, neighbor_rule)
    if not stages.box.rows:
        return points.select("id", F.lit(-1).alias("label"), F.lit(False).alias("is_core"))
    return stages.labels


def dbscan(df: DataFrame, features: Sequence[str | Column] | str, eps: float = 0.5, min_samples: int = 5, id_col: str = "id", dim: int | None = None, max_dims: int = 20, neighbor_rule: str = "exact") -> DataFrame:
    """Label every row of ``df`` with its cluster (-1: noise) and whether it is core: adds ``label`` and ``is_core``.

    Two rows are neighbours if their distance is at most ``eps``; a row is core if it has
    ``min_samples`` neighbours, itself included; clusters are the connected components of
    core rows; another row takes the cluster of its nearest core row within ``eps``, of
    several equally near the one with the least id.  Clusters are numbered in the order of
    the greatest grid cell that holds a core row of theirs.

    ``id_col`` must be unique; null, NaN and infinite coordinates are refused.
    """
    if {"label", "is_core"} & set(df.columns):
        raise ValueError("the table already has a column named label or is_core")
    points = to_points(df, features, id_col, dim, max_dims)
    labelled = cluster(points, eps, min_samples, neighbor_rule).withColumnRenamed("id", "__point")
    return df.join(labelled, F.col(id_col).cast("long") == F.col("__point")).drop("__point")
