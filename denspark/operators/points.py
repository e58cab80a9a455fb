"""The table of points: ``id`` and one double column ``c0 .. c{d-1}`` for each dimension."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from denspark.functions.vectors import columns


@dataclass(frozen=True)
class Extent:
    """Rows and corners of a table of points."""

    rows: int
    low: tuple[float, ...]
    high: tuple[float, ...]


def check_parameters(eps: float, min_samples: int) -> None:
    if not (isinstance(eps, (int, float)) and math.isfinite(eps) and eps > 0):
        raise ValueError("eps must be a positive finite number")
    if int(min_samples) != min_samples or min_samples < 1:
        raise ValueError("min_samples must be a whole number of at least 1")


def check_dim(dim: int, max_dims: int = 20) -> None:
    if dim < 2 or dim > max_dims:
        raise ValueError(f"points must have 2 to {max_dims} dimensions, not {dim}")


def to_points(df: DataFrame, features: Sequence[str | Column] | str, id_col: str, dim: int | None = None, max_dims: int = 20) -> DataFrame:
    """Project to (id, c0, ...). Features are numeric columns, or one array column of ``dim`` numbers; ids are whole numbers."""
    kind = df.select(id_col).schema[0].dataType
    if isinstance(kind, (DoubleType, FloatType)) or isinstance(kind, DecimalType) and kind.scale:
        raise ValueError(f"{id_col} must hold whole numbers: others would fall together")
    if isinstance(features, str):
        if dim is None:
            raise ValueError("an array column needs its number of dimensions")
        chosen = [F.col(features)[i] for i in range(dim)]
    else:
        chosen = [F.col(f) if isinstance(f, str) else f for f in features]
    check_dim(len(chosen), max_dims)
    return df.select(F.col(id_col).cast("long").alias("id"), *[x.cast("double").alias(f"c{i}") for i, x in enumerate(chosen)])


def from_array(spark: SparkSession, x: np.ndarray, max_dims: int = 20) -> DataFrame:
    """Points of a two-dimensional array; ids are its row numbers."""
    x = np.asarray(x, np.float64)
    if x.ndim != 2:
        raise ValueError("the array must have two axes")
    check_dim(x.shape[1], max_dims)
    import pandas as pd

    frame = pd.DataFrame({"id": np.arange(len(x), dtype=np.int64)} | {f"c{i}": x[:, i] for i in range(x.shape[1])})
    return spark.createDataFrame(frame, ", ".join(["id long", *[f"c{i} double" for i in range(x.shape[1])]]))


def dimension(points: DataFrame) -> int:
    return sum(c[0] == "c" and c[1:].isdigit() for c in points.columns)


def extent(points: DataFrame) -> Extent:
    """Corners in one pass that also refuses null, NaN and infinite coordinates."""
    dim = dimension(points)
    bad = F.lit(False)
    for c in columns(dim):
        bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    row = points.agg(F.count("*"), F.count_if(bad), F.count_if(F.col("id").isNull()), *[F.min(c) for c in columns(dim)], *[F.max(c) for c in columns(dim)]).first()
    if row[1]:
        raise ValueError(f"{row[1]} points have a null, NaN or infinite coordinate")
    if row[2]:
        raise ValueError(f"{row[2]} points have no id")
    return Extent(row[0], tuple(row[3 : 3 + dim]), tuple(row[3 + dim :]))
