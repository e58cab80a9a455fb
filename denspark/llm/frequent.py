"""The most frequent rows of a counted table, without an ordered limit.

An ordered limit sends that many rows of every partition to the driver.  Counts are
graded instead, small ones exactly and larger ones 64 grades to a doubling; the grades
that fit the limit together are collected, so the driver gets about ``limit`` rows and a
few thousand grades, however many partitions there are.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from denspark.storage import checkpointed

if TYPE_CHECKING:  # executors import this module and need no pandas
    import pandas as pd

EXACT, GRADES = 4096, 64


def most_frequent(counted: DataFrame, count: str, key: str, limit: int) -> pd.DataFrame:
    """At most ``limit`` rows of the highest counts, most frequent first, ties by key; of the grade that doesn't fit, a part by a hash of the key."""
    counted = checkpointed(counted)
    above = F.lit(EXACT) + F.floor(F.log2(F.col(count) / EXACT) * GRADES)
    grade = F.when(F.col(count) < EXACT, F.col(count)).otherwise(above).cast("int")
    sizes = sorted(((r["grade"], r["n"]) for r in counted.groupBy(grade.alias("grade")).agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted, total = F.lit(False), 0
    for value, n in sizes:
        if total + n > limit:
            draw = F.shiftrightunsigned(F.xxhash64(key, F.lit("part")), 11).cast("double") / F.lit(float(1 << 53))
            wanted = wanted | ((grade == value) & (draw < (limit - total) / n))
            break
        wanted, total = grade >= value, total + n
    return counted.where(wanted).toPandas().sort_values([count, key], ascending=[False, True], ignore_index=True)[:limit]
