"""Scans over a whole table in an order, in two phases.

A window without a partition would put all rows into one task.  Here rows are dealt out
by ranges of the order, each range is scanned on its own, and the totals of the ranges
before it are added; only the totals, a row for each range, come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from denspark.storage import checkpointed


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with the number of their range; written once, since the ranges come from a sample."""
    return checkpointed(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))


def scan(df: DataFrame, value: str, order: str | list[str], out: str, inclusive: bool = False, backward: bool = False) -> DataFrame:
    """Adds the running sum of ``value``: of the rows before (after, if ``backward``), with the row's own if ``inclusive``."""
    order = [order] if isinstance(order, str) else order
    ranged = _ranged(df, order)
    by = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    frame = Window.partitionBy("__range").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    totals = ranged.groupBy("__range").agg(F.sum(value).alias("__total"))
    earlier = Window.orderBy(F.col("__range").desc() if backward else F.col("__range").asc()).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__range", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))  # a row for each range
    own = F.coalesce(F.sum(value).over(frame), F.lit(0))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(out, F.col("__own") + F.col("__before")).drop("__own", "__before", "__range")


def prefix_sum(df: DataFrame, value: str, order: str | list[str], out: str) -> DataFrame:
    return scan(df, value, order, out)


def enumerate_flags(df: DataFrame, flag: str | Column, order: str | list[str], out: str) -> DataFrame:
    """Adds how many rows before this one have the flag."""
    flagged = df.withColumn("__flag", F.coalesce((F.col(flag) if isinstance(flag, str) else flag).cast("long"), F.lit(0)))
    return scan(flagged, "__flag", order, out).drop("__flag")


def dense_rank_over(df: DataFrame, key: str, out: str) -> DataFrame:
    """Adds the dense rank of ``key`` over the whole table, from 1."""
    distinct = df.select(key).distinct().withColumn("__one", F.lit(1).cast("long"))
    ranked = scan(distinct, "__one", key, out, inclusive=True).drop("__one")
    return df.join(ranked, key)


def split_stable(df: DataFrame, flag: str, order: str, out: str) -> DataFrame:
    """Adds the place of each row when rows without the flag come first, in order, and then those with it."""
    numbered = scan(df.withColumn("__off", (~F.col(flag)).cast("long")).withColumn("__on", F.col(flag).cast("long")), "__off", order, "__before_off")
    numbered = scan(numbered, "__on", order, "__before_on")
    falses = df.agg(F.count_if(~F.col(flag))).first()[0]
    return numbered.withColumn(out, F.when(F.col(flag), F.col("__before_on") + F.lit(falses)).otherwise(F.col("__before_off")).cast("long")).drop("__off", "__on", "__before_off", "__before_on")


def arg_max(df: DataFrame, value: str, index: str, last: bool = False) -> DataFrame:
    """The index of the greatest value; of ties the first, or the last. An index that isn't a number takes a second pass for the first."""
    if not last and not isinstance(df.schema[index].dataType, NumericType):
        greatest = df.agg(F.max(value).alias("__greatest"))  # one row
        return df.join(F.broadcast(greatest), F.col(value) == F.col("__greatest")).agg(F.min(index).alias("arg_max"))
    return df.agg(F.max_by(index, F.struct(value, F.col(index) if last else -F.col(index))).alias("arg_max"))


def arg_min(df: DataFrame, value: str, index: str) -> DataFrame:
    """The index of the least value; of ties the first."""
    return df.agg(F.min_by(index, F.struct(value, index)).alias("arg_min"))


def transpose(df: DataFrame, row: str, column: str) -> DataFrame:
    """A sparse matrix with rows and columns exchanged."""
    swapped = {row: column, column: row}
    return df.select(*[F.col(swapped.get(c, c)).alias(c) for c in df.columns])


def pack_two(df: DataFrame, first: Column | str, second: Column | str, order: str, name: str) -> DataFrame:
    """The rows of two flags, those of the first as part 1 and of the second as part 2, each numbered from 0 in the given order."""
    flags = [F.col(x) if isinstance(x, str) else x for x in (first, second)]
    parts = [enumerate_flags(df.where(flag), F.lit(True), order, name).withColumn("part", F.lit(i)) for i, flag in enumerate(flags, 1)]
    return parts[0].unionByName(parts[1])


def bit_flags(df: DataFrame, flag: Column | str, position: str, name: str = "bits") -> DataFrame:
    """(word, bits): flags by their position packed into words of 63 bits."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    bit = F.when(flag, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(position, F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))
    return df.groupBy(F.floor(F.col(position) / 63).cast("long").alias("word")).agg(F.bit_or(bit).alias(name))


def log2_up(x: Column) -> Column:
    """The least whole number whose power of two is at least x; 0 up to 1."""
    return F.when(x <= 1, F.lit(0)).otherwise(F.length(F.bin(x - 1))).cast("int")
