"""Points as delimited text: one a line, separated by tabs, commas, semicolons or spaces, with or without a header line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from denspark.operators.points import check_dim

_APART = "[\\t,; ]+"
#: A line of anything but digits, signs, points, exponents and delimiters is a header.
_NUMBERS = "^[-0-9.+eE\\t,; \\r]*$"


def is_header(line: Column) -> Column:
    return ~line.rlike(_NUMBERS)


def _parts(line: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(line, "[\\t,; \\r]+$", ""), "^[\\t,; ]+", ""), _APART)


def read_header(spark: SparkSession, path: str) -> int:
    """Number of columns, from the first line that isn't the header."""
    lines = [r[0] for r in spark.read.text(path).select(F.when(is_header(F.col("value")), F.lit(None)).otherwise(F.size(_parts(F.col("value"))))).limit(2).collect()]
    found = [n for n in lines if n is not None]
    if not found:
        raise ValueError(f"no points in {path}")
    return found[0]


def read_points(spark: SparkSession, path: str, mode: str = "FAILFAST", max_dims: int = 20) -> DataFrame:
    """(id, c0, ...) in the order of the file; ids count the points from 0.

    The first line is skipped as a whole if it is a header.  A line with a value that is no
    number, or another number of values, is an error, or with ``PERMISSIVE`` left out.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError("mode is FAILFAST or PERMISSIVE")
    dim = read_header(spark, path)
    check_dim(dim, max_dims)
    from denspark.operators.scans import enumerate_flags

    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value").where("trim(value) <> ''")
    values = F.transform(_parts(F.col("value")), lambda x: x.try_cast("double"))
    parsed = lines.where(~((F.col("line") == 0) & is_header(F.col("value")))).select("line", values.alias("v"))
    sound = (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull())
    if mode == "FAILFAST":
        if bad := parsed.where(~sound).count():
            raise ValueError(f"{bad} malformed lines in {path}")
    numbered = enumerate_flags(parsed.where(sound), F.lit(True), "line", "id")
    return numbered.select("id", *[F.col("v")[i].alias(f"c{i}") for i in range(dim)])


def write_labels(labelled: DataFrame, path: str, id_col: str = "id") -> None:
    """One label a line under the header ``cluster-id``, in the order of the ids. Several files keep that order by their names."""
    labelled.repartitionByRange(id_col).sortWithinPartitions(id_col).select(F.col("label").alias("cluster-id")).write.mode("overwrite").csv(path, header=True)


#: First word of a file of whole numbers.
INTEGERS = "sequenceInt"


def csv_words(line: Column) -> Column:
    """Words of a line that commas, tabs and line ends part; a space is part of a word."""
    return F.filter(F.split(line, "[,\\t\\r\\n\\x00]+"), lambda x: x != "")


def write_integers(df: DataFrame, path: str, value: str, order: str) -> None:
    """Whole numbers, one a line in the given order, after a line that says what they are."""
    rows = df.select(F.struct(F.lit(1).alias("part"), F.col(order).cast("long").alias("at")).alias("key"), F.col(value).cast("long").cast("string").alias("value"))
    head = df.sparkSession.range(1).select(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("at")).alias("key"), F.lit(INTEGERS).alias("value"))
    rows.union(head).repartitionByRange("key").sortWithinPartitions("key").select("value").write.mode("overwrite").text(path)


def read_integers(spark: SparkSession, path: str) -> DataFrame:
    """(i, value): the whole numbers of such a file in its order, counted from 0; null where a word is none."""
    from denspark.operators.scans import enumerate_flags

    words = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.filter(_parts(F.col("value")), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    first = words.orderBy("line").select(F.col("w")[0].alias("w")).first()
    if first is None or first["w"] != INTEGERS:
        raise ValueError(f"{path} doesn't begin with {INTEGERS}")
    each = words.select("line", F.posexplode("w").alias("at", "w")).select((F.col("line") * 4096 + F.col("at")).alias("order"), F.col("w").try_cast("long").alias("value"))
    return enumerate_flags(each, F.lit(True), "order", "i").where("i > 0").select((F.col("i") - 1).alias("i"), "value")
