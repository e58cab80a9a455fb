"""Agreement of two labellings, from their contingency table, and column scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(df: DataFrame, truth: str, label: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, truth: str, label: str) -> DataFrame:
    """homogeneity, completeness, v_measure and adjusted_rand of a labelling against the truth, in one row."""
    table = contingency(df, truth, label)
    rows = table.groupBy("truth").agg(F.sum("n").alias("a"))
    cols = table.groupBy("label").agg(F.sum("n").alias("b"))
    total = table.agg(F.sum("n").cast("double").alias("t"))
    pairs = lambda x: x * (x - 1) / 2.0
    joint = table.join(rows, "truth").join(cols, "label").crossJoin(F.broadcast(total))  # one row on the right
    within = joint.agg(F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("b"))).alias("h_ck"), F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("a"))).alias("h_kc"), F.sum(pairs(F.col("n"))).alias("index"))
    truths = rows.crossJoin(F.broadcast(total)).agg(F.sum(-F.col("a") / F.col("t") * F.log(F.col("a") / F.col("t"))).alias("h_c"), F.sum(pairs(F.col("a"))).alias("sum_a"), F.first("t").alias("t"))
    labels = cols.crossJoin(F.broadcast(total)).agg(F.sum(-F.col("b") / F.col("t") * F.log(F.col("b") / F.col("t"))).alias("h_k"), F.sum(pairs(F.col("b"))).alias("sum_b"))
    one = within.crossJoin(truths).crossJoin(labels)  # single rows
    expected = F.col("sum_a") * F.col("sum_b") / pairs(F.col("t"))
    highest = (F.col("sum_a") + F.col("sum_b")) / 2.0
    out = one.select(
        F.when(F.col("h_c") == 0, 1.0).otherwise(1 - F.col("h_ck") / F.col("h_c")).alias("homogeneity"),
        F.when(F.col("h_k") == 0, 1.0).otherwise(1 - F.col("h_kc") / F.col("h_k")).alias("completeness"),
        F.when(highest == expected, 1.0).otherwise((F.col("index") - expected) / (highest - expected)).alias("adjusted_rand"),
    )
    both = F.col("homogeneity") + F.col("completeness")
    return out.withColumn("v_measure", F.when(both == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / both)).select("homogeneity", "completeness", "v_measure", "adjusted_rand")


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, divided by their population deviation; a constant column becomes 0."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    scaled = {c: F.when(F.col(f"s_{c}") == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).select(*df.columns)  # one row on the right
