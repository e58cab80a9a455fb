"""Connected components of a link table, by rounds of joins; nothing is collected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from denspark.storage import checkpointed


#: Links up to this many (4 MB) are settled by one task; more take rounds of joins.
ONE_TASK = 1 << 18


def _in_one_task(batches):
    """The same labels by minimum propagation and pointer jumping, over a bounded number of links."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    u, v = (np.concatenate([b.column(c).to_numpy() for b in tables]) for c in ("u", "v"))
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (deeper := new[new]).tobytes() != new.tobytes():
            new = deeper
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], ["vertex", "label"])


def least_reachable(links: DataFrame) -> DataFrame:
    """(vertex, label) with the least vertex that can be reached, for every vertex of a link (a, b).

    Alternates two steps: each vertex hands the least of its neighbours to those above it,
    then to those below it and itself.  Paths halve each round, and a hub's work is a
    partial aggregate.  Ends when nothing changes.  Null ends and loops are ignored.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = checkpointed(edges)
    if edges.count() <= ONE_TASK:
        return checkpointed(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_in_one_task, "vertex long, label long"))
    before = None
    while True:
        either = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = either.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = either.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("vertex"), F.col("v").alias("label")).distinct())


def spanning_forest(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect each component without a cycle.

    Rounds of joining: each tree takes its least link to another tree, by (least end,
    greatest end), so that no cycle can close; trees that are joined become one.
    """
    edges = checkpointed(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    tree = checkpointed(edges.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().withColumn("label", F.col("vertex")))
    chosen = edges.limit(0)
    while True:
        ends = edges.join(tree.select(F.col("vertex").alias("a"), F.col("label").alias("x")), "a").join(tree.select(F.col("vertex").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
        each = ends.select(F.explode(F.array("x", "y")).alias("tree"), F.struct("a", "b", "x", "y").alias("link"))
        best = checkpointed(each.groupBy("tree").agg(F.min("link").alias("link")).select("link.*").distinct())
        if best.isEmpty():
            return chosen
        chosen = checkpointed(chosen.union(best.select("a", "b")).distinct())
        joined = least_reachable(best.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("vertex").alias("label"), F.col("label").alias("root"))
        tree = checkpointed(tree.join(joined, "label", "left").select("vertex", F.coalesce("root", "label").alias("label")))
