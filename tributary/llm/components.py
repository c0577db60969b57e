"""Connected components by label passing with pointer jumps, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace


def components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the least node that each node of edges (u, v) is linked with, however far.

    Every round takes the least label among the neighbours and then that label's own label, so the rounds
    grow with the logarithm of the longest path. Rounds read and write tables; a node with many edges is
    reduced before each exchange or split by the join.
    """
    both = edges.select("u", "v").where("u <> v")
    both = work.save(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}_edges")
    labels = work.save(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("label")), f"{name}_0")
    i = 0
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        i += 1
        met = work.save(labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label")), f"{name}_{i}")
        i += 1
        jumped = met.join(met.select(F.col("u").alias("label"), F.col("label").alias("next")), "label").select("u", "old", F.col("next").alias("label"))
        after = work.save(jumped, f"{name}_{i}")
        changed = after.where("old <> label").limit(1).count()
        labels = after.select("u", "label")
        work.drop(*(f"{name}_{j}" for j in range(max(0, i - 2), i)))
        if not changed:
            return labels.select(F.col("u").alias("node"), "label")
