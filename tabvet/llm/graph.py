"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node it reaches.

    Each round a node takes the smallest label among its neighbours and itself, then the
    label of that label (pointer jumping), so paths shorten geometrically. Labels are
    written to the shared folder each round. A hub's edges are pre-aggregated by the
    ``min`` before they are shuffled. Rows with a null end are ignored.
    """
    both = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("near")).union(
        edges.select(F.col(b).alias("node"), F.col(a).alias("near"))).dropna().distinct(), "edges")
    labels = cut(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        of = labels.select(F.col("node").alias("near"), F.col("root").alias("r"))
        low = both.join(of, "near").groupBy("node").agg(F.min("r").alias("m"))
        step = (labels.join(low, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("r1")))
        step = cut(step, "step")
        jump = step.select(F.col("node").alias("r1"), F.col("r1").alias("r2"))
        new = cut(step.join(jump, "r1", "left").select("node", F.least("r1", F.coalesce("r2", "r1")).alias("root"), "old"), "labels")
        changed = new.where("root <> old").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels
