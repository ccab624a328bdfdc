"""Connected components of an edge table, by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.plans.runtime import cut_shuffled as cut


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, label)`` for each node of ``edges``; label = the smallest node reachable.

    Each round takes, per node, the smallest label among its neighbours (a grouped
    minimum, combined before the shuffle, so a hub costs one row per task) and then
    follows labels of labels once, which halves the depth of every chain. Labels are
    written to the shared folder each round; only the number of changed labels comes
    to the driver. Empty edges give an empty table; self loops and repeats are harmless.
    """
    a, b = F.col(src), F.col(dst)
    one = edges.select(a.alias("u"), b.alias("v")).where("u is not null and v is not null")
    both = cut(one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), "cc-labels")
    while True:
        seen = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(seen, labels.node == seen.u).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("p"), F.col("label").alias("pl"))
        step = hooked.join(up, hooked.label == up.p).select("node", "old", F.least("label", "pl").alias("label"))
        step = cut(step, "cc-labels")
        changed = step.where("label <> old").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels
