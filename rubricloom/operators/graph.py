"""Connected components of a link table, by minimum labels with pointer jumping; nothing gathers in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricloom.session import checkpoint


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) for each node that has a link.

    Links have no direction; repeated links, self links and null ends (ignored) are allowed; an empty table gives no
    rows. Each round takes the smallest label among a node's neighbours and then that label's own label, so long chains
    shrink by about half; rounds end when no label changes. Lineage is cut in the shared checkpoint folder.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    edges = checkpoint(ends.union(ends.select("y", "x")).distinct())
    labels = checkpoint(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = edges.join(labels, edges["y"] == labels["node"]).groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        up = labels.select(F.col("node").alias("c"), F.col("component").alias("up"))
        new = checkpoint(step.join(up, "c", "left").select("node", "old", F.least("c", F.coalesce("up", "c")).alias("component")))
        changed = new.where("component <> old").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels
