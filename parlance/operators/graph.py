"""What links connect, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.sources.tables import cut


def connected(links: DataFrame, group: list[str]) -> DataFrame:
    """(group, node, part): the smallest node that links (group, a, b) reach from each of their ends, inside each group.

    Each round takes the smallest label among a node's neighbours and the label of that
    label, so long chains halve; rounds end when no label changes. Rows of a null group link nothing.
    """
    ways = cut(links.select(*group, "a", "b").union(links.select(*group, "b", "a")).distinct())
    labels = cut(ways.groupBy(*group, F.col("a").alias("node")).agg(F.min("b").alias("__b")).select(*group, "node", F.least("node", "__b").alias("part")))
    changed = 1
    while changed:
        jumped = labels.join(labels.select(*group, F.col("node").alias("part"), F.col("part").alias("__to")), [*group, "part"])
        near = ways.join(labels.select(*group, F.col("node").alias("b"), "part"), [*group, "b"]).groupBy(*group, F.col("a").alias("node")).agg(F.min("part").alias("__near"))
        rows = cut(jumped.join(near, [*group, "node"]).select(*group, "node", F.least("part", "__to", "__near").alias("__new"), "part"))
        changed = rows.where("__new < part").count()
        labels = rows.select(*group, "node", F.col("__new").alias("part"))
    return labels
