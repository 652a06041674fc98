"""Connected components of an edge table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each end of the edges (a, b) reaches.

    Each round takes the smallest label among a node's neighbours, then the label of that
    label, so long chains halve. Labels only fall, so an unchanged sum ends the rounds.
    Nothing but that sum reaches the driver.
    """
    ways = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    total = lambda t: t.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    before, now = None, total(labels)
    while now != before:
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("__to"))
        jumped = labels.join(of, "label").select("node", F.col("__to").alias("label"))
        near = ways.join(jumped.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("__near"))
        labels = cut(jumped.join(near, "node").select("node", F.least("label", "__near").alias("label")))
        before, now = now, total(labels)
    return labels.withColumnRenamed("label", "component")
