"""Connected components of a link table, by joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import stored


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """node, component (its smallest reachable node) for every node of links (a, b: long).

    Every round takes the smallest label among a node and its neighbours and then the label of that label, until nothing
    changes; labels move along whole paths of labels, so chains take few rounds. Minima are combined before the shuffle.
    The tables of a round are written in at most `files` files.
    """
    edges = stored(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
        files,
    )
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = stored(labels.select("node", F.least("node", "near").alias("component")), "labels", files)
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        met = labels.join(near, "node").withColumn("next", F.least("component", "near"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("jumped"))
        new = stored(
            met.join(jump, "next").select("node", F.col("component").alias("old"), F.least("next", "jumped").alias("component")),
            "labels",
            files,
        )
        labels = new.select("node", "component")
        if not new.where("old != component").limit(1).count():
            return labels
