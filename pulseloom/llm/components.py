"""Connected components by passing on least labels, with jumps to the label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import keep


def connected(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of the undirected links (a, b).

    Each round every node takes the least label among its own, its neighbours' and its label's; a path of n links is
    done in about log n rounds. A round is written to the shared folder, so lineage stays short.
    """
    both = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = labels.join(around, "node").join(jump, "label")
        new = keep(new.select("node", F.least("label", "near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved")))
        moved = new.filter("moved").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels
