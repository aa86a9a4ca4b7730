"""Connected components of a graph of links, on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.store import cut


def components(links: DataFrame, a: str = "a", b: str = "b", keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """node, label: the smallest node of each linked node's component.

    Every round a node takes the smallest label among its neighbours and then its label's label, so labels travel
    twice as far each time. `keep` writes each round's labels to the shared folder. A node's neighbours are reduced by a partial
    minimum before the shuffle, and the joins' large keys are split by adaptive execution.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = keep(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = keep(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        least = labels.join(near, "node").select("node", F.least("label", "theirs").alias("new"), "label")
        above = labels.select(F.col("node").alias("new"), F.col("label").alias("higher"))
        fresh = keep(least.join(above, "new", "left").select("node", F.least("new", F.coalesce("higher", "new")).alias("label"), (F.least("new", F.coalesce("higher", "new")) != F.col("label")).alias("moved")))
        moved = fresh.where("moved").limit(1).count()
        labels = fresh.select("node", "label")
        if not moved:
            return labels
