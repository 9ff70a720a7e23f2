"""Connected components of a table of links, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import dropped, looked_up, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component: the least id that each end of a link is connected to.

    Every round, a node's label becomes the least of its neighbours' labels, and then that label's own label.
    Labels halve their distance to the least at least, so long chains take a logarithmic number of rounds.
    Each round is written and the one before it deleted; nothing but a count comes to the driver. Nodes with many neighbours and labels
    of many nodes are looked up by broadcasts of a bounded number of keys, so they make no large task.
    """
    ways = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    both = written(links.select(F.inline(ways)).where("u <> v").distinct())
    n_links = both.count()
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    n = labels.count()
    while True:
        near = looked_up(both, "v", labels.select(F.col("u").alias("v"), F.col("label").alias("near")), n_links)
        seen = near.groupBy("u").agg(F.min("near").alias("near"))
        best = written(labels.join(seen, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        up = best.join(best.select(F.col("label").alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias("label"), F.col("label").alias("up"))
        jumped = written(looked_up(best, "label", up, n).select("u", "old", F.col("up").alias("label")))
        over = jumped.where("label <> old").isEmpty()
        dropped(labels, best)
        if over:
            dropped(both)
            return jumped.select(F.col("u").alias("id"), F.col("label").alias("component"))
        labels = jumped.select("u", "label")
        labels._written_at = jumped._written_at
