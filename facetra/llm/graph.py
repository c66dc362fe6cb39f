"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every id in ``links`` (``a``, ``b``).

    Each round takes the smallest label among the neighbours and then follows labels once,
    so the reach about doubles. Every round is written to the shared folder. Self links and
    repeated links do no harm; no links give no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id"), "labels")
    for _ in range(most_rounds):
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("further"))
        after = written(
            lower.join(jump, "to", "left").select("id", "before", F.least("to", F.coalesce("further", "to")).alias("component")), "labels"
        )
        labels = after.select("id", "component")
        if after.filter("component <> before").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components still changed after {most_rounds} rounds")
