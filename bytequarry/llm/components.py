"""Connected components of an edge table, by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.session import drop_scratch, materialize


def components(edges: DataFrame) -> DataFrame:
    """key, root: the smallest key reachable from each key that has an edge.

    ``edges`` has columns a and b of one ordered type. A round takes each key's
    smallest label among its neighbours' (a sum that partial aggregation bears,
    however many neighbours), then the label of that label; rounds end when none
    changes. Every round's labels are written to the shared folder.
    """
    both = edges.select("a", "b").where("a <> b").distinct()
    both = materialize(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.col("key")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["key"]).groupBy("a").agg(F.min("root").alias("best"))
        step = labels.join(near, labels["key"] == near["a"]).select("key", F.col("root").alias("was"), F.least("root", "best").alias("up"))
        jump = labels.select(F.col("key").alias("up"), F.col("root").alias("over"))
        step = materialize(step.join(jump, "up").select("key", "was", F.least("up", "over").alias("root")), "labels")
        changed = step.where("was <> root").limit(1).count()
        drop_scratch(labels)
        labels = step.select("key", "root")
        if not changed:
            drop_scratch(both)
            return labels
