"""Connected components of an edge table, by label propagation with pointer
jumping. Labels stay in stored tables; the driver sees one count a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of the edges ``(a, b)``; the
    component is its smallest id. An empty edge table gives no rows."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id"))
                    .agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["id"])
                .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near")))
        lower = labels.join(near, "id").select("id", F.least("component", "near").alias("low"),
                                               F.col("component").alias("old"))
        roots = labels.select(F.col("id").alias("root"), F.col("component").alias("jump"))
        moved = stored(lower.join(roots, F.col("low") == F.col("root"))
                       .select("id", F.least("low", "jump").alias("component"), "old"), "labels")
        changed = moved.where("component <> old").limit(1).count()
        labels = moved.select("id", "component")
        if not changed:
            return labels
