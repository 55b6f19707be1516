"""Connected components of an edge table, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalspark.llm.common import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges; nodes are longs.

    Each round takes, for every node, the least label among its neighbours and hooks it and its old label there, then
    halves paths; rounds are few (logarithmic in practice). Labels are written to the shared folder each round, so
    lineage stays short; labels that still change after most_rounds are an error. A node with very many neighbours is pre-aggregated map-side; nothing is gathered in a group."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stored(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = stored(both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")), "cc-labels")
    for _ in range(most_rounds):
        of = labels.select(F.col("node").alias("v"), F.col("component").alias("near"))
        least = both.join(of, "v").groupBy("u").agg(F.min("near").alias("near"))
        seen = labels.join(least.withColumnRenamed("u", "node"), "node").withColumn("low", F.least("component", "near"))
        hooks = seen.select("node", "low").union(seen.select(F.col("component").alias("node"), "low")).groupBy("node").agg(F.min("low").alias("low"))
        hooked = stored(hooks, "cc-hooks")
        up = hooked.select(F.col("node").alias("low"), F.col("low").alias("above"))
        jumped = hooked.join(up, "low", "left").select("node", F.least("low", F.coalesce("above", "low")).alias("component"))
        jumped = stored(jumped, "cc-labels")
        changed = jumped.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
        labels = jumped
        if not changed:
            return labels
    raise RuntimeError(f"labels of components still change after {most_rounds} rounds")
