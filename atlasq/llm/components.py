"""Connected components of a graph held as a table of links."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Components of undirected links (a, b): a table (node, component), component being the smallest node reached.

    Every round gives each node the smallest label among itself and its neighbours, follows
    the labels once more (so that paths shorten by doubling) and contracts the links to labels.
    Only minima are taken per node, which combine before the shuffle: a node with very many
    links costs no single task. Loops, repeated links and an empty table are allowed.
    """
    both = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    links = materialize(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-links")
    labels = materialize(links.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), f"{label}-0")
    for i in itertools.count(1):
        # labels of labels: a component's label is itself a node
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        hop = labels.join(up, "component", "left").select("node", F.coalesce("higher", "component").alias("component"))
        mine, theirs = hop, hop
        a = links.join(mine.select(F.col("node").alias("a"), F.col("component").alias("la")), "a")
        c = a.join(theirs.select(F.col("node").alias("b"), F.col("component").alias("lb")), "b").select("la", "lb").where("la <> lb")
        # written first, so that the join below has two exchanges and a hot component can be split
        best = materialize(c.groupBy(F.col("la").alias("component")).agg(F.min("lb").alias("other")), f"{label}-best{i}")
        nxt = hop.join(best, "component", "left").select("node", F.when(F.col("other") < F.col("component"), F.col("other")).otherwise(F.col("component")).alias("component"))
        nxt = materialize(nxt, f"{label}-{i}")
        moved = labels.join(nxt.withColumnRenamed("component", "now"), "node").where("component <> now").limit(1).count()
        labels = nxt
        if not moved:
            return labels
