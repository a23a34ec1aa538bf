"""Connected components of a large graph, with DataFrame operations only.

Every node starts with its own id as its label. A round gives each node the
smallest label among itself and its neighbours, and then that label's own
label, which halves long chains. Rounds end when no label changes. Tables are
written between the operations, so every join reads plain scans and a node with
very many neighbours is split by the adaptive skew join; minima are combined on
the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm import common


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (the smallest node of its component) for all nodes of ``edges``.

    Nodes are integers or strings. Loops and repeated edges are allowed; an edge
    with a null end is left out; no edges give no rows.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = common.materialize(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = common.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels.hint("merge"), both.b == labels.node).select(F.col("a").alias("node"), "label")
        lowest = common.materialize(heard.union(labels).groupBy("node").agg(F.min("label").alias("label")), "labels")
        far = lowest.select(F.col("node").alias("label"), F.col("label").alias("farther"))
        jumped = common.materialize(
            lowest.join(far.hint("merge"), "label", "left").select("node", F.least("label", F.coalesce("farther", "label")).alias("label")), "labels"
        )
        before = labels.select("node", F.col("label").alias("old"))
        changed = jumped.join(before.hint("merge"), "node").where(F.col("label") != F.col("old"))
        if changed.isEmpty():
            return jumped
        labels = jumped
