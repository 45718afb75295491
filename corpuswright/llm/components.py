"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Labels that every task may hold: 1 MB of node and label.
SMALL = 1 << 16


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (smallest node of the component) for the long columns ``a``, ``b`` of ``edges``.

    Each round takes the smallest label of the neighbours, then the label of the
    label, so the rounds grow with the logarithm of the diameter. Minima are
    combined map-side and labels are written tables, so the joins of a node with
    very many edges can be split. Up to ``SMALL`` labels are broadcast, so a round
    has one shuffle instead of five; the nodes stay the same from round to round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = materialize(both, "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    small = labels.count() <= SMALL
    cores = edges.sparkSession.sparkContext.defaultParallelism

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    while True:
        near = both.join(side(labels), both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        near = near.coalesce(cores) if small else near
        lower = near.join(side(labels), labels["node"] == near["a"])
        lower = materialize(lower.select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), "lower")
        jump = lower.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        labels = materialize(
            lower.join(side(jump), lower["label"] == jump["_n"]).select("node", F.least("label", "_l").alias("label"), "old"), "labels"
        )
        if not labels.where("label <> old").limit(1).count():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
