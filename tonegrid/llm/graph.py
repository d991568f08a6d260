"""Connected components of a graph of long ids, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for each node in a link (columns a, b).

    A round takes the smallest label among a node's neighbours and then that label's own label, so paths shorten
    by halves. Labels are aggregated before they are shuffled; a node with many links is spread by the skew join.
    Empty links give no rows; repeated links and links of a node to itself change nothing.
    """
    links = links.select("a", "b")
    edges = cut(links.union(links.select("b", "a")).distinct(), "edges")
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("l"))
        jump = labels.select(F.col("node").alias("l"), F.col("label").alias("ll"))
        new = cut(new.join(jump, "l").select("node", "old", F.least("l", "ll").alias("label")), "labels")
        if new.where("label != old").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
