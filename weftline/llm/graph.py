"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a long, b long); component is the smallest node reachable.

    Each round takes the smallest label among neighbours, then the label of the label, so that long
    chains halve as they go. A round is written to the shared folder; only a count of changes reaches
    the driver. Self-loops and repeated edges do no harm; without edges the result is empty.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("step"))
        above = labels.select(F.col("node").alias("step"), F.col("component").alias("above"))
        found = materialise(stepped.join(above, "step").select("node", "old", F.least("step", "above").alias("component")))
        if found.filter("old != component").isEmpty():
            return found.select("node", "component")
        labels = found.select("node", "component")
