"""Connected components of a table of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.llm.common import attach_group_facts
from probeloom.session import materialize

# Each round at least halves the longest path, so this is no limit in practice.
MAX_ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of the component, for every node of ``links`` (a, b: long).

    Each round gives a node the least label among its neighbours and then the
    label of that label. Nodes with many links are joined apart (see
    ``attach_group_facts``), and labels are reduced before they are shuffled.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.filter("a <> b").distinct(), "edges")
    total = edges.count()
    degrees = materialize(edges.groupBy("a").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    labels = materialize(degrees.select(F.col("a").alias("node"), F.col("a").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        known = degrees.join(labels, degrees["a"] == labels["node"]).select("a", "degree", "label")
        offered = attach_group_facts(edges, known, "a", "degree", total).groupBy("b").agg(F.min("label").alias("offer"))
        better = labels.join(offered, labels["node"] == offered["b"]).select("node", "label", F.least("label", "offer").alias("next"))
        better = materialize(better, "offers")
        if not better.filter("next <> label").limit(1).count():
            return labels
        # The label of the next label: nodes that share a label are reduced to one row for the lookup.
        sizes = better.groupBy(F.col("next").alias("to")).agg(F.count(F.lit(1)).alias("n"))
        jump = sizes.join(better.select("node", F.col("next").alias("jump")), F.col("to") == F.col("node")).select(
            F.col("to").alias("next"), "n", "jump"
        )
        labels = materialize(
            attach_group_facts(better.select("node", "next"), jump, "next", "n", total).select("node", F.col("jump").alias("label")), "labels"
        )
    raise RuntimeError(f"Components have not settled after {MAX_ROUNDS} rounds")
