"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Contraction at least halves the nodes in each round; this many rounds suffice for 2**MAX_ROUNDS nodes.
MAX_ROUNDS = 64


def _jump(parents: DataFrame) -> DataFrame:
    """Every node's grandparent.  Each node has a row, and a root is its own parent."""
    up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    return parents.join(up, "parent").select("node", F.col("above").alias("parent"))


def connected_components(links: DataFrame) -> DataFrame:
    """``a, b`` (long) -> ``node, label`` for every node with a link to another one; the label is a node of the component.

    Each round hangs every node below its smallest neighbour (or itself), follows those parents twice and
    replaces the links by links between the roots.  Tables between rounds are written."""
    spark = links.sparkSession
    edges = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                    "components-edges")
    found = spark.createDataFrame([], "node long, label long")
    for step in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("parent")),
                          "components-parents")
        parents = written(_jump(parents), "components-jump")
        top = parents.withColumnRenamed("parent", "label")
        if step == 0:
            found = top
        else:
            up = parents.select(F.col("node").alias("label"), F.col("parent").alias("above"))
            found = written(found.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label")),
                            "components-labels")
        side = lambda c: parents.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}"))
        edges = written(edges.join(side("a"), "a").join(side("b"), "b").filter("pa <> pb")
                        .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
                        "components-edges")
    return found
