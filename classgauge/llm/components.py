"""Connected components of a link table, by hash-to-min rounds in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classgauge.session import written


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of the links (a, b); component is its smallest node.

    Each round hooks nodes onto the smallest root among their neighbours, then replaces
    every root by its own root, so a round at least halves long chains. All steps are
    group-bys with map-side combine and equi-joins; each round is written to the shared
    folder, so a lost executor repeats one round at most. Empty links give no rows.
    """
    edges = written(
        links.select("a", "b").union(links.select("b", "a")).where(F.col("a") != F.col("b")).distinct(), "edges"
    )
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        roots = labels.select(F.col("node").alias("b"), F.col("root").alias("other"))
        offers = edges.join(roots, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("offer"))
        hooked = labels.join(offers, "node").select("node", "root", F.least("root", "offer").alias("to"))
        # what a node learns is told to its root, which all other members of the tree then follow
        told = (
            hooked.groupBy("root").agg(F.min("to").alias("to"))
            .unionByName(hooked.select(F.col("node").alias("root"), "to"))
            .groupBy(F.col("root").alias("at")).agg(F.min("to").alias("to"))
        )
        told = written(told, "told")
        jumped = told.join(told.select(F.col("at").alias("to"), F.col("to").alias("next")), "to", "left")
        jumped = jumped.select("at", F.coalesce(F.least("to", "next"), "to").alias("to"))
        new = written(
            hooked.select("node", F.col("root").alias("was"), "to").withColumnRenamed("to", "at")
            .join(jumped, "at", "left")
            .select("node", "was", F.coalesce(F.least("to", "at"), "at").alias("root")),
            "labels",
        )
        changed = new.where(F.col("root") != F.col("was")).limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels.select("node", F.col("root").alias("component"))
