"""Connected components of a graph of links, by hooking to the least neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vakanz.llm.common import staged


def roots(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; the root is the least node of its component.

    Each round hooks every contracted node to its least neighbour, flattens the trees and contracts
    the links, so rounds grow with the logarithm of the longest path. All of it stays in Spark.
    """
    edges = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    label = staged(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        # b > a on every link, so each b hooks downwards and no cycle can arise.
        tree = staged(edges.groupBy("b").agg(F.min("a").alias("up")).withColumnRenamed("b", "at"))
        while True:
            above = tree.select(F.col("at").alias("up"), F.col("up").alias("next"))
            jumped = staged(tree.join(above, "up", "left").select("at", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
            tree = jumped.select("at", "up")
            if jumped.filter("moved").isEmpty():
                break
        label = staged(
            label.join(tree, label["root"] == tree["at"], "left").select("node", F.coalesce("up", "root").alias("root"))
        )
        left = tree.select(F.col("at").alias("a"), F.col("up").alias("up_a"))
        right = tree.select(F.col("at").alias("b"), F.col("up").alias("up_b"))
        moved = edges.join(left, "a", "left").join(right, "b", "left")
        moved = moved.select(F.coalesce("up_a", "a").alias("x"), F.coalesce("up_b", "b").alias("y")).filter("x <> y")
        edges = staged(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return label
