"""Connected components of a table of links."""

from pyspark.sql import DataFrame, functions as F

from .columns import discard, written


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, comp): comp is the smallest node of the component.

    Contraction: every root hangs itself below its smallest neighbour if that is smaller, the
    forest is flattened by two pointer jumps, links move to the new roots, and links inside a
    root vanish.  Each round is a few joins and partial aggregations, written to the shared
    folder; nothing is gathered on the driver.
    """
    edges = links.select("a", "b").where("a != b").distinct()
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    edges = written(edges, "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("root"), F.least("a", "low").alias("up"))
        first = written(up, "parents")
        up = first
        for _ in range(2):
            above = up.select(F.col("root").alias("up"), F.col("up").alias("above"))
            up = up.join(above, "up").select("root", F.col("above").alias("up"))
        up = written(up, "parents")
        moved = labels.join(up, labels["comp"] == up["root"], "left").select("node", F.coalesce("up", "comp").alias("comp"))
        ends = edges
        for side in ("a", "b"):
            ends = ends.join(up.select(F.col("root").alias(side), F.col("up").alias(f"{side}_up")), side)
        left = written(ends.where("a_up != b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "edges")
        after = written(moved, "labels")
        discard(first, up, edges, labels)
        edges, labels = left, after
    discard(edges)
    return labels
