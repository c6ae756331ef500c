"""Connected components of links by repeated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from benchloom.storage import Scratch


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of `links` (a, b); equal labels are connected, a label is a node.

    Each round hooks the label of each end's neighbours below its own and then jumps to the label's label, so
    chains shrink fast. Minima are taken in each task before the shuffle, which bounds what a node
    with very many links sends. Ends after the round in which nothing changes.
    """
    spark = links.sparkSession
    with Scratch(spark, "components") as fixed:
        both = fixed.cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a != b").distinct(), "links")
        before = Scratch(spark, "labels")
        labels = before.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
        while True:
            # Each round reads the labels of the round before, which are then removed.
            with before:
                after = Scratch(spark, "labels")
                near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
                # A label tells its own best neighbour to all that carry it.
                hooked = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("best"))
                hooked = before.cut(hooked, "hooked")
                roots = hooked.groupBy(F.col("label").alias("root")).agg(F.min("best").alias("to"))
                moved = hooked.join(roots, F.col("label") == F.col("root")).select("node", F.col("label").alias("was"), F.least("best", "to").alias("label"))
                moved = before.cut(moved, "moved")
                top = moved.select(F.col("node").alias("root"), F.col("label").alias("top"))
                jumped = after.cut(moved.join(top, F.col("label") == F.col("root"), "left").select("node", "was", F.coalesce(F.least("top", "label"), "label").alias("label")), "labels")
                labels = jumped.select("node", "label")
            before = after
            if jumped.where("was != label").isEmpty():
                return labels
