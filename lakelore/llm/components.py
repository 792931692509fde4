"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch, join_one, settle


def components(links: DataFrame) -> DataFrame:
    """node, root (least node reachable) for every node of ``links`` (columns a, b).

    Each round gives a node the least label of itself and its neighbours, then the label of that label. Labels at least
    halve their distance, so rounds grow with the logarithm of the longest path. Labels are written after each round, and those
    of the round before dropped; the driver sees counts. Grouping sums up before it shuffles; a join has one row per node
    on one side, and rows of a node with very many links, or of a label that very many have, stay in the tasks they are in.
    """
    start = Scratch(links.sparkSession)
    both = start.settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    held = Scratch(links.sparkSession)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
    labels = held.settle(labels.select("node", "n", F.least("node", "m").alias("root")))
    while True:
        new = Scratch(links.sparkSession)
        near = join_one(both, labels.select(F.col("node").alias("b"), "root", "n"), ["b"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = new.settle(labels.join(near, "node").select("node", "n", "root", F.least("root", "near").alias("next")))
        asked = step.groupBy("next").agg(F.count("*").alias("asked"))
        jump = new.settle(asked.join(labels.select(F.col("node").alias("next"), F.col("root").alias("far")), "next"))
        moved = new.settle(join_one(step, jump, ["next"], "asked").select("node", "n", "root", F.least("next", "far").alias("next")))
        held.drop()
        held = new
        if not moved.where("next <> root").limit(1).count():
            out = settle(moved.select("node", F.col("next").alias("root")))
            held.drop()
            start.drop()
            return out
        labels = moved.select("node", "n", F.col("next").alias("root"))
