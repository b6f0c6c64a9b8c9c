"""Connected components of links, in rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from docuplane.session import Scratch


def components(links: DataFrame) -> DataFrame:
    """links: a, b (any comparable type). Returns node, component: the smallest node each node is connected with.

    Every round takes the smallest label around each node and then the label of that label, so the rounds are about the logarithm
    of the longest path. No component is ever gathered in one task. Loops and repeated links do no harm; nulls are left out.
    """
    scratch = Scratch(links.sparkSession, "components")
    links = links.where("a is not null and b is not null").select("a", "b")
    edges = scratch.cut(links.union(links.select("b", "a")).where("a <> b").distinct())
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    at = scratch.write(labels)
    while True:
        labels = scratch.read(at)
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
        seen = Observation()
        moved = step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("to", "label")).alias("label"), "was")
        to = scratch.write(moved.observe(seen, F.count_if(F.col("label") != F.col("was")).alias("moved")).select("node", "label"))
        changed = seen.get["moved"]
        scratch.drop(at)
        at = to
        if not changed:
            return scratch.read(at).select("node", F.col("label").alias("component"))
