"""Connected components of a link table, by repeated contraction towards the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.llm.common import saved


#: Parts that the rows of one label are dealt to where labels are joined: a giant component has one label.
SALTS = 16


def follow(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """``labels`` (label and other columns) with each label replaced by what ``moved`` (node, label) says of it, if anything."""
    step = moved.select(F.col("node").alias("label"), F.col("label").alias("to"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    others = [c for c in labels.columns if c != "label"]
    salted = labels.withColumn("salt", F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int"))
    return salted.join(step, ["label", "salt"], "left").select(*others, F.coalesce("to", "label").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b): label is the smallest node reachable.

    Each round maps every node to its smallest neighbour or itself, and keeps the links between
    different images. A round is written before the next one reads it; nothing comes to the driver
    but whether links are left. An empty link table gives an empty result.
    """
    links = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    labels = None
    while True:
        if links.isEmpty():
            break
        ends = links.select(F.col("b").alias("node"), F.col("a").alias("to")).union(links.select(F.col("a").alias("node"), F.col("a").alias("to")))
        step = saved(ends.groupBy("node").agg(F.min("to").alias("to")), "step")
        step2 = step.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        step = saved(step.join(step2, "to", "left").select("node", F.coalesce("to2", "to").alias("to")), "jump")
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            labels = follow(labels, step.select("node", F.col("to").alias("label")))
            # every node of a contracted link is an earlier label, so no node is missed
        labels = saved(labels, "labels")
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("a2")), step.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        links = links.join(a, "a").join(b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a < b").distinct()
        links = saved(links, "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
