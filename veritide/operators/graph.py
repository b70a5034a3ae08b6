"""Connected components by contraction, with written rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, which ends its lineage. The files go when the application ends."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="veritide-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for every row of ``nodes``(node): the smallest node reachable over ``edges``(a, b).

    In each round every node moves to its smallest neighbour's smallest neighbour; edges between
    moved ends go on. Rounds grow with the logarithm of the longest path; nodes keep any orderable type.
    """
    links = written(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    at = None
    while not links.isEmpty():
        near = links.select(F.col("b").alias("n"), F.col("a").alias("to")).union(links.select("a", "a")).groupBy("n").agg(F.min("to").alias("to"))
        near = written(near, "near")
        hop = near.select(F.col("n").alias("to"), F.col("to").alias("far"))
        near = written(near.join(hop, "to").select("n", F.col("far").alias("to")), "hop")
        if at is None:
            at = near.select(F.col("n").alias("node"), F.col("to").alias("component"))
        else:
            at = at.join(near.withColumnRenamed("n", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        at = written(at, "components")
        left, right = near.select(F.col("n").alias("a"), F.col("to").alias("x")), near.select(F.col("n").alias("b"), F.col("to").alias("y"))
        moved = links.join(left, "a").join(right, "b").where("x <> y")
        links = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if at is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(at, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def group_edges(rows: DataFrame, node: str, key: str) -> DataFrame:
    """Star edges from each node to the smallest node with the same non-null key."""
    heads = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(node).alias("a"))
    return rows.join(heads, key).select("a", F.col(node).alias("b")).where("a <> b")
