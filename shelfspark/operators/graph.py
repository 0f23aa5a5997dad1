"""Connected components, cut off from their lineage in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir, set for checkpoints; one of its own only for a session within this process."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="shelfspark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def once(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's shared folder, its lineage cut off."""
    checkpoint_folder(df.sparkSession)
    df = df.persist(StorageLevel.DISK_ONLY)  # for the second of the two jobs of a checkpoint
    try:
        return df.checkpoint()
    finally:
        df.unpersist()


def components(edges: DataFrame, turns: int = 2) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b), in a component with the least node root.

    Large-star and small-star turns, ``turns`` between two checkpoints, until
    the edges are stars. An edge from a node to itself makes it a
    component of its own; nulls are left out.
    """
    fine = once(edges.filter("a is not null and b is not null").select("a", "b"))
    w = Window.partitionBy("u")

    def turn(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(w))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(w))
        return small.select("u", F.col("m").alias("v")).union(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()

    e = fine.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    while True:
        for _ in range(turns):
            e = turn(e)
        e = once(e)
        # done once each node hangs on one root and no root hangs on another: the edges are stars, whose turns change nothing
        ends = e.select("u", F.lit(1).alias("hangs"), F.lit(0).alias("root")).union(e.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("u").agg(F.sum("hangs").alias("hangs"), F.max("root").alias("root")).filter("hangs + root > 1").take(1):
            break
    nodes = fine.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(e.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("root"))
