"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.batches import written


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable over the links; only nodes that have links.

    Each round joins every node's neighbours to the smallest of them, first the
    larger ones and then the smaller ones, so that trees become stars in a number
    of rounds that grows with the logarithm of the longest path.  Null ends and
    links of a node to itself are left out; repeated links change nothing.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    edges = written(edges, "links")
    before = None
    for _ in range(rounds):
        both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("near")).unionByName(edges.select(F.col("lo").alias("node"), F.col("hi").alias("near")))
        least = both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.join(least, "node").where("near > node").select(F.col("near").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x"))
        edges = written(small.select("x.hi", "x.lo").where("hi > lo").distinct(), "links")
        # unchanged when as many links have the same sum of hashes
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).head())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def smallest_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the one that comes first."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
