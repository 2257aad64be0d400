"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(src, dst)``; root is the smallest node reachable.

    Every round links the larger neighbours of a node to its smallest one and
    then does the same for the smaller neighbours, until all edges point at a
    root. Minima are summed up before the shuffle and the joins are plain
    two-sided ones, which Spark splits at hot nodes. Loops, repeated edges and
    null ends are ignored; no edges give no rows.
    """
    edges = saved(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
                  .distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("src", "dst").cast("long")), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(
                edges.select("dst", "dst").distinct())
        before = state
        # Tables of their own, so that both sides of a join come straight from an exchange and hot nodes can be split.
        both = edges.union(edges.select("dst", "src"))
        least = saved(both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")), "least")
        large = saved(both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
                      .distinct(), "large")
        least = saved(large.groupBy("src").agg(F.min("dst").alias("m")), "least")
        small = large.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        edges = saved(small.union(least.withColumnRenamed("m", "dst")).distinct(), "edges")
