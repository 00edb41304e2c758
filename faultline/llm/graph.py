"""Connected components of an edge table by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (src, dst: long); nodes of one component share a root.

    Each round every node picks, among itself and its neighbours, the one of least
    hashed priority and is contracted into it. A constant share of the nodes goes in
    each round, so the rounds grow with the logarithm of the nodes. Nothing is collected;
    edges and maps of each round are written tables. Self loops and nulls are ignored.
    """
    edges = written(edges.select("src", "dst").where("src <> dst").distinct(), few=True)
    first, maps = edges, []
    for turn in range(200):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rank = lambda c: F.xxhash64(F.lit(turn), F.col(c))
        near = both.groupBy("src").agg(F.min(rank("dst")).alias("p"), F.min_by("dst", rank("dst")).alias("near"))
        m = written(near.select(F.col("src").alias("node"), F.when(F.col("p") < rank("src"), F.col("near")).otherwise(F.col("src")).alias("to")), few=True)
        maps.append(m)
        a, b = m.select(F.col("node").alias("src"), F.col("to").alias("a")), m.select(F.col("node").alias("dst"), F.col("to").alias("b"))
        small = edges.join(a, "src").join(b, "dst").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        done, edges = edges, written(small.where("src <> dst").distinct(), few=True)
        if done is not first:
            drop_written(done)
    else:
        raise RuntimeError("components were not settled")
    if not maps:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    out = maps[0].select("node", F.col("to").alias("root"))
    for m in maps[1:]:
        out = out.join(m.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
