"""Connected components of a graph given as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.sources.tables import checkpoint


def connected_components(nodes: DataFrame, edges: DataFrame, known_nodes: bool = False) -> DataFrame:
    """(node, component): the least node that paths of df(src, dst) reach from each of df(node).

    Large-star and small-star rounds: every node sends its neighbours to the least node it
    knows, so rounds grow with the logarithm of the longest path. Edges to unknown nodes
    and loops are ignored (known_nodes says that there are none of the former); a node
    without edges is its own component. Each round is
    written to the checkpoint folder; two rounds are the same if the counts and the sums of
    hashes of their edges are, and nothing is collected but these.
    """
    known = nodes.select("node").distinct()
    pairs = edges.filter("src is not null and dst is not null and src != dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    if not known_nodes:
        pairs = pairs.join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi")
    pairs = checkpoint(pairs)
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    known_by = print_of(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a != b").distinct()
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select("b", "m", "a")
        turned = small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
        after = checkpoint(turned.filter("a != b").distinct())
        before, known_by, pairs = known_by, print_of(after), after
        if before == known_by:
            break
    return known.join(pairs.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
