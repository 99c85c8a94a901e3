"""Connected components of an edge table, without collecting edges or labels.

A vertex with a good share of all edges (the hub of a large group) is hot: its edges stay where they are in the joins.

Alternating large-star and small-star rounds (Kiveris et al., 2014): each round points vertices at the least vertex they
know of, until every component is a star around its least vertex. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import forget, hot_join, hot_keys, written

ROUNDS = 60  #: more than any graph needs in practice: rounds grow as the logarithm of the longest path


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root), one row a vertex that has an edge; root is the least vertex reachable.

    Self-loops and repeated edges do not matter; no edges give no rows.
    """
    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(both.distinct(), "cc")
    mark = None
    for _ in range(0 if now.isEmpty() else ROUNDS):
        # Large star: larger neighbours of u go to the least vertex among u and its neighbours.
        ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degrees = ends.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        degrees = written(degrees, "cc-least")
        large = hot_join(ends.filter("b > a"), degrees.select("a", "m"), "a", hot_keys(degrees, "a"))
        large = written(large.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "cc-large")
        forget(degrees)
        # Small star: u and its smaller neighbours go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = written(small.filter("a <> b").distinct(), "cc-small")
        forget(now)
        forget(large)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    if mark and seen != mark:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
