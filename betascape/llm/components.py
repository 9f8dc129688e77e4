"""Connected components by alternating large-star and small-star rounds.

Each round is two joins on the node key; both sides and the result go to the shared checkpoint folder, so
that a join can split the edges of a hub.  Rounds end when the edges no longer change: then each edge leads
from a node to the least of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from betascape.llm.common import cut


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, root) for every node that has an edge and isn't a root itself.

    Nodes are numbers or structs.  Loops and repeated edges do no harm; edges with a null end are ignored.
    """
    now = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    before = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u") % 1000003).alias("s")).first()
        if seen == before or not seen["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # Large star: each larger neighbour goes to the least of the neighbourhood.
        large = cut(now.select(F.col("v").alias("u"), F.col("u").alias("x")).join(least, "u").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: each smaller neighbour goes to the least one.
        first = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(first, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(small.where("u != v").distinct())
