"""Connected components of a large edge table, by alternating stars.

Each round, every node points its larger neighbours at its smallest neighbour
(large star), then every node points itself and its smaller neighbours at the
smallest of them (small star). Components become stars around their smallest
node in a number of rounds logarithmic in their diameter. Rounds are joins and
aggregations on the node; a node with very many edges is pre-aggregated, and
its join can be split. Each round is written to the shared folder, so lineage
stays short. Nothing is collected but a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import discard, landed

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs, any order, repeats and loops allowed ->
    ``(node, root)`` for every node with an edge to another; root: the smallest
    node of the component."""
    now = landed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where("u <> v").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        done, now = now, landed(small, "edges")
        discard(done)
    raise RuntimeError(f"components are not done after {MAX_ROUNDS} rounds")
