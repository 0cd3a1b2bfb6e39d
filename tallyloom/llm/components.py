"""Connected components of a link table by alternating star contraction.

Each round relinks every node to the smallest of its neighbours (large star, then small star) with
two partial aggregations and two joins on the node. The number of rounds grows with the logarithm
of a component's diameter. Each round's links are written to the shared folder, so lineage stays
short and a lost executor costs one round at most. The hub of a large component is a hot key of an
inner sort-merge join, which Spark's adaptive skew join splits. Nothing but row counts reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest of the node and its neighbours."""
    both = links.select(F.col("x").alias("u"), F.col("y").alias("v")).union(links.select(F.col("y").alias("u"), F.col("x").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    up = both.where(F.col("v") > F.col("u")).join(low, "u")
    return up.select(F.col("m").alias("x"), F.col("v").alias("y")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its neighbours below it are linked to the smallest of them."""
    down = links.select(F.col("y").alias("u"), F.col("x").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("m").alias("x"), F.col("v").alias("y"))
    return rest.union(low.select(F.col("m").alias("x"), F.col("u").alias("y"))).distinct()


def component_labels(links: DataFrame, x: str, y: str, most_rounds: int = 60) -> DataFrame:
    """(node, label) for each node in a link; the label is the smallest node of its component."""
    a, b = F.col(x), F.col(y)
    now = durable(links.where(a != b).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct(), "stars")
    tally = F.struct(F.count(F.lit(1)), F.sum(F.col("x").cast("decimal(38,0)")), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")))
    before = None
    for _ in range(most_rounds):
        if now.isEmpty():
            break
        now = durable(_small_star(_large_star(now)), "stars")
        seen = now.agg(tally.alias("t")).first()["t"]
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components not stable after {most_rounds} rounds")
    return now.select(F.col("y").alias("node"), F.col("x").alias("label")).union(now.select(F.col("x").alias("node"), F.col("x").alias("label")).distinct())
