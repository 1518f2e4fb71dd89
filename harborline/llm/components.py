"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link each node's larger neighbours to its smallest; small star: its smaller ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both if large else both.where(F.col("v") < F.col("u"))
    least = seen.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("m", "u"))
    joined = seen.join(least, "u")
    if large:
        new = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return new.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of edges (u, v: long); component is its smallest node.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest chain.  The
    loop ends when a round changes nothing, which is told by two sums over the edges.
    """
    oriented = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = written(oriented, "edges")
    mark = None
    for _ in range(most_rounds):
        following = written(_star(_star(now, True), False), "edges")
        dropped(now)
        now = following
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == mark:
            break
        mark = (seen.n, seen.h)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
