"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.staging import remove, staged

#: Rounds after which something is wrong: paths of 2**MOST_ROUNDS nodes need no more.
MOST_ROUNDS = 64


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller-or-equal neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u")
    return (
        hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(hung.select("u", F.col("m").alias("v")))
        .filter("u <> v").distinct()
    )


def connected_components(edges: DataFrame, left: str, right: str, node: str = "node", root: str = "component") -> DataFrame:
    """One row (node, component) per node that occurs in an edge; component is the smallest node reached.

    Node ids may be of any one orderable type.  Self-loops count as nodes; edges with a null end are ignored;
    repeated and reversed edges change nothing; an empty edge table gives an empty result.  Each round is two
    shuffles of the (shrinking) edge set and is written to the shared folder; about log2 of the longest path
    rounds are needed.  The minimum per node is combined on the map side, so a hub does not gather its edges
    in one task.
    """
    raw = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    spark = edges.sparkSession
    current, path = staged(raw.filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        following, written = staged(_small_star(_large_star(current)), "star")
        remove(spark, path)
        current, path = following, written
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise ArithmeticError(f"components did not settle in {MOST_ROUNDS} rounds")
    star = current.select(F.col("u").alias(node), F.col("v").alias(root))
    roots = star.select(F.col(root).alias(node)).distinct().withColumn(root, F.col(node))
    loops = raw.filter("u = v").select(F.col("u").alias(node)).distinct().withColumn(root, F.col(node))
    return star.unionByName(roots).unionByName(loops.join(star, node, "left_anti").join(roots, node, "left_anti"))
