"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Far more rounds than any graph needs: each round at least halves the length of paths, about.
MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours go to its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours go to the least of them. Edges run from the larger to the smaller end."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex with an edge; the component is its least vertex.

    ``edges`` has columns u and v of type long; loops, repeats and either direction are fine.
    Alternates the large-star and small-star steps until every vertex points at its
    component's least one. Every round is written to the shared folder.
    """
    oriented = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, seen = materialize(oriented, "edges"), None
    for _ in range(MOST_ROUNDS):
        mark = current.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        current = materialize(_small_star(_large_star(current)), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(roots)
