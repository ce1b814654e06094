"""Consolidating pairwise matches into groups: deterministic Boruvka hooking with pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.session import cut, written


def clean_edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct ``u < v``; pairs with a null end and pairs of a record with itself link nothing."""
    rows = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    return rows.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def hook(edges: DataFrame) -> DataFrame:
    """``v, p``: for each component with an edge the other end of its smallest edge, trees cut at their smallest vertex.

    Edges are ordered by ``(u, v)``. The smallest edge of a tree is chosen from both its ends and starts at the
    smallest vertex of the tree, which becomes the root; other cycles cannot arise.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("v").alias("w")), F.struct(F.col("v").alias("v"), F.col("u").alias("w")))).alias("e")).select("e.v", "e.w")
    best = ends.groupBy("v").agg(F.min(F.struct(F.least("v", "w").alias("lo"), F.greatest("v", "w").alias("hi"))).alias("e"))
    chosen = best.select("v", F.when(F.col("e.lo") == F.col("v"), F.col("e.hi")).otherwise(F.col("e.lo")).alias("p"), F.col("e.lo").alias("lo"))
    back = chosen.select(F.col("v").alias("p"), F.col("p").alias("pp"))
    mutual = (F.col("pp") == F.col("v")) & (F.col("v") < F.col("p"))
    return chosen.join(back, "p").select("v", F.when(mutual, F.col("v")).otherwise(F.col("p")).alias("p"))


def collapse(parents: DataFrame) -> DataFrame:
    """Pointer doubling until each vertex of the forest ``v, p`` points to its root."""
    stars = cut(parents)
    while True:
        up = stars.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        doubled, found = written(stars.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), moved=F.count_if("moved"))
        stars = doubled.drop("moved")
        if not found["moved"]:
            return stars


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``vertex, component``: every linked record with the smallest record that it is linked to, directly or not.

    Each round every component hooks onto its smallest outgoing edge, the trees collapse, edges are relabelled,
    deduplicated and dropped inside components; the components at least halve, so the rounds are logarithmic. Joins are
    on vertices whose other side is unique, so a vertex with a third of all pairs is split by adaptive skew
    handling. Records without a partner do not come out; an empty table gives none.
    """
    edges, left_over = written(clean_edges(pairs, a, b), n=F.count(F.lit(1)))
    rounds = []
    while left_over["n"]:
        stars = collapse(hook(edges))
        rounds.append(stars)
        left = stars.select(F.col("v").alias("u"), F.col("p").alias("ru"))
        right = stars.select("v", F.col("p").alias("rv"))
        moved = edges.join(left, "u").join(right, "v").filter("ru <> rv")
        edges, left_over = written(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), n=F.count(F.lit(1)))
    if not rounds:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    total = rounds.pop()
    while rounds:
        later = total.select(F.col("v").alias("p"), F.col("p").alias("root"))
        total = rounds.pop().join(later, "p", "left").select("v", F.coalesce("root", "p").alias("p"))
    return total.select(F.col("v").alias("vertex"), F.col("p").alias("component"))
