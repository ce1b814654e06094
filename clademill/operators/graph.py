"""Graphs of records: reciprocal edges, connected components, thresholds and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.session import cut, written


def reciprocal(hits: DataFrame, min_length: int) -> DataFrame:
    """``a < b`` of the pairs hit in both directions, each time over more than ``min_length`` letters."""
    long = hits.filter(F.col("align_len") > min_length)
    seen = long.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max(F.col("a") < F.col("b")).alias("forth"), F.max(F.col("a") > F.col("b")).alias("back"))
    return seen.filter("forth AND back").select(F.col("lo").alias("a"), F.col("hi").alias("b"))


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best targets of each query: smallest e-value, then longest, then target name."""
    from pyspark.sql import Window as W

    best = hits.groupBy("a", "b").agg(F.min("evalue").alias("evalue"), F.max("align_len").alias("align_len"))
    order = W.partitionBy("a").orderBy(F.asc_nulls_last("evalue"), F.desc_nulls_last("align_len"), "b")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", group: str | None = None) -> DataFrame:
    """``[group,] vertex, component``: each vertex of an edge with the smallest vertex that it reaches.

    Alternates two star steps until nothing moves: each vertex links its larger neighbours to its smallest
    one, then its smaller neighbours and itself to the smallest. Every step is one window-free aggregation over the edges,
    whose number does not grow. Edges with a null end or equal ends link nothing.
    """
    keys = [group] if group else []
    ends = edges.select(*keys, F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    current = cut(ends.select(*keys, F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    moved = F.count_if("moved")
    while True:
        both = current.unionByName(current.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        turned = both.join(least, [*keys, "u"]).filter("v > u").groupBy(*keys, F.col("v").alias("u"), F.col("m").alias("v")).agg(F.bool_or(F.col("m") != F.col("u")).alias("moved"))
        large, first = written(turned, moved=moved)
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        near = large.drop("moved").join(low, [*keys, "u"]).select(*keys, F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("v") != F.col("m")).alias("moved"))
        small, then = written(near.filter("u <> v").groupBy(*keys, "u", "v").agg(F.bool_or("moved").alias("moved")), moved=moved)
        current = small.drop("moved")
        if not first["moved"] and not then["moved"]:
            break
    roots = current.select(*keys, F.col("v").alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    return current.select(*keys, F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)


def keep_components(members: DataFrame, taxon: str, more_than: int) -> DataFrame:
    """``vertex, component, n_taxa, kept``: components with more than so many taxa are kept."""
    sizes = members.groupBy("component").agg(F.count_distinct(taxon).alias("n_taxa"))
    return members.join(sizes, "component").select("vertex", "component", "n_taxa", (F.col("n_taxa") > more_than).alias("kept"))


def with_overlap(scores: DataFrame, counts: DataFrame) -> DataFrame:
    """The scores with the ``overlap`` of their pairs."""
    return scores.join(counts.select("group_id", "a", "b", "overlap"), ["group_id", "a", "b"])


def outgroup_threshold(scores: DataFrame, outgroups: DataFrame, keys: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """``keys, threshold``: the best score of an ingroup and an outgroup record, over pairs with more than 300 common
    columns, else more than 200, else more than 100, else 0. ``scores`` carry ``overlap``."""
    taxon = lambda c: F.split_part(c, F.lit("|"), F.lit(1))
    marked = outgroups.select("taxon").distinct()
    both = scores.withColumn("ta", taxon(F.col("a"))).withColumn("tb", taxon(F.col("b")))
    both = both.join(marked.select(F.col("taxon").alias("ta"), F.lit(1).alias("oa")), "ta", "left").join(marked.select(F.col("taxon").alias("tb"), F.lit(1).alias("ob")), "tb", "left")
    mixed = both.filter(F.col("oa").isNull() != F.col("ob").isNull())
    tiers = [F.max(F.when(F.col("overlap") > n, F.col("score"))) for n in (300, 200, 100)]
    return mixed.groupBy(*keys).agg(F.coalesce(*tiers, F.lit(0.0)).alias("threshold"))


def similarity_edges(scores: DataFrame, thresholds: DataFrame, outgroups: DataFrame, min_overlap: int, keys: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """``keys, a, b`` of ingroup pairs that score above the threshold of their ``keys`` on more than ``min_overlap`` columns."""
    taxon = lambda c: F.split_part(c, F.lit("|"), F.lit(1))
    out = outgroups.select("taxon").distinct()
    pairs = scores.filter(F.col("overlap") > min_overlap)
    pairs = pairs.withColumn("ta", taxon(F.col("a"))).withColumn("tb", taxon(F.col("b")))
    pairs = pairs.join(out.select(F.col("taxon").alias("ta")), "ta", "left_anti").join(out.select(F.col("taxon").alias("tb")), "tb", "left_anti")
    return pairs.join(thresholds, list(keys), "left").filter(F.col("score") > F.coalesce("threshold", F.lit(0.0))).select(*keys, "a", "b")
