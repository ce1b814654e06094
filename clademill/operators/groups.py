"""Sizes, predicates and routing of groups of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clademill.functions import dna
from clademill.functions.names import without_allele


def group_sizes(rows: DataFrame) -> DataFrame:
    """``group_id, n_seqs, n_taxa, length``: taxa are counted by their non-empty sequences."""
    filled = F.length(dna.without(F.col("seq"), "-")) > 0
    return rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_seqs"), F.count_distinct(F.when(filled, F.col("taxon"))).alias("n_taxa"), F.max(F.length("seq")).alias("length"), F.min(F.length("seq")).alias("shortest"))


def uneven_groups(rows: DataFrame) -> DataFrame:
    """``group_id`` of the groups whose records differ in length, so are no alignment."""
    return group_sizes(rows).filter("length <> shortest").select("group_id")


def between(n: Column, low: int, high: int) -> Column:
    """True strictly between the bounds."""
    return (n > low) & (n < high)


def occurrence(rows: DataFrame, at_least: int, taxa: DataFrame | None = None) -> DataFrame:
    """``group_id, any_over, all_over``: whether any, or each, of the ``taxa`` (all if None) has ``at_least`` records.

    A listed taxon that a group lacks counts as below.
    """
    counts = rows.groupBy("group_id", "taxon").agg(F.count(F.lit(1)).alias("n"))
    if taxa is None:
        return counts.groupBy("group_id").agg(F.max(F.col("n") >= at_least).alias("any_over"), F.min(F.col("n") >= at_least).alias("all_over"))
    listed = taxa.select("taxon").distinct()
    wanted = listed.count()
    over = counts.join(listed, "taxon", "left_semi").groupBy("group_id").agg(F.count_if(F.col("n") >= at_least).alias("over"))
    n = F.coalesce("over", F.lit(0))
    every = rows.select("group_id").distinct().join(over, "group_id", "left")
    return every.select("group_id", (n > 0).alias("any_over"), ((n == wanted) & F.lit(wanted > 0)).alias("all_over"))


def route(rows: DataFrame, max_size: int, at_least: int, by_size: bool = True, by_taxa: bool = True) -> DataFrame:
    """``group_id, route``: ``failed`` for groups that need a stricter search, else ``passed``.

    With both filters a group must fail both; without any all pass.
    """
    sized = group_sizes(rows).select("group_id", (F.col("n_seqs") > max_size).alias("large"))
    often = occurrence(rows, at_least).select("group_id", "any_over")
    both = sized.join(often, "group_id")
    bad = F.lit(False)
    if by_size and by_taxa:
        bad = F.col("large") & F.col("any_over")
    elif by_size or by_taxa:
        bad = F.col("large") if by_size else F.col("any_over")
    return both.select("group_id", F.when(bad, "failed").otherwise("passed").alias("route"))


def core_and_rest(rows: DataFrame, k: int) -> DataFrame:
    """Adds ``is_core``: the ``k`` records of a group with most letters, ties by name."""
    order = W.partitionBy("group_id").orderBy(F.desc("letters"), "seq_name")
    first = rows.select("group_id", "seq_name", F.length(dna.without(F.col("seq"), "-")).alias("letters")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    return rows.join(first.select("group_id", "seq_name", F.lit(True).alias("is_core")), ["group_id", "seq_name"], "left").withColumn("is_core", F.coalesce("is_core", F.lit(False)))


def outcome(rows: DataFrame, min_seqs: int, min_length: int, min_taxa: int, needs_outgroup: bool = False) -> DataFrame:
    """``group_id, outcome``: ``too_small``, ``too_short``, ``no_outgroup``, ``incomplete`` or ``complete``.

    ``rows`` has ``is_outgroup`` if one is needed. Every group gets one outcome; none is lost.
    """
    flag = F.max("is_outgroup") if needs_outgroup else F.lit(True)
    s = group_sizes(rows).join(rows.groupBy("group_id").agg(flag.alias("has_outgroup")), "group_id")
    said = (
        F.when(F.col("n_seqs") < min_seqs, "too_small").when(F.col("length") < min_length, "too_short")
        .when(~F.col("has_outgroup"), "no_outgroup").when(F.col("n_taxa") < min_taxa, "incomplete").otherwise("complete")
    )
    return s.select("group_id", said.alias("outcome"))


def ambiguity_filter(rows: DataFrame, max_share: float) -> DataFrame:
    """Rows with at least one base whose upper-case ``N`` per base do not exceed ``max_share``."""
    n, bases = F.regexp_count("seq", F.lit("N")), F.regexp_count("seq", F.lit("[ACGTacgt]"))
    return rows.filter((bases > 0) & (n <= bases * F.lit(max_share)))


def allele_pairs(rows: DataFrame) -> DataFrame:
    """``group_id, base, allele_0, allele_1, longest``: phased pairs of a record; the one with more letters, ties by name."""
    phased = rows.filter(F.col("seq_name").rlike(r"_allele_[01]\z")).select("group_id", "seq_name", without_allele(F.col("seq_name")).alias("base"), F.right("seq_name", F.lit(1)).alias("allele"), dna.n_bases(F.col("seq")).alias("n"))
    both = phased.groupBy("group_id", "base").agg(
        F.max(F.when(F.col("allele") == "0", F.col("seq_name"))).alias("allele_0"), F.max(F.when(F.col("allele") == "1", F.col("seq_name"))).alias("allele_1"),
        F.min(F.struct((-F.col("n")).alias("n"), "seq_name"))["seq_name"].alias("longest"),
    )
    return both.filter("allele_0 IS NOT NULL AND allele_1 IS NOT NULL")
