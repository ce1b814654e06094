"""The aligned records of the data folder, cleaned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.functions.names import canonical_name, contig_of, taxon_of
from clademill.sources.tables import table


def aligned(spark: SparkSession, folder: str) -> DataFrame:
    """``group_id, seq_name, taxon, contig, seq``: one row per group and canonical name.

    Of repeated rows the latest counts, of equally late ones the text that sorts last. Rows without sequence, name
    or group are left out. Sequences are upper case.
    """
    rows = table(spark, folder, "alignments").select("group_id", canonical_name(F.col("seq_name")).alias("seq_name"), F.upper("seq").alias("seq"), "aligned_at")
    rows = rows.filter("group_id IS NOT NULL AND seq_name IS NOT NULL AND seq IS NOT NULL")
    # the rows are few bytes but much work, so their tasks are not merged
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = rows.repartition(tasks, "group_id", "seq_name").groupBy("group_id", "seq_name").agg(F.max(F.struct("aligned_at", "seq")).alias("m"))
    return last.select("group_id", "seq_name", taxon_of(F.col("seq_name")).alias("taxon"), contig_of(F.col("seq_name")).alias("contig"), F.col("m.seq").alias("seq"))


def outgroup_taxa(spark: SparkSession, folder: str) -> DataFrame:
    """``taxon`` of the outgroups; a null flag is none. The table has one row per taxon."""
    return table(spark, folder, "taxa").filter("is_outgroup").select("taxon").distinct()


def with_outgroup(rows: DataFrame, outgroups: DataFrame) -> DataFrame:
    """Adds ``is_outgroup``."""
    marked = outgroups.select("taxon", F.lit(True).alias("is_outgroup"))
    return rows.join(marked, "taxon", "left").withColumn("is_outgroup", F.coalesce("is_outgroup", F.lit(False)))


def pair_distances(spark: SparkSession, folder: str) -> DataFrame:
    """``group_id, a < b, distance``: the mean of a pair's measurements; nulls, NaN and self comparisons are none."""
    rows = table(spark, folder, "distances").select("group_id", canonical_name(F.col("a")).alias("x"), canonical_name(F.col("b")).alias("y"), "distance")
    rows = rows.filter("group_id IS NOT NULL AND x <> y AND distance IS NOT NULL AND NOT isnan(distance)")
    pairs = rows.select("group_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    return pairs.groupBy("group_id", "a", "b").agg(F.round(F.avg("distance"), 6).alias("distance"))


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """``a, b, align_len, evalue``: hits between two canonical names in the direction given."""
    rows = table(spark, folder, "common_hits").select(canonical_name(F.col("a")).alias("a"), canonical_name(F.col("b")).alias("b"), "align_len", "evalue", "hit_id")
    return rows.filter("a <> b")
