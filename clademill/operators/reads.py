"""Reads on records: mates, bases by position, variable positions and reads that span two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clademill.operators.intervals import binned


def distinct_reads(df: DataFrame, name: Column) -> DataFrame:
    """``seq_name, read_name, lo, hi, seq``: reads with a name, a start and a sequence; redelivered ones once."""
    rows = df.select(name.alias("seq_name"), "read_name", F.col("read_start").alias("lo"), F.upper("seq").alias("seq"))
    rows = rows.filter("seq_name IS NOT NULL AND read_name IS NOT NULL AND lo IS NOT NULL AND length(seq) > 0").distinct()
    return rows.withColumn("hi", F.col("lo") + F.length("seq"))


def mate_pairs(reads: DataFrame) -> DataFrame:
    """``read_name, seq_name, lo, hi, seq``: the first two reads of a name on one record, by start and text, the gap between
    them filled with ``-``; overlapping mates are merged at their positions, the first read counting. Single reads stay as
    they are; a third read of a name is no mate."""
    order = F.struct("lo", "seq")
    place = F.row_number().over(W.partitionBy("read_name", "seq_name").orderBy("lo", "seq"))
    first = reads.withColumn("r", place).filter("r <= 2")
    ends = first.groupBy("read_name", "seq_name").agg(F.min(order).alias("one"), F.count(F.lit(1)).alias("n"), F.max(order).alias("two"))
    size = F.length("one.seq")
    ahead = F.col("two.lo") - F.col("one.lo") - size
    merged = F.when(ahead >= 0, F.concat("one.seq", F.repeat(F.lit("-"), ahead), "two.seq")).otherwise(F.concat(F.col("one.seq"), F.substring(F.col("two.seq"), 1 - ahead, F.length("two.seq"))))
    seq = F.when(F.col("n") > 1, merged).otherwise(F.col("one.seq"))
    return ends.select("read_name", "seq_name", F.col("one.lo").alias("lo"), (F.col("one.lo") + F.length(seq)).alias("hi"), seq.alias("seq"))


def pileup(reads: DataFrame) -> DataFrame:
    """``seq_name, pos, A, C, G, T``: bases of the reads at each position, counted with map-side combining."""
    letters = reads.select("seq_name", "lo", F.posexplode(F.split("seq", "")).alias("i", "ch")).filter(F.col("ch").isin(*"ACGT"))
    return letters.groupBy("seq_name", (F.col("lo") + F.col("i")).alias("pos")).agg(*[F.count_if(F.col("ch") == x).alias(x) for x in "ACGT"])


def variable_positions(piled: DataFrame, min_coverage: int, min_share: float) -> DataFrame:
    """``seq_name, pos, reads_ref, reads_alt``: positions where the second base has at least ``min_share`` of the reads."""
    counts = F.reverse(F.array_sort(F.array(*"ACGT")))
    ranked = piled.select("seq_name", "pos", F.get(counts, F.lit(0)).alias("reads_ref"), F.get(counts, F.lit(1)).alias("reads_alt"), (F.col("A") + F.col("C") + F.col("G") + F.col("T")).alias("n"))
    return ranked.filter((F.col("n") >= min_coverage) & (F.col("reads_alt") > 0) & (F.col("reads_alt") >= F.col("n") * F.lit(min_share))).drop("n")


def adjacent(snps: DataFrame) -> DataFrame:
    """``seq_name, pos, next_pos`` of neighbouring variable positions."""
    w = W.partitionBy("seq_name").orderBy("pos")
    return snps.select("seq_name", "pos", F.lead("pos").over(w).alias("next_pos")).filter("next_pos IS NOT NULL")


def spanning(reads: DataFrame, pairs: DataFrame, width: int = 64) -> DataFrame:
    """``seq_name, pos, next_pos, n_reads``: reads that cover both positions with a base; 0 where none does.

    A pair lies in the bin of its first position, a read in each that it touches, so the range join is an
    equi-join whose keys are small.
    """
    placed = binned(reads, "lo", "hi", width)
    keyed = pairs.withColumn("bin", F.floor(F.col("pos") / width))
    base = lambda p: F.substring("seq", F.col(p) - F.col("lo") + 1, F.lit(1)) != "-"
    hit = placed.join(keyed, ["seq_name", "bin"]).filter((F.col("lo") <= F.col("pos")) & (F.col("hi") > F.col("next_pos")) & base("pos") & base("next_pos"))
    n = hit.groupBy("seq_name", "pos", "next_pos").agg(F.count(F.lit(1)).alias("n_reads"))
    return pairs.join(n, ["seq_name", "pos", "next_pos"], "left").select("seq_name", "pos", "next_pos", F.coalesce("n_reads", F.lit(0)).alias("n_reads"))


def validity(spans: DataFrame, stringency: float) -> DataFrame:
    """``seq_name, n_pairs, ratio, valid``: the share of neighbouring positions that a read covers together.

    Stringency 0 accepts all, 1 wants each pair covered, between them the ratio has to exceed it.
    """
    by = spans.groupBy("seq_name").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("n_reads") > 0).alias("covered"))
    ratio = F.col("covered") / F.col("n_pairs")
    ok = F.lit(True) if stringency <= 0 else ratio >= 1 if stringency >= 1 else ratio > stringency
    return by.select("seq_name", "n_pairs", F.round(ratio, 6).alias("ratio"), ok.alias("valid"))


def phase(mates: DataFrame, snps: DataFrame, width: int = 64) -> DataFrame:
    """``seq_name, pos, allele, base``: bases of the two haplotypes at variable positions, joined along neighbours.

    At each position the two most frequent bases are ordered by text; reads that cover two neighbouring positions
    vote whether the order is kept or turned, and turns add up along the record. A pair that no read decides keeps it.
    """
    at = binned(mates, "lo", "hi", width).join(snps.select("seq_name", "pos", F.floor(F.col("pos") / width).alias("bin")), ["seq_name", "bin"])
    bases = at.filter((F.col("lo") <= F.col("pos")) & (F.col("hi") > F.col("pos"))).select("seq_name", "read_name", "pos", F.substring("seq", F.col("pos") - F.col("lo") + 1, F.lit(1)).alias("base")).filter(F.col("base").isin(*"ACGT"))
    counts = bases.groupBy("seq_name", "pos", "base").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("seq_name", "pos").orderBy(F.desc("n"), "base"))
    two = counts.withColumn("r", rank).filter("r <= 2").groupBy("seq_name", "pos").agg(F.min("base").alias("b0"), F.max("base").alias("b1")).filter("b0 < b1")
    called = bases.join(two, ["seq_name", "pos"]).filter("base = b0 OR base = b1").select("seq_name", "read_name", "pos", (F.col("base") == F.col("b1")).cast("int").alias("side"))
    near = adjacent(two)
    left = called.join(near, ["seq_name", "pos"])
    right = called.select("seq_name", "read_name", F.col("pos").alias("next_pos"), F.col("side").alias("next_side"))
    votes = left.join(right, ["seq_name", "read_name", "next_pos"]).groupBy("seq_name", "next_pos").agg(F.sum(F.when(F.col("side") == F.col("next_side"), 1).otherwise(-1)).alias("v"))
    turned = two.join(votes.select("seq_name", F.col("next_pos").alias("pos"), "v"), ["seq_name", "pos"], "left").withColumn("turn", F.when(F.col("v") < 0, 1).otherwise(0))
    total = F.sum("turn").over(W.partitionBy("seq_name").orderBy("pos")) % 2
    phased = turned.withColumn("t", total)
    ends = F.array(F.struct(F.lit(0).alias("allele"), F.when(F.col("t") == 0, F.col("b0")).otherwise(F.col("b1")).alias("base")), F.struct(F.lit(1).alias("allele"), F.when(F.col("t") == 0, F.col("b1")).otherwise(F.col("b0")).alias("base")))
    return phased.select("seq_name", "pos", F.explode(ends).alias("e")).select("seq_name", "pos", "e.allele", "e.base")


def haplotypes(records: DataFrame, phased: DataFrame) -> DataFrame:
    """``seq_name, seq`` of the phased records: two rows ``_allele_0`` and ``_allele_1`` for a record with phased positions.

    The base of each allele replaces the record's letter in place; records without such a position stay one row with
    their name. Positions beyond the end of a record change nothing. Gaps and ``n`` are removed at the end.
    """
    spots = phased.groupBy("seq_name", "allele").agg(F.sort_array(F.collect_list(F.struct("pos", "base"))).alias("spots"))
    joined = records.select("seq_name", "seq").join(spots, "seq_name", "left")
    put = lambda s, x: F.when((x["pos"] >= 0) & (x["pos"] < F.length(s)), F.overlay(s, x["base"], x["pos"] + 1)).otherwise(s)
    none = F.array().cast("array<struct<pos:int,base:string>>")
    done = F.translate(F.aggregate(F.coalesce("spots", none), F.col("seq"), put), "n-", "")
    name = F.when(F.col("allele").isNull(), F.col("seq_name")).otherwise(F.concat("seq_name", F.lit("_allele_"), F.col("allele").cast("string")))
    return joined.select(name.alias("seq_name"), done.alias("seq"))
