"""Intervals: merged periods and gaps per entity, containment and overlap joins by position bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clademill.session import cut

BLOCK = 4096


def distinct_starts(df: DataFrame, key: Column, start: Column, end: Column, block: int = BLOCK) -> DataFrame:
    """``key, block, lo, hi``: for each entity and start the furthest end.

    Rows with a null in any of the three, or whose end is not after the start, are no intervals. Of several
    intervals with one start only the longest matters for what is covered; map-side combining drops the others
    before the shuffle, and a block of an entity then has at most ``block`` rows, however heavy the entity is.
    """
    rows = df.select(key.alias("key"), start.cast("long").alias("lo"), end.cast("long").alias("hi"))
    rows = rows.filter(F.col("key").isNotNull() & (F.col("hi") > F.col("lo")))
    return rows.groupBy("key", F.floor(F.col("lo") / block).alias("block"), "lo").agg(F.max("hi").alias("hi"))


def with_reach(starts: DataFrame) -> DataFrame:
    """Adds ``reach``, the furthest end of the entity's intervals that start earlier (null for the first).

    The running maximum is taken within each block; a window over the block maxima of an entity hands it
    on from block to block, so that no task sorts a whole entity. ``starts`` is read twice; write it first if it is
    costly.
    """
    before = W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    within = W.partitionBy("key", "block").orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    local = starts.withColumn("local", F.max("hi").over(within))
    carried = starts.groupBy("key", "block").agg(F.max("hi").alias("top")).select("key", "block", F.max("top").over(before).alias("carried"))
    return local.join(carried, ["key", "block"]).withColumn("reach", F.greatest("local", "carried")).drop("local", "carried")


def gaps(df: DataFrame, key: Column, start: Column, end: Column, block: int = BLOCK) -> DataFrame:
    """``key, gap_start, gap_end`` of the uncovered stretches between covered ones; touching ones leave no gap."""
    reached = with_reach(cut(distinct_starts(df, key, start, end, block)))
    return reached.filter(F.col("lo") > F.col("reach")).select("key", F.col("reach").alias("gap_start"), F.col("lo").alias("gap_end"))


def merged_periods(df: DataFrame, key: Column, start: Column, end: Column, block: int = BLOCK) -> DataFrame:
    """``key, period_start, period_end, n_starts`` of the covered stretches; touching intervals are one stretch.

    An island is labelled by its first start: a running maximum of the island starts, again handed on from
    block to block.
    """
    reached = with_reach(cut(distinct_starts(df, key, start, end, block)))
    head = F.when(F.col("reach").isNull() | (F.col("lo") > F.col("reach")), F.col("lo"))
    heads = reached.withColumn("head", head)
    before = W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    within = W.partitionBy("key", "block").orderBy("lo").rowsBetween(W.unboundedPreceding, W.currentRow)
    labelled = heads.withColumn("local", F.max("head").over(within))
    carried = heads.groupBy("key", "block").agg(F.max("head").alias("top")).select("key", "block", F.max("top").over(before).alias("carried"))
    joined = labelled.join(carried, ["key", "block"]).withColumn("period_start", F.coalesce("local", "carried"))
    return joined.groupBy("key", "period_start").agg(F.max("hi").alias("period_end"), F.count(F.lit(1)).alias("n_starts")).select("key", "period_start", "period_end", "n_starts")


def binned(df: DataFrame, lo: str, hi: str, width: int, closed: bool = False) -> DataFrame:
    """One row per bin of ``width`` positions that ``[lo, hi)`` (or ``[lo, hi]``) touches, in column ``bin``."""
    last = F.col(hi) if closed else F.greatest(F.col(hi) - 1, F.col(lo))
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(last / width))))


def containment_join(outer: DataFrame, inner: DataFrame, key: str, lo: str, hi: str, inner_lo: str, inner_hi: str, width: int = 64) -> DataFrame:
    """Pairs of an ``outer`` interval and an ``inner`` one that lies in it, of one ``key``.

    An inner interval lies in the bin of its start only, an outer one in each bin that it touches, so each
    pair comes out once and the join is an equi-join on key and bin. Columns other than the key must differ.
    """
    left = binned(outer, lo, hi, width, closed=True)
    right = inner.withColumn("bin", F.floor(F.col(inner_lo) / width))
    return left.join(right, [key, "bin"]).filter((F.col(lo) <= F.col(inner_lo)) & (F.col(hi) >= F.col(inner_hi))).drop("bin")


def overlap_semi(df: DataFrame, group: str, owner: str, lo: str, hi: str, width: int = 64) -> DataFrame:
    """The intervals (columns ``group, owner, lo, hi``) that an interval of another owner of the group overlaps.

    Closed ends. Both sides are cut into position bins; within a bin an interval is overlapped by another owner
    if the bin holds two owners' intervals that meet, which an equi-join on group and bin decides; the result
    is distinct.
    """
    rows = df.select(group, owner, lo, hi).distinct()
    left = binned(rows, lo, hi, width, closed=True)
    right = left.select(F.col(group), "bin", F.col(owner).alias("o_owner"), F.col(lo).alias("o_lo"), F.col(hi).alias("o_hi"))
    met = (F.col("o_owner") != F.col(owner)) & intersects(F.col(lo), F.col(hi), F.col("o_lo"), F.col("o_hi"))
    return left.alias("l").join(right.alias("r"), (F.col(f"l.{group}") == F.col(f"r.{group}")) & (F.col("l.bin") == F.col("r.bin")) & met, "left_semi").drop("bin").distinct()


def contains(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """True if ``[lo, hi]`` holds the other interval."""
    return (lo <= other_lo) & (hi >= other_hi)


def intersects(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """True if two closed intervals share a point."""
    return (lo <= other_hi) & (other_lo <= hi)
