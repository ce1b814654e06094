"""A few keys holding most records: per-key results from compressed (key, value, weight) rows."""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clademill.session import cut


def weighted_values(df: DataFrame, key: Column, value: Column, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row ``key, value, weight`` (and ``extra`` aggregates) for each distinct pair.

    The pairs of a heavy key spread over all tasks, and map-side combining leaves at most one row per pair
    and map task to be shuffled. Null keys and null values are groups of their own. Other columns, of any name, do
    no harm.
    """
    wanted = [F.count(F.lit(1)).alias("weight")] + [c.alias(n) for n, c in (extra or {}).items()]
    return df.groupBy(key.alias("key"), value.alias("value")).agg(*wanted)


def key_profile(weights: DataFrame, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Exact per-key results from the rows of ``weighted_values``.

    ``n_rows`` counts all rows; ``n_distinct``, ``mode`` (smallest of equally frequent values) and ``total``
    (sum of the values) leave null values out. A null key is a group like any other.
    """
    known = F.col("value").isNotNull()
    return weights.groupBy("key").agg(
        F.sum("weight").alias("n_rows"),
        F.count("value").alias("n_distinct"),
        F.min_by("value", F.when(known, F.struct(-F.col("weight"), F.col("value")))).alias("mode"),
        F.sum(F.col("value") * F.col("weight")).alias("total"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )


def key_percentile(weights: DataFrame, p: float, bin_width: int = 64) -> DataFrame:
    """``key, percentile``: the smallest value that at least the share ``p`` of a key's non-null values does not exceed.

    Whole-number values. Weights are first summed by bins of ``bin_width`` values; a window over the few
    bins of a key finds the bin that holds the wanted rank, and only that bin's values are ordered. No task
    ever holds all values of a key. Keys with null values only have no row.
    """
    bins = weights.filter(F.col("value").isNotNull()).withColumn("bin", F.floor(F.col("value") / bin_width))
    sums = bins.groupBy("key", "bin").agg(F.sum("weight").alias("w"))
    by_key = W.partitionBy("key")
    upto = F.sum("w").over(by_key.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = sums.select("key", "bin", "w", upto.alias("upto"), F.greatest(F.lit(1), F.ceil(F.sum("w").over(by_key) * F.lit(p))).alias("rank"))
    target = ranked.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("w") < F.col("rank")))
    target = target.select(F.col("key").alias("k"), F.col("bin").alias("b"), (F.col("rank") - F.col("upto") + F.col("w")).alias("within"))
    inside = bins.join(target, F.col("key").eqNullSafe(F.col("k")) & (F.col("bin") == F.col("b")))
    run = F.sum("weight").over(W.partitionBy("key", "bin").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
    return inside.withColumn("run", run).filter(F.col("run") >= F.col("within")).groupBy("key").agg(F.min("value").alias("percentile"))


def keys_above_share(profile: DataFrame, share: float) -> DataFrame:
    """``key, n_rows``: the non-null keys that hold at least ``share`` of all rows; rows with a null key count in the whole.

    The counts, one row per key, are written once; only their sum comes to the driver.
    """
    counts = cut(profile.select("key", "n_rows"))
    whole = counts.agg(F.sum("n_rows")).first()[0] or 0
    exact = Fraction(str(share))
    return counts.filter(F.col("key").isNotNull() & (F.col("n_rows") * exact.denominator >= F.lit(whole * exact.numerator)))
