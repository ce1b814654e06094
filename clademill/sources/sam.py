"""SAM text as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("read_name", "flag", "seq_name", "pos", "mapq", "cigar", "mate_name", "mate_pos", "tlen", "seq", "quality")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """One row per alignment line; ``read_start`` and ``read_end`` count from 0, the end from the CIGAR text.

    ``M D N = X`` use up the reference. Header lines and lines with fewer fields are left out.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("@"))
    parts = F.split("value", "\t")
    rows = lines.filter(F.size(parts) >= len(FIELDS)).select(*[parts[i].alias(n) for i, n in enumerate(FIELDS)])
    used = F.aggregate(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MDN=X]"), F.lit(1)), F.lit(0), lambda s, x: s + x.cast("int"))
    start = F.col("pos").try_cast("int") - 1
    return rows.select(
        "read_name", F.col("flag").try_cast("int").alias("flag"), "seq_name", start.alias("read_start"), (start + used).alias("read_end"), "cigar",
        F.col("tlen").try_cast("int").alias("tlen"), "seq", "quality",
    )


def references(spark: SparkSession, path: str) -> DataFrame:
    """``seq_name, length`` of the ``@SQ`` header lines."""
    lines = spark.read.text(path).filter(F.col("value").startswith("@SQ"))
    return lines.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("seq_name"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).cast("long").alias("length"))


def properly_paired(reads: DataFrame) -> DataFrame:
    """The reads whose flag says that both mates lie as expected."""
    return reads.filter(F.col("flag").bitwiseAND(F.lit(2)) != 0)
