"""Structured Streaming over arriving text and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.sources.fasta import records_of


def fasta_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``path, name, description, seq`` of the records of FASTA files as they are dropped into ``folder``."""
    lines = spark.readStream.option("lineSep", "\n>").text(folder).withColumn("path", F.col("_metadata.file_path"))
    return records_of(lines)


def counts_by_window(stream: DataFrame, name: Column, time: str, width: str, late: str) -> DataFrame:
    """``window, seq_name, n``: rows per name and window of ``time``; rows more than ``late`` behind are dropped by the watermark."""
    named = stream.withColumn("seq_name", name).withWatermark(time, late)
    return named.groupBy(F.window(time, width), "seq_name").agg(F.count(F.lit(1)).alias("n"))


def first_deliveries(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The stream without rows that repeat ``keys`` within ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
