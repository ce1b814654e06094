"""FASTA and FASTQ text as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.functions.names import first_token


def records_of(lines: DataFrame, text: str = "value") -> DataFrame:
    """``path, name, description, seq`` of text that was split at ``\\n>``; a first record keeps its ``>``.

    Carriage returns and line breaks within sequences go; a chunk without header text is left out.
    """
    body = F.regexp_replace(F.regexp_replace(F.col(text), r"^[\s]*>", ""), "\r", "")
    head = F.split_part(body, F.lit("\n"), F.lit(1))
    seq = F.regexp_replace(F.substring(body, F.length(head) + 2, F.length(body)), r"\s", "")
    rows = lines.select("path", head.alias("head"), seq.alias("seq"))
    return rows.filter(F.trim("head") != "").select("path", first_token(F.col("head")).alias("name"), F.trim(F.regexp_replace("head", r"^\s*\S+", "")).alias("description"), "seq")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, description, seq`` of all records; large files are split at record starts."""
    lines = spark.read.option("lineSep", "\n>").text(path).withColumn("path", F.col("_metadata.file_path"))
    return records_of(lines)


def invalid_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``path, reason`` of the files without a record, or with a record without sequence."""
    files = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    found = records_of(files).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("seq") == 0).alias("empty"), F.count_if(F.col("seq").rlike("[^A-Za-z*.-]")).alias("odd"))
    every = files.select("path").distinct().join(found, "path", "left")
    reason = F.when(F.col("n").isNull(), "no record").when(F.col("empty") > 0, "record without sequence").when(F.col("odd") > 0, "other characters")
    return every.select("path", reason.alias("reason")).filter("reason IS NOT NULL")


def write_fasta(rows: DataFrame, path: str, group: str | None = None, name: Column | None = None) -> None:
    """Writes ``seq_name`` and ``seq`` sorted by name; with ``group`` one folder per value of that column."""
    named = rows.withColumn("__name", F.col("seq_name") if name is None else name)
    text = F.concat(F.lit(">"), "__name", F.lit("\n"), "seq").alias("value")
    if group is None:
        named.sort("__name").select(text).write.text(path)
        return
    named.repartition(group).sortWithinPartitions(group, "__name").select(text, group).write.partitionBy(group).text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, seq, quality`` of files of four-line records, found by the running number of a line in its file."""
    from pyspark.sql import Window as W

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("i"), "value")
    n = F.row_number().over(W.partitionBy("path").orderBy("i")) - 1
    placed = lines.withColumn("n", n)
    part = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("value")))
    rows = placed.groupBy("path", F.floor(F.col("n") / 4).alias("r")).agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("quality"))
    return rows.select("path", first_token(F.regexp_replace("head", "^@", "")).alias("name"), "seq", "quality")
