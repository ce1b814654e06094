"""Tables of sequence hits from the text formats of search programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABULAR = "query string, target string, identity double, align_len int, mismatches int, gap_opens int, q_start int, q_end int, t_start int, t_end int, evalue double, score double"


def read_tabular(spark: SparkSession, path: str) -> DataFrame:
    """Twelve-column tab-separated hits."""
    return spark.read.csv(path, sep="\t", schema=TABULAR, comment="#")


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """``query, target, align_len, evalue``: one row per aligned segment of XML search reports."""
    schema = (
        "`Iteration_query-def` string, Iteration_hits struct<Hit: array<struct<Hit_def: string, Hit_hsps: struct<Hsp: array<struct<"
        "`Hsp_align-len`: int, Hsp_evalue: double>>>>>>"
    )
    rows = spark.read.format("xml").option("rowTag", "Iteration").schema(schema).load(path)
    found = rows.select(F.col("Iteration_query-def").alias("query"), F.explode("Iteration_hits.Hit").alias("h"))
    parts = found.select("query", F.col("h.Hit_def").alias("target"), F.explode("h.Hit_hsps.Hsp").alias("s"))
    return parts.select("query", "target", F.col("s.Hsp_align-len").alias("align_len"), F.col("s.Hsp_evalue").alias("evalue"))


def long_hits(segments: DataFrame, min_length: int) -> DataFrame:
    """``query, target``: pairs with a segment of more than ``min_length`` letters."""
    return segments.groupBy("query", "target").agg(F.max("align_len").alias("align_len"), F.min("evalue").alias("evalue")).filter(F.col("align_len") > min_length)
