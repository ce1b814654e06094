"""Queries of the general problems 4, 5 and 7, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.functions.names import canonical_name
from clademill.operators import heavy, intervals, rejects
from clademill.sources.tables import table

#: A name is heavy from this share of all rows on.
HEAVY_SHARE = 0.02


def sql_name(name: str) -> str:
    """DuckDB text of the canonical name of the column or expression ``name``; null where it is no name."""
    w = r"\s\p{Z}\x{85}"
    t = rf"regexp_replace(regexp_extract(lower({name}), '^[{w}]*(?:_r_[{w}]*)*([^|]*?)[{w}]*(?:\||$)', 1), '[{w}]+', '_', 'g')"
    c = rf"regexp_extract(lower({name}), '\|[{w}]*(?:_r_[{w}]*)*([^|{w}]+)', 1)"
    return f"CASE WHEN {t} <> '' AND {c} <> '' THEN {t} || '|' || {c} END"


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    parsed = rejects.parse_contig_lines(table(spark, folder, "raw_contigs"))
    return parsed.filter(F.col("reason").isNotNull()).select("raw_id")


def p4_reasons(spark: SparkSession, folder: str) -> DataFrame:
    parsed = rejects.parse_contig_lines(table(spark, folder, "raw_contigs"))
    return parsed.filter(F.col("reason").isNotNull()).select("raw_id", "reason")


def p4_loaded(spark: SparkSession, folder: str) -> DataFrame:
    parsed = rejects.parse_contig_lines(table(spark, folder, "raw_contigs"))
    return parsed.filter(F.col("reason").isNull()).drop("reason")


def read_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Reads by canonical name and covered length."""
    r = table(spark, folder, "reads")
    known = F.col("read_end") > F.col("read_start")
    bounds = {"first": F.min("read_start"), "last": F.max(F.when(known, F.col("read_end")))}
    length = F.when(known, F.col("read_end") - F.col("read_start"))
    return heavy.weighted_values(r, canonical_name(F.col("seq_name")), length, bounds)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    profile = heavy.key_profile(read_weights(spark, folder))
    return heavy.keys_above_share(profile, HEAVY_SHARE).select(F.col("key").alias("seq_name"))


def p5_profile(spark: SparkSession, folder: str) -> DataFrame:
    w = read_weights(spark, folder)
    profile = heavy.key_profile(w, {"first": F.min("first"), "last": F.max("last")})
    half = heavy.key_percentile(w, 0.5)
    joined = profile.filter(F.col("key").isNotNull()).join(half, "key", "left")
    return joined.select(F.col("key").alias("seq_name"), "n_rows", "n_distinct", F.col("mode").alias("mode_length"), F.col("percentile").alias("median_length"), F.col("total").alias("n_bases"), F.col("first").alias("extent_start"), F.col("last").alias("extent_end"))


def read_interval() -> tuple:
    """Name, start and end of a read; a missing end is the start plus the length of the sequence."""
    return canonical_name(F.col("seq_name")), F.col("read_start"), F.coalesce(F.col("read_end"), F.col("read_start") + F.length("seq"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    g = intervals.gaps(table(spark, folder, "reads"), *read_interval())
    return g.select(F.col("key").alias("seq_name"), F.col("gap_start").cast("int").alias("gap_start"), F.col("gap_end").cast("int").alias("gap_end"))


def p7_periods(spark: SparkSession, folder: str) -> DataFrame:
    p = intervals.merged_periods(table(spark, folder, "reads"), *read_interval())
    return p.select(F.col("key").alias("seq_name"), "period_start", "period_end", "n_starts")


QUERIES = {f.__name__: f for f in (p4_found, p4_reasons, p4_loaded, p5_found, p5_profile, p7_found, p7_periods)}

_LENGTH = "CASE WHEN read_end > read_start THEN read_end - read_start END"
_INTERVALS = f"""
iv AS (SELECT {sql_name('seq_name')} seq_name, read_start::BIGINT lo, coalesce(read_end, read_start + length(seq))::BIGINT hi FROM reads),
ok AS (SELECT seq_name, lo, max(hi) hi FROM iv WHERE seq_name IS NOT NULL AND hi > lo GROUP BY ALL),
re AS (SELECT *, max(hi) OVER (PARTITION BY seq_name ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM ok)"""
_FIELD = r"""(?:"((?:[^"]|"")*)"|([^",\r\n]*))"""
_LINE = "^" + ",".join([r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'] * 5) + r"\r?$"


def _field(k: int) -> str:
    """DuckDB text of field ``k`` of a well-formed line, unquoted."""
    lead = "^" + r'(?:(?:"(?:[^"]|"")*"|[^",\r\n]*),){%d}' % k
    return rf"""CASE WHEN regexp_extract(raw, '{lead}(")', 1) = '"' THEN replace(regexp_extract(raw, '{lead}"((?:[^"]|"")*)"', 1), '""', '"')
        ELSE regexp_extract(raw, '{lead}([^",\r\n]*)', 1) END"""


_PARSED = f"""
w AS (SELECT raw_id, raw, regexp_full_match(raw, '{_LINE[1:-1]}') AS whole FROM raw_contigs),
p AS (SELECT raw_id, whole, {_field(0)} seq_id, {_field(1)} loaded_on, {_field(2)} n_bases, {_field(3)} seq, {_field(4)} description FROM w),
c AS (SELECT *, coalesce(whole AND regexp_full_match(seq_id, '[^|\\s\\p{{Z}}]+\\|[^|\\s\\p{{Z}}]+') AND regexp_full_match(loaded_on, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
    AND try_cast(loaded_on AS DATE) IS NOT NULL AND regexp_full_match(n_bases, '[0-9]+') AND regexp_full_match(seq, '[ACGTURYSWKMBDHVNacgturyswkmbdhvn-]+')
    AND try_cast(n_bases AS HUGEINT) = length(seq), false) good FROM p)"""

SQL = {
    "p4_found": f"WITH {_PARSED} SELECT raw_id FROM c WHERE NOT good",
    "p4_loaded": f"WITH {_PARSED} SELECT raw_id, seq_id, CAST(loaded_on AS DATE) loaded_on, CAST(n_bases AS INTEGER) n_bases, seq, description FROM c WHERE good",
    "p5_found": f"""WITH n AS (SELECT {sql_name('seq_name')} seq_name, count(*) n FROM reads GROUP BY 1)
        SELECT seq_name FROM n WHERE seq_name IS NOT NULL AND n >= {HEAVY_SHARE} * (SELECT sum(n) FROM n)""",
    "p5_profile": f"""WITH r AS (SELECT {sql_name('seq_name')} seq_name, read_start, CASE WHEN read_end > read_start THEN read_end END read_end, {_LENGTH} len FROM reads),
        m AS (SELECT seq_name, len, count(*) n FROM r WHERE len IS NOT NULL GROUP BY ALL),
        o AS (SELECT seq_name, len FROM m QUALIFY row_number() OVER (PARTITION BY seq_name ORDER BY n DESC, len) = 1)
        SELECT r.seq_name, count(*) n_rows, count(DISTINCT r.len) n_distinct, any_value(o.len) mode_length, quantile_disc(r.len, 0.5) median_length,
        CAST(sum(r.len) AS BIGINT) n_bases, min(read_start) extent_start, max(read_end) extent_end FROM r LEFT JOIN o ON r.seq_name = o.seq_name WHERE r.seq_name IS NOT NULL GROUP BY r.seq_name""",
    "p7_found": f"WITH {_INTERVALS} SELECT seq_name, CAST(reach AS INTEGER) gap_start, CAST(lo AS INTEGER) gap_end FROM re WHERE lo > reach",
    "p7_periods": f"""WITH {_INTERVALS}, la AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY seq_name ORDER BY lo) k FROM re)
        SELECT seq_name, min(lo) period_start, max(hi) period_end, count(*) n_starts FROM la GROUP BY seq_name, k""",
}
