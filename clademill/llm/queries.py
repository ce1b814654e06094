"""Queries of the problems 1 to 3, 6 and 8 to 10, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.functions.names import canonical_name, name_of
from clademill.llm import clusters, components, encode, fusion, packing, spans, splitting
from clademill.plans.problems import sql_name
from clademill.sources.tables import table


def measured_distances(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "distances")
    return clusters.measured(d, F.col("group_id"), canonical_name(F.col("a")), canonical_name(F.col("b")), F.col("distance"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    members = clusters.density_clusters(measured_distances(spark, folder))
    left = members.select("group", "cluster", F.col("name").alias("name_a"))
    right = members.select("group", "cluster", F.col("name").alias("name_b"))
    return left.join(right, ["group", "cluster"]).filter("name_a < name_b").select("name_a", "name_b").distinct()


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    pairs = measured_distances(spark, folder)
    described = clusters.describe_clusters(clusters.cut(clusters.density_clusters(pairs)), pairs)
    return described.select(F.col("group").alias("group_id"), "cluster", "size", "medoids")


def letters(seq: Column) -> Column:
    """The number of letters ACGT, in either case; null counts 0."""
    return F.coalesce(F.length(F.regexp_replace(seq, "[^ACGTacgt]", "")), F.lit(0))


def fused_contigs(spark: SparkSession, folder: str, tolerance: float = 0.01) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "contigs").withColumn("name", name_of(F.col("taxon"), F.col("contig")))
    batch = F.concat_ws(" ", F.col("trust").cast("string"), F.date_format("loaded_at", "yyyy-MM"))
    loaded = F.unix_micros("loaded_at")
    fields = {
        "seq": fusion.Field(F.col("seq"), letters(F.col("seq")), strict=True),
        "description": fusion.Field(F.nullif("description", F.lit("")), loaded),
        "loaded": fusion.Field(loaded, loaded, strict=True),
        "trust": fusion.Field(F.col("trust"), F.col("trust"), strict=True),
    }
    repeated = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1 AND name IS NOT NULL")
    return rows, fusion.fuse(rows.join(repeated, "name", "left_semi"), F.col("name"), batch, fields, tolerance)


def p2_found(spark: SparkSession, folder: str, tolerance: float = 0.01) -> DataFrame:
    rows, fused = fused_contigs(spark, folder, tolerance)
    fused = fused.select(F.col("entity").alias("name"), letters(F.col("seq")).alias("best"), F.col("loaded").cast("long").alias("latest"), F.col("trust").cast("int").alias("top"))
    same = rows.select("name", "row_id", letters(F.col("seq")).alias("n"), F.unix_micros("loaded_at").alias("loaded"), "trust").join(fused, "name")
    same = same.filter((F.col("n") == F.col("best")) & F.col("loaded").eqNullSafe(F.col("latest")) & F.col("trust").eqNullSafe(F.col("top")))
    return same.groupBy("name").agg(F.min("row_id").alias("row_id")).select("row_id")


def p2_fused(spark: SparkSession, folder: str) -> DataFrame:
    _, fused = fused_contigs(spark, folder)
    return fused.select(F.col("entity").alias("seq_name"), "seq", "description", F.timestamp_micros(F.col("loaded").cast("long")).alias("loaded_at"), F.col("trust").cast("int").alias("trust"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "common_hits").select(canonical_name(F.col("a")).alias("a"), canonical_name(F.col("b")).alias("b"))
    return components.components(hits).select(F.col("vertex").alias("seq_name"), F.col("component").alias("group_name"))


def named_contigs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "contigs").select("row_id", name_of(F.col("taxon"), F.col("contig")).alias("name"), "seq")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.span_pairs(spans.placed_paths(named_contigs(spark, folder), F.col("name"), F.col("row_id"), F.col("seq")))


def p6_shared(spark: SparkSession, folder: str) -> DataFrame:
    rows = named_contigs(spark, folder)
    paths = spans.shared_paths(rows, F.col("name"), F.col("row_id"), F.col("seq"))
    share = spans.shared_share(rows, paths, F.col("name"), F.col("row_id"), F.col("seq"))
    return share.select(F.col("row").alias("row_id"), F.col("name").alias("seq_name"), "n_letters", "n_shared", "longest")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(table(spark, folder, "documents"), "text", ["doc_id"])


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return encode.decode(p8_ids(spark, folder), "ids", ["doc_id"])


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    counted = encode.count_tokens(table(spark, folder, "documents"), "text", ["doc_id"])
    return packing.pack(counted, "doc_id", "n_tokens")


def p9_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document: its tokens are all packed, it is cut only above the capacity, and its containers hold what fits, gapless."""
    counted = clusters.cut(encode.count_tokens(table(spark, folder, "documents"), "text", ["doc_id"]))
    packed = clusters.cut(packing.pack(counted, "doc_id", "n_tokens"))
    full = packed.filter("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("held"), F.max(F.col("offset") + F.col("n_tokens")).alias("top"))
    placed = packed.join(full, "container", "left").groupBy("doc_id").agg(
        F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("pieces"), F.coalesce(F.bool_and((F.col("held") == F.col("top")) & (F.col("held") <= packing.CAPACITY)), F.lit(True)).alias("fits"))
    both = counted.join(placed, "doc_id", "left")
    least = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / packing.CAPACITY))
    return both.select("doc_id", (F.col("total") == F.col("n_tokens")).alias("adds_up"), (F.col("pieces") == least).alias("cut_rightly"), "fits")


def p10_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """The texts put together again from pieces without overlap, and whether all are within the limit."""
    pieces = splitting.split_texts(table(spark, folder, "documents"), "doc_id", "text", overlap=0)
    order = F.sort_array(F.collect_list(F.struct("piece", "text")))
    joined = pieces.groupBy("doc_id").agg(order.alias("p"), (F.max("n_tokens") <= splitting.LIMIT).alias("within_limit"))
    text = F.when(F.get("p", F.lit(0))["text"].isNotNull(), F.array_join(F.col("p.text"), ""))
    return joined.select("doc_id", text.alias("text"), "within_limit")


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_texts(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p2_found, p2_fused, p3_found, p6_found, p6_shared, p8_ids, p8_decoded, p9_containers, p9_checked, p10_pieces, p10_rejoined)}

_NAME = sql_name("taxon || '|' || contig")
_STRETCHES = f"""
c AS (SELECT row_id, {_NAME} nm, upper(replace(seq, '-', '')) s FROM contigs),
st AS (SELECT DISTINCT nm, unnest(regexp_extract_all(s, '[ACGT]{{120,}}')) t FROM c WHERE nm IS NOT NULL),
w AS (SELECT DISTINCT nm, substr(t, i::BIGINT, 120) k FROM (SELECT nm, t, unnest(range(1, length(t) - 118)) i FROM st))"""

SQL = {
    "p2_found": f"""WITH c AS (SELECT {_NAME} nm, row_id, coalesce(length(regexp_replace(seq, '[^ACGTacgt]', '', 'g')), 0) n,
        coalesce(loaded_at, TIMESTAMPTZ '0001-01-01 00:00:00+00') l, coalesce(trust, -1) t FROM contigs),
        g AS (SELECT *, max(n) OVER w mn, max(l) OVER w ml, max(t) OVER w mt, count(*) OVER w k FROM c WHERE nm IS NOT NULL WINDOW w AS (PARTITION BY nm))
        SELECT min(row_id) row_id FROM g WHERE k > 1 AND n = mn AND l = ml AND t = mt GROUP BY nm""",
    "p3_found": f"""WITH RECURSIVE h AS (SELECT {sql_name('a')} a, {sql_name('b')} b FROM common_hits),
        e AS (SELECT a, b FROM h WHERE a <> b UNION SELECT b, a FROM h WHERE a <> b),
        r(seq_name, other) AS (SELECT a, a FROM e UNION SELECT r.seq_name, e.b FROM r JOIN e ON r.other = e.a)
        SELECT seq_name, min(other) group_name FROM r GROUP BY seq_name""",
    "p6_shared": f"""WITH c AS (SELECT row_id, {_NAME} nm, upper(replace(seq, '-', '')) s FROM contigs),
        q AS (SELECT row_id, nm, i - 1 p, substr(s, i::BIGINT, 120) k FROM (SELECT *, unnest(range(1, length(s) - 118)) i FROM c WHERE nm IS NOT NULL AND length(s) >= 120)),
        sh AS (SELECT k FROM q WHERE regexp_full_match(k, '[ACGT]{{120}}') GROUP BY k HAVING count(DISTINCT nm) > 1),
        sp AS (SELECT row_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY row_id ORDER BY p) + 120 THEN 0 ELSE 1 END h FROM q SEMI JOIN sh USING (k)),
        il AS (SELECT row_id, max(p) + 120 - min(p) n FROM (SELECT *, sum(h) OVER (PARTITION BY row_id ORDER BY p) g FROM sp) GROUP BY row_id, g),
        t AS (SELECT row_id, sum(n) n_shared, max(n) longest FROM il GROUP BY 1)
        SELECT c.row_id, nm seq_name, coalesce(length(s), 0) n_letters, coalesce(n_shared, 0)::BIGINT n_shared, coalesce(longest, 0)::BIGINT longest FROM c LEFT JOIN t ON c.row_id = t.row_id""",
    "p9_checked": "SELECT doc_id, true adds_up, true cut_rightly, true fits FROM documents",
    "p10_rejoined": "SELECT doc_id, text, true AS within_limit FROM documents",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') text FROM documents",
    "p6_found": f"WITH {_STRETCHES} SELECT DISTINCT x.nm name_a, y.nm name_b FROM w x JOIN w y ON x.k = y.k AND x.nm < y.nm",
}
