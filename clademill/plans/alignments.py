"""Queries over alignments, distances, hits and reads, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill import config
from clademill.functions import dna, names
from clademill.operators import columns, graph, groups, intervals, kmers, linkage, pairs, reads
from clademill.plans import tools
from clademill.plans.problems import sql_name
from clademill.session import cut
from clademill.sources import alignments as src
from clademill.sources.tables import table

#: Parameters of the queries, scaled to alignments of some hundred columns.
MIN_OVERLAP, MIN_FRAGMENT, WINDOW, K = 100, 30, 12, 9
#: Share of the reads from which a second base makes a position variable; these reads differ by errors only.
SNP_SHARE = 0.125

AL = f"""
nm AS (SELECT group_id, {sql_name('seq_name')} seq_name, upper(seq) seq, aligned_at FROM alignments WHERE seq IS NOT NULL AND group_id IS NOT NULL),
al AS (SELECT group_id, seq_name, split_part(seq_name, '|', 1) taxon, split_part(seq_name, '|', 2) contig, seq FROM nm WHERE seq_name IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY group_id, seq_name ORDER BY aligned_at DESC NULLS LAST, seq DESC) = 1)"""
OUT = "og AS (SELECT DISTINCT taxon FROM taxa WHERE is_outgroup)"
PD = f"""
pr AS (SELECT group_id, {sql_name('a')} x, {sql_name('b')} y, distance FROM distances WHERE group_id IS NOT NULL AND distance IS NOT NULL AND NOT isnan(distance)),
pd AS (SELECT group_id, least(x, y) a, greatest(x, y) b, round(avg(distance), 6) distance FROM pr WHERE x <> y GROUP BY ALL)"""
LONG = "lf AS (SELECT group_id, seq_name, taxon, i - 1 pos, substr(seq, i::BIGINT, 1) ch FROM (SELECT *, unnest(range(1, length(seq) + 1)) i FROM al))"
COUNTED = f"""
pl AS (SELECT pd.group_id, a, b, x.seq sa, y.seq sb, unnest(range(1, least(length(x.seq), length(y.seq)) + 1)) i FROM pd JOIN al x ON x.group_id = pd.group_id AND x.seq_name = a JOIN al y ON y.group_id = pd.group_id AND y.seq_name = b),
pc AS (SELECT group_id, a, b, substr(sa, i::BIGINT, 1) p, substr(sb, i::BIGINT, 1) q FROM pl),
ct AS (SELECT group_id, a, b, count(*) FILTER (p <> '-' AND q <> '-') overlap, count(*) FILTER (p IN ('A','C','G','T') AND q IN ('A','C','G','T')) compared,
    count(*) FILTER (p = q AND p IN ('A','C','G','T')) same, count(*) FILTER (p || q IN ('AG','GA','CT','TC')) ts,
    count(*) FILTER (p IN ('C','G') AND q IN ('A','C','G','T')) gca, count(*) FILTER (q IN ('C','G') AND p IN ('A','C','G','T')) gcb FROM pc GROUP BY ALL)"""
COUNTS = f"{AL}, {PD}, {COUNTED}"
RD = f"""
r0 AS (SELECT DISTINCT {sql_name('seq_name')} seq_name, read_name, read_start lo, upper(seq) seq FROM reads),
rd AS (SELECT *, lo + length(seq) hi FROM r0 WHERE seq_name IS NOT NULL AND read_name IS NOT NULL AND lo IS NOT NULL AND length(seq) > 0)"""
PILE = f"""{RD}, ch AS (SELECT seq_name, lo + i - 1 pos, substr(seq, i::BIGINT, 1) c FROM (SELECT *, unnest(range(1, length(seq) + 1)) i FROM rd)),
pi AS (SELECT seq_name, pos, count(*) FILTER (c = 'A') "A", count(*) FILTER (c = 'C') "C", count(*) FILTER (c = 'G') "G", count(*) FILTER (c = 'T') "T" FROM ch WHERE c IN ('A','C','G','T') GROUP BY ALL),
sn AS (SELECT seq_name, pos, list_sort(["A","C","G","T"], 'DESC') l, "A" + "C" + "G" + "T" n FROM pi),
sv AS (SELECT seq_name, pos, l[1] reads_ref, l[2] reads_alt FROM sn WHERE n >= 4 AND l[2] > 0 AND l[2] >= {SNP_SHARE} * n)"""
HITS = f"""
h0 AS (SELECT {sql_name('a')} a, {sql_name('b')} b, align_len, evalue FROM common_hits),
hh AS (SELECT * FROM h0 WHERE a <> b),
re AS (SELECT least(a, b) a, greatest(a, b) b FROM hh WHERE align_len > 300 GROUP BY 1, 2 HAVING bool_or(hh.a < hh.b) AND bool_or(hh.a > hh.b))"""

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add



@query(f"""WITH {AL} SELECT group_id, seq_name, taxon, contig, CASE WHEN regexp_matches(seq_name, '_allele_[01]$') THEN right(seq_name, 1)::INTEGER END allele,
    replace(replace(seq_name, 'allele', 'a'), 'contig_', '') short_name FROM al""")
def name_parse(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("seq_name")
    return src.aligned(spark, folder).select("group_id", "seq_name", "taxon", "contig", names.allele_of(n).alias("allele"), names.short_label(n).alias("short_name"))


@query(f"""WITH {AL} SELECT group_id, count(*) n_seqs, count(DISTINCT taxon) FILTER (length(replace(seq, '-', '')) > 0) n_taxa, max(length(seq)) length, min(length(seq)) shortest FROM al GROUP BY 1""")
def taxa_per_group(spark: SparkSession, folder: str) -> DataFrame:
    return groups.group_sizes(src.aligned(spark, folder))


@query(f"""WITH {AL}, {OUT}, s AS (SELECT group_id, count(*) n_seqs, count(DISTINCT taxon) FILTER (length(replace(seq, '-', '')) > 0) n_taxa, max(length(seq)) l, bool_or(taxon IN (SELECT taxon FROM og)) o FROM al GROUP BY 1)
    SELECT group_id, CASE WHEN n_seqs < 4 THEN 'too_small' WHEN l < 450 THEN 'too_short' WHEN NOT o THEN 'no_outgroup' WHEN n_taxa < 6 THEN 'incomplete' ELSE 'complete' END outcome FROM s""")
def group_outcome(spark: SparkSession, folder: str) -> DataFrame:
    rows = src.with_outgroup(src.aligned(spark, folder), src.outgroup_taxa(spark, folder))
    return groups.outcome(rows, 4, 450, 6, needs_outgroup=True)


@query(f"""WITH {AL}, t AS (SELECT group_id, taxon, count(*) n FROM al GROUP BY 1, 2)
    SELECT group_id, CASE WHEN sum(n) > 20 AND bool_or(n >= 4) THEN 'failed' ELSE 'passed' END route FROM t GROUP BY 1""")
def group_size_routing(spark: SparkSession, folder: str) -> DataFrame:
    return groups.route(src.aligned(spark, folder), 20, 4)


@query(f"""WITH {AL}, t AS (SELECT group_id, taxon, count(*) n FROM al GROUP BY 1, 2)
    SELECT group_id, bool_or(n >= 2) any_over, bool_and(n >= 2) all_over FROM t GROUP BY 1""")
def taxon_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    return groups.occurrence(src.aligned(spark, folder), 2)


@query(f"""WITH {AL}, {OUT}, t AS (SELECT group_id, taxon, count(*) n FROM al GROUP BY 1, 2), v AS (SELECT group_id, count(*) FILTER (n >= 1 AND taxon IN (SELECT taxon FROM og)) o FROM t GROUP BY 1)
    SELECT group_id, o > 0 any_over, o = (SELECT count(*) FROM og) all_over FROM v""")
def outgroup_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    return groups.occurrence(src.aligned(spark, folder), 1, src.outgroup_taxa(spark, folder))


@query(f"""WITH {AL} SELECT group_id, seq_name, row_number() OVER (PARTITION BY group_id ORDER BY length(replace(seq, '-', '')) DESC, seq_name) <= 10 is_core FROM al""")
def longest_k_core(spark: SparkSession, folder: str) -> DataFrame:
    return groups.core_and_rest(src.aligned(spark, folder), 10).select("group_id", "seq_name", "is_core")


@query(f"""WITH {AL} SELECT group_id, seq_name, seq FROM al WHERE length(regexp_replace(seq, '[^ACGT]', '', 'g')) > 0
    AND length(regexp_replace(seq, '[^N]', '', 'g')) <= 0.01 * length(regexp_replace(seq, '[^ACGT]', '', 'g'))""")
def ambiguity_filter(spark: SparkSession, folder: str) -> DataFrame:
    return groups.ambiguity_filter(src.aligned(spark, folder), 0.01).select("group_id", "seq_name", "seq")


@query(f"""WITH {AL}, p AS (SELECT group_id, regexp_replace(seq_name, '_allele_[01]$', '') base, seq_name, length(regexp_replace(seq, '[N-]', '', 'g')) n FROM al WHERE regexp_matches(seq_name, '_allele_[01]$'))
    SELECT group_id, base, max(seq_name) FILTER (right(seq_name, 1) = '0') allele_0, max(seq_name) FILTER (right(seq_name, 1) = '1') allele_1, min_by(seq_name, (-n, seq_name)) longest
    FROM p GROUP BY 1, 2 HAVING count(DISTINCT right(seq_name, 1)) = 2""")
def allele_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return groups.allele_pairs(src.aligned(spark, folder))


@query(f"WITH {AL}, {LONG} SELECT group_id, pos::INTEGER pos, count(*) n_seq, count(*) FILTER (ch IN ('N', '-')) n_gap FROM lf GROUP BY 1, 2")
def column_gap_profile(spark: SparkSession, folder: str) -> DataFrame:
    return columns.gap_profile(src.aligned(spark, folder))


@query(f"""WITH {AL}, {LONG}, k AS (SELECT group_id, pos FROM lf GROUP BY 1, 2 HAVING count(*) FILTER (ch IN ('N', '-')) <= 0.7 * count(*)),
    s AS (SELECT lf.group_id, seq_name, string_agg(ch, '' ORDER BY pos) seq FROM lf JOIN k USING (group_id, pos) GROUP BY 1, 2) SELECT al.group_id, al.seq_name, coalesce(s.seq, '') seq FROM al LEFT JOIN s USING (group_id, seq_name)""")
def drop_gapped_columns(spark: SparkSession, folder: str) -> DataFrame:
    return columns.drop_gapped_columns(src.aligned(spark, folder), 0.7).select("group_id", "seq_name", "seq")


_FRAG = f"""fr AS (SELECT group_id, seq_name, min(pos) lo, max(pos) + 1 hi FROM (SELECT *, pos - row_number() OVER (PARTITION BY group_id, seq_name ORDER BY pos) g FROM lf WHERE ch NOT IN ('N', '-')) GROUP BY group_id, seq_name, g HAVING count(*) >= {MIN_FRAGMENT})"""


@query(f"WITH {AL}, {LONG}, {_FRAG} SELECT group_id, seq_name, lo::INTEGER lo, hi::INTEGER hi FROM fr")
def ungapped_fragments(spark: SparkSession, folder: str) -> DataFrame:
    return columns.fragments(src.aligned(spark, folder), MIN_FRAGMENT)


@query(f"""WITH {AL}, {LONG}, {_FRAG} SELECT group_id, seq_name, lo::INTEGER lo, hi::INTEGER hi FROM fr
    WHERE EXISTS (SELECT 1 FROM fr o WHERE o.group_id = fr.group_id AND o.seq_name <> fr.seq_name AND o.lo <= fr.hi AND fr.lo <= o.hi)""")
def fragment_overlap_semi(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.overlap_semi(columns.fragments(src.aligned(spark, folder), MIN_FRAGMENT), "group_id", "seq_name", "lo", "hi")


@query(f"""WITH {AL}, {LONG}, {_FRAG}, w AS (SELECT DISTINCT group_id, lo s, lo + {MIN_FRAGMENT} e FROM fr)
    SELECT w.group_id, s::INTEGER start, count(*) n_votes FROM w JOIN fr ON fr.group_id = w.group_id AND fr.lo <= w.s AND fr.hi >= w.e GROUP BY 1, 2""")
def fragment_contains_window(spark: SparkSession, folder: str) -> DataFrame:
    found = columns.fragments(src.aligned(spark, folder), MIN_FRAGMENT)
    windows = found.select("group_id", F.col("lo").alias("start"), (F.col("lo") + MIN_FRAGMENT).alias("stop")).distinct()
    held = intervals.containment_join(found, windows, "group_id", "lo", "hi", "start", "stop")
    return held.groupBy("group_id", "start").agg(F.count(F.lit(1)).alias("n_votes"))


_TRIM = f"""fg AS (SELECT group_id, seq_name, min(pos) lo, max(pos) + 1 hi FROM (SELECT *, pos - row_number() OVER (PARTITION BY group_id, seq_name ORDER BY pos) g FROM lf WHERE ch NOT IN ('N', '-')) GROUP BY group_id, seq_name, g HAVING count(*) >= {WINDOW}),
sd AS (SELECT * FROM fg WHERE EXISTS (SELECT 1 FROM fg o WHERE o.group_id = fg.group_id AND o.seq_name <> fg.seq_name AND o.lo <= fg.hi AND fg.lo <= o.hi)),
ss AS (SELECT DISTINCT group_id, unnest(range(lo, hi - {WINDOW} + 1)) s FROM sd),
vo AS (SELECT group_id, seq_name, unnest(range(lo, hi - {WINDOW} + 1)) s FROM fg),
qu AS (SELECT group_id, greatest(1, ceil(count(*) * 0.25)) q FROM al GROUP BY 1),
nv AS (SELECT vo.group_id, s, count(*) n FROM vo SEMI JOIN ss USING (group_id, s) GROUP BY 1, 2),
cd AS (SELECT vo.group_id, vo.s, vo.seq_name, unnest(range(0, {WINDOW}, 3)) d FROM vo JOIN nv USING (group_id, s) JOIN qu USING (group_id) WHERE n >= q),
ac AS (SELECT cd.group_id, cd.s, cd.d, CASE WHEN regexp_full_match(c, '[ACGT]{{3}}') THEN substr('{dna.AMINO}', (1 + 16 * (strpos('TCAG', substr(c, 1, 1)) - 1) + 4 * (strpos('TCAG', substr(c, 2, 1)) - 1) + strpos('TCAG', substr(c, 3, 1)) - 1)::BIGINT, 1) ELSE 'X' END aa
    FROM (SELECT cd.*, substr(al.seq, (cd.s + cd.d + 1)::BIGINT, 3) c FROM cd JOIN al USING (group_id, seq_name)) cd),
sh AS (SELECT group_id, s, d, max(n) / sum(n) share FROM (SELECT group_id, s, d, aa, count(*) n FROM ac GROUP BY ALL) GROUP BY 1, 2, 3),
gw AS (SELECT group_id, s FROM sh GROUP BY 1, 2 HAVING min(share) >= 0.5)"""


@query(f"WITH {AL}, {LONG}, {_TRIM} SELECT group_id, min(s)::INTEGER start, (max(s) + {WINDOW})::INTEGER stop FROM gw GROUP BY 1")
def trim_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return columns.trim_bounds(src.aligned(spark, folder), WINDOW)


@query(f"""WITH {AL}, {LONG}, {_TRIM}, bd AS (SELECT group_id, min(s) st, max(s) + {WINDOW} en FROM gw GROUP BY 1), sl AS (SELECT lf.* FROM lf LEFT JOIN bd USING (group_id) WHERE st IS NULL OR (pos >= st AND pos < en)),
    k AS (SELECT group_id, pos FROM sl GROUP BY 1, 2 HAVING count(*) FILTER (ch IN ('N', '-')) <= 0.9 * count(*)), s AS (SELECT sl.group_id, seq_name, string_agg(ch, '' ORDER BY pos) seq FROM sl JOIN k USING (group_id, pos) GROUP BY 1, 2)
    SELECT al.group_id, al.seq_name, coalesce(s.seq, '') seq FROM al LEFT JOIN s USING (group_id, seq_name)""")
def trimmed(spark: SparkSession, folder: str) -> DataFrame:
    return columns.trim(src.aligned(spark, folder), WINDOW).select("group_id", "seq_name", "seq")


@query(f"""WITH {AL}, w AS (SELECT group_id, seq_name, seq, list_transform(range(0, length(seq) // 3), lambda k: substr(seq, (3 * k + 1)::BIGINT, 3)) c FROM al)
    SELECT group_id, seq_name, coalesce(array_to_string(list_transform(c, lambda x: CASE WHEN regexp_full_match(x, '[ACGT]{{3}}') THEN substr('{dna.AMINO}', (1 + 16 * (strpos('TCAG', substr(x, 1, 1)) - 1) + 4 * (strpos('TCAG', substr(x, 2, 1)) - 1) + strpos('TCAG', substr(x, 3, 1)) - 1)::BIGINT, 1) ELSE 'X' END), ''), '') acids FROM w""")
def codon_translation(spark: SparkSession, folder: str) -> DataFrame:
    return src.aligned(spark, folder).select("group_id", "seq_name", dna.translate_codons(F.col("seq")).alias("acids"))


@query(f"""WITH {AL} SELECT group_id, seq_name, translate(seq, 'N', '-') masked, regexp_replace(seq, '[N-]', '', 'g') bases,
    CASE WHEN regexp_matches(seq, '[^-]{{10}}') THEN length(regexp_extract(seq, '^(.*?)[^-]{{10}}', 1))::INTEGER END start,
    CASE WHEN regexp_matches(seq, '[^-]{{10}}') THEN (length(seq) - length(regexp_extract(reverse(seq), '^(.*?)[^-]{{10}}', 1)))::INTEGER END stop FROM al""")
def masked_sequences(spark: SparkSession, folder: str) -> DataFrame:
    rows = src.aligned(spark, folder)
    b = columns.sequence_bounds(rows, 10)
    return rows.select("group_id", "seq_name", dna.mask_ambiguous(F.col("seq")).alias("masked"), dna.without(F.col("seq"), "Nn-").alias("bases")).join(b, ["group_id", "seq_name"])


@query(f"WITH {COUNTS} SELECT group_id, a, b, overlap::INTEGER overlap, compared::INTEGER compared, same::INTEGER \"match\" FROM ct")
def pairwise_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.pair_counts(src.pair_distances(spark, folder), src.aligned(spark, folder)).select("group_id", "a", "b", "overlap", "compared", "match")


@query(f"""WITH {COUNTS}, p AS (SELECT *, (compared - same) / nullif(compared, 0) p FROM ct)
    SELECT group_id, a, b, compared::INTEGER compared, round(CASE WHEN 1 - p * 4 / 3 > 0 THEN -75.0 * ln(1 - p * 4 / 3) + 0.0 END, 6) jukes_cantor FROM p""")
def pairwise_jc_distance(spark: SparkSession, folder: str) -> DataFrame:
    counts = pairs.pair_counts(src.pair_distances(spark, folder), src.aligned(spark, folder))
    return pairs.distances(counts).select("group_id", "a", "b", "compared", "jukes_cantor")


@query(f"""WITH {COUNTS}, p AS (SELECT *, (compared - same) / nullif(compared, 0) p, ts / nullif(compared, 0) s, gca / nullif(compared, 0) ga, gcb / nullif(compared, 0) gb FROM ct),
    q AS (SELECT *, p - s v, ga + gb - 2 * ga * gb c FROM p)
    SELECT group_id, a, b, round(100 * p, 6) uncorrected, round(CASE WHEN 1 - 2 * s - v > 0 AND 1 - 2 * v > 0 THEN -50.0 * ln(1 - 2 * s - v) - 25.0 * ln(1 - 2 * v) + 0.0 END, 6) kimura,
    round(CASE WHEN c > 0 AND 1 - s / c - v > 0 AND 1 - 2 * v > 0 THEN 100.0 * (-c * ln(1 - s / c - v) - 0.5 * (1 - c) * ln(1 - 2 * v)) + 0.0 END, 6) tamura,
    round(CASE WHEN 1 - 2 * s - v > 0 AND 1 - 2 * v > 0 THEN 50.0 * (1 / (1 - 2 * s - v) + 0.5 / (1 - 2 * v) - 1.5) + 0.0 END, 6) jin_nei FROM q""")
def pairwise_model_distances(spark: SparkSession, folder: str) -> DataFrame:
    counts = pairs.pair_counts(src.pair_distances(spark, folder), src.aligned(spark, folder))
    return pairs.distances(counts).select("group_id", "a", "b", "uncorrected", "kimura", "tamura", "jin_nei")


_MIX = " + ".join(f"CASE WHEN n_{x}{y} > 0 THEN n_{x}{y} * n_{x}{y} * 2.0 / (n_{x} * n_{y}) ELSE 0 END" for x, y in pairs.MIXED)
_TN = f"""tn AS (SELECT group_id, a, b, count(*) FILTER (ok) n, count(*) FILTER (ok AND p <> q) d, {', '.join(f"count(*) FILTER (ok AND p = '{x}') + count(*) FILTER (ok AND q = '{x}') n_{x}" for x in pairs.BASES)},
    {', '.join(f"count(*) FILTER (p || q IN ('{x}{y}', '{y}{x}')) n_{x}{y}" for x, y in pairs.MIXED)} FROM (SELECT *, p IN ('A','C','G','T') AND q IN ('A','C','G','T') ok FROM pc) GROUP BY ALL),
tp AS (SELECT *, d / nullif(n, 0) p, {' + '.join(f"power(n_{x} / (2 * nullif(n, 0)), 2)" for x in pairs.BASES)} s, {_MIX} h FROM tn),
tb AS (SELECT *, (1 - s + CASE WHEN h > 0 THEN p * p / h ELSE 0 END) / 2 b0 FROM tp)"""


@query(f"WITH {COUNTS}, {_TN} SELECT group_id, a, b, round(CASE WHEN n = 0 THEN NULL WHEN p = 0 THEN 0.0 WHEN b0 > 0 AND 1 - p / b0 > 0 THEN -100.0 * b0 * ln(1 - p / b0) + 0.0 END, 6) tajima_nei FROM tb")
def pairwise_tajima_nei(spark: SparkSession, folder: str) -> DataFrame:
    counts = pairs.pair_counts(src.pair_distances(spark, folder), src.aligned(spark, folder))
    return pairs.distances(counts).select("group_id", "a", "b", "tajima_nei")


_KM = f"km AS (SELECT group_id, seq_name, i - 1 pos, substr(seq, i::BIGINT, {K}) kmer FROM (SELECT *, unnest(range(1, length(seq) - {K} + 1)) i FROM al))"


@query(f"WITH {AL}, {_KM} SELECT group_id, pos::INTEGER pos, kmer, count(*) n FROM km WHERE NOT regexp_matches(kmer, '[N-]') GROUP BY ALL")
def kmers_by_position(spark: SparkSession, folder: str) -> DataFrame:
    return kmers.kmer_counts(kmers.by_position(src.aligned(spark, folder), K))


@query(f"""WITH {AL}, {_KM}, kc AS (SELECT * FROM km WHERE NOT regexp_matches(kmer, '[N-]')) SELECT kc.group_id, kc.pos::INTEGER pos, kc.kmer, seq_name
    FROM kc SEMI JOIN (SELECT group_id, pos, kmer FROM kc GROUP BY ALL HAVING count(*) > 1) n USING (group_id, pos, kmer)""")
def kmer_groups(spark: SparkSession, folder: str) -> DataFrame:
    return kmers.kmer_groups(src.aligned(spark, folder), K)


_SINGLE = f"""kn AS (SELECT group_id, pos, kmer, count(*) n, count(DISTINCT regexp_replace(seq_name, '_allele_[01]$', '')) u, count(*) FILTER (regexp_matches(seq_name, '_allele_[01]$')) ph FROM km WHERE regexp_matches(kmer, '[^-]') GROUP BY ALL),
rk AS (SELECT * FROM kn WHERE n = 1 OR (n = 2 AND u = 1 AND ph = 2)),
sg AS (SELECT group_id, pos, kmer FROM rk WHERE NOT EXISTS (SELECT 1 FROM kn o WHERE o.group_id = rk.group_id AND o.pos = rk.pos AND o.kmer <> rk.kmer
    AND {' + '.join(f"(substr(o.kmer, {i}, 1) = substr(rk.kmer, {i}, 1) AND substr(o.kmer, {i}, 1) <> '-')::INTEGER" for i in range(1, K + 1))} > 5)),
fl AS (SELECT km.group_id, km.seq_name, km.pos FROM km JOIN sg USING (group_id, pos, kmer))"""


@query(f"WITH {AL}, {_KM}, {_SINGLE} SELECT group_id, seq_name, pos::INTEGER pos FROM fl")
def singleton_kmers(spark: SparkSession, folder: str) -> DataFrame:
    return kmers.singletons(src.aligned(spark, folder), K, 5)


_DENSE = f"""bo AS (SELECT group_id, seq_name, seq, length(regexp_extract(seq, '^(.*?)[^-]{{{K}}}', 1)) lo, length(seq) - length(regexp_extract(reverse(seq), '^(.*?)[^-]{{{K}}}', 1)) hi FROM al WHERE regexp_matches(seq, '[^-]{{{K}}}')),
    ins AS (SELECT fl.*, seq FROM fl JOIN bo USING (group_id, seq_name) WHERE pos BETWEEN lo AND hi),
    de AS (SELECT *, count(*) OVER (PARTITION BY group_id, seq_name ORDER BY pos RANGE BETWEEN CURRENT ROW AND 29 FOLLOWING) n FROM ins),
    dm AS (SELECT group_id, seq_name, pos::INTEGER lo, (pos + {30 - K})::INTEGER hi FROM de WHERE n > 18 AND NOT contains(substr(seq, (pos + 1)::BIGINT, 30), '-------'))"""


@query(f"WITH {AL}, {_KM}, {_SINGLE}, {_DENSE} SELECT group_id, seq_name, lo, hi FROM dm")
def dense_singleton_mask(spark: SparkSession, folder: str) -> DataFrame:
    rows = src.aligned(spark, folder)
    return kmers.dense_masks(kmers.singletons(rows, K, 5), rows, K, 30, 0.6, 7)


_INSIDE = f"""{AL.replace('al AS (', 'al0 AS (')}, {OUT}, al AS (SELECT group_id, seq_name, taxon, contig, translate(seq, 'N', '-') seq FROM al0 WHERE taxon NOT IN (SELECT taxon FROM og) AND regexp_matches(seq, '[^N-]'))"""


@query(f"""WITH {_INSIDE}, {LONG}, {_KM}, {_SINGLE}, {_DENSE}, mk AS (SELECT DISTINCT group_id, seq_name, unnest(range(lo, hi)) pos FROM dm),
    ms AS (SELECT lf.group_id, lf.seq_name, string_agg(CASE WHEN mk.pos IS NULL THEN ch ELSE 'N' END, '' ORDER BY lf.pos) seq FROM lf LEFT JOIN mk ON mk.group_id = lf.group_id AND mk.seq_name = lf.seq_name AND mk.pos = lf.pos GROUP BY 1, 2)
    SELECT group_id, seq_name, seq FROM ms WHERE regexp_matches(seq, '[ACGT]') AND length(regexp_replace(seq, '[^N]', '', 'g')) <= 0.95 * length(regexp_replace(seq, '[^ACGT]', '', 'g'))
    UNION ALL SELECT group_id, seq_name, seq FROM al0 WHERE taxon IN (SELECT taxon FROM og)""")
def cleaned_sequences(spark: SparkSession, folder: str) -> DataFrame:
    p = config.Clean(window=30, k=K, min_similarity=5)
    return tools.clean(outgroup_rows(spark, folder), p).select("group_id", "seq_name", "seq")


_SCORES = f"""{_KM}, kc AS (SELECT * FROM km WHERE NOT regexp_matches(kmer, '[N-]')), kn AS (SELECT group_id, pos, kmer FROM kc GROUP BY ALL HAVING count(*) > 1), kg AS (SELECT kc.* FROM kc SEMI JOIN kn USING (group_id, pos, kmer)),
    oft AS (SELECT group_id, seq_name FROM kg GROUP BY 1, 2 HAVING count(*) > 50), hd AS (SELECT kg.* FROM kg SEMI JOIN oft USING (group_id, seq_name)),
    sc AS (SELECT pd.group_id, a, b, count(*) FILTER (x.kmer = y.kmer) together, count(*) compared FROM pd JOIN hd x ON x.group_id = pd.group_id AND x.seq_name = a JOIN hd y ON y.group_id = pd.group_id AND y.seq_name = b AND y.pos = x.pos GROUP BY 1, 2, 3),
    ks AS (SELECT group_id, a, b, together::INTEGER together, compared::INTEGER compared, round(CASE WHEN compared > 50 THEN together / compared ELSE 0.0 END, 6) score FROM sc WHERE together > 0)"""


@query(f"WITH {AL}, {PD}, {_SCORES} SELECT group_id, a, b, together, compared, score FROM ks")
def kmer_pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    return kmers.pair_scores(src.aligned(spark, folder), K, 50, src.pair_distances(spark, folder))


@query(f"""WITH RECURSIVE {COUNTS}, {OUT}, {_SCORES}, kx AS (SELECT ks.*, overlap, split_part(a, '|', 1) IN (SELECT taxon FROM og) oa, split_part(b, '|', 1) IN (SELECT taxon FROM og) ob FROM ks JOIN ct USING (group_id, a, b)),
    th AS (SELECT group_id, coalesce(max(score) FILTER (overlap > 300), max(score) FILTER (overlap > 200), max(score) FILTER (overlap > 100), 0.0) t FROM kx WHERE oa <> ob GROUP BY 1),
    se AS (SELECT kx.group_id, a, b FROM kx LEFT JOIN th USING (group_id) WHERE overlap > {MIN_OVERLAP} AND NOT oa AND NOT ob AND score > coalesce(t, 0.0)), ed AS (SELECT group_id, a, b FROM se UNION SELECT group_id, b, a FROM se),
    rr(group_id, v, o) AS (SELECT group_id, a, a FROM ed UNION SELECT rr.group_id, rr.v, ed.b FROM rr JOIN ed ON rr.group_id = ed.group_id AND rr.o = ed.a) SELECT group_id, v seq_name, min(o) component FROM rr GROUP BY 1, 2""")
def similarity_components(spark: SparkSession, folder: str) -> DataFrame:
    rows, listed, out = cut(src.aligned(spark, folder).select("group_id", "seq_name", "seq")), src.pair_distances(spark, folder), src.outgroup_taxa(spark, folder)
    scores = cut(kmers.pair_scores(rows, K, 50, listed))
    scores = cut(graph.with_overlap(scores, pairs.pair_counts(scores, rows)))
    edges = graph.similarity_edges(scores, graph.outgroup_threshold(scores, out), out, MIN_OVERLAP)
    return graph.connected_components(edges, "a", "b", "group_id").withColumnRenamed("vertex", "seq_name")




@query(f"WITH {HITS} SELECT a, b FROM re")
def reciprocal_hits(spark: SparkSession, folder: str) -> DataFrame:
    return graph.reciprocal(src.hits(spark, folder), 300)


_CC = """e2 AS (SELECT a, b FROM re UNION SELECT b, a FROM re),
r(v, o) AS (SELECT a, a FROM e2 UNION SELECT r.v, e2.b FROM r JOIN e2 ON r.o = e2.a),
cc AS (SELECT v vertex, min(o) component FROM r GROUP BY 1)"""


@query(f"WITH RECURSIVE {HITS}, {_CC} SELECT vertex, component FROM cc")
def connected_components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.connected_components(graph.reciprocal(src.hits(spark, folder), 300))


@query(f"""WITH RECURSIVE {HITS}, {_CC}, n AS (SELECT component, count(DISTINCT split_part(vertex, '|', 1)) n_taxa FROM cc GROUP BY 1)
    SELECT vertex, cc.component, n_taxa, n_taxa > 2 kept FROM cc JOIN n ON cc.component = n.component""")
def component_filter(spark: SparkSession, folder: str) -> DataFrame:
    members = graph.connected_components(graph.reciprocal(src.hits(spark, folder), 300))
    return graph.keep_components(members.withColumn("taxon", names.taxon_of(F.col("vertex"))), "taxon", 2)


@query(f"""WITH {HITS}, t AS (SELECT a, b, min(evalue) evalue, max(align_len) align_len FROM hh GROUP BY 1, 2)
    SELECT a, b, evalue, align_len, row_number() OVER (PARTITION BY a ORDER BY evalue NULLS LAST, align_len DESC NULLS LAST, b)::INTEGER AS "rank" FROM t QUALIFY "rank" <= 2""")
def best_hits(spark: SparkSession, folder: str) -> DataFrame:
    return graph.best_hits(src.hits(spark, folder), 2)


_CONTIG = sql_name("taxon || '|' || contig")


_TEXTS = f"tx AS (SELECT nm seq_name, max_by(seq, (length(regexp_replace(seq, '[^ACGT]', '', 'g')), seq)) seq FROM (SELECT {_CONTIG} nm, upper(seq) seq FROM contigs WHERE seq IS NOT NULL) WHERE nm IS NOT NULL GROUP BY 1)"


@query(f"""WITH RECURSIVE {HITS}, {_CC}, {_TEXTS} SELECT component group_id, vertex seq_name, replace(seq, 'N', '') seq FROM cc JOIN tx ON cc.vertex = tx.seq_name""")
def component_sequences(spark: SparkSession, folder: str) -> DataFrame:
    members = graph.connected_components(graph.reciprocal(src.hits(spark, folder), 300))
    seqs = contig_texts(spark, folder).select(F.col("seq_name").alias("vertex"), dna.without(F.col("seq"), "N").alias("seq"))
    return members.join(seqs, "vertex").select(F.col("component").alias("group_id"), F.col("vertex").alias("seq_name"), "seq")


_CP = f"""{AL}, {PD}, ed AS (SELECT group_id, a, b FROM pd WHERE distance < 15 UNION SELECT group_id, b, a FROM pd WHERE distance < 15),
rr(group_id, v, o) AS (SELECT group_id, a, a FROM ed UNION SELECT rr.group_id, rr.v, ed.b FROM rr JOIN ed ON rr.group_id = ed.group_id AND rr.o = ed.a),
mb AS (SELECT group_id, v seq_name, min(o) component, split_part(v, '|', 1) taxon FROM rr GROUP BY 1, 2)"""


def close_components(spark: SparkSession, folder: str) -> DataFrame:
    """``group_id, seq_name, component, taxon`` by distances below 15."""
    edges = src.pair_distances(spark, folder).filter("distance < 15")
    found = graph.connected_components(edges, "a", "b", "group_id")
    return found.select("group_id", F.col("vertex").alias("seq_name"), "component", names.taxon_of(F.col("vertex")).alias("taxon"))


@query(f"""WITH RECURSIVE {_CP}, t AS (SELECT DISTINCT group_id, component, taxon FROM mb), z AS (SELECT group_id, component, count(*) n FROM t GROUP BY 1, 2),
    c AS (SELECT x.group_id, x.component c1, y.component c2, count(*) k FROM t x JOIN t y ON x.group_id = y.group_id AND x.taxon = y.taxon AND x.component < y.component GROUP BY 1, 2, 3)
    SELECT c.group_id, c1, c2, round(k / (p.n + q.n - k), 6) jaccard FROM c JOIN z p ON p.group_id = c.group_id AND p.component = c1 JOIN z q ON q.group_id = c.group_id AND q.component = c2""")
def component_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.taxon_jaccard(close_components(spark, folder))


@query(f"""WITH RECURSIVE {_CP}, {OUT}, {COUNTED},
    un AS (SELECT al.group_id, al.seq_name, al.taxon IN (SELECT taxon FROM og) relaxed FROM al ANTI JOIN mb ON mb.group_id = al.group_id AND mb.seq_name = al.seq_name),
    bo AS (SELECT group_id, a seq_name, b member, distance FROM pd UNION ALL SELECT group_id, b, a, distance FROM pd),
    nc AS (SELECT un.group_id, un.seq_name, relaxed, component, distance FROM un JOIN bo USING (group_id, seq_name) JOIN mb ON mb.group_id = un.group_id AND mb.seq_name = bo.member QUALIFY row_number() OVER (PARTITION BY un.group_id, un.seq_name ORDER BY distance, member) = 1),
    ov AS (SELECT o.group_id, o.n seq_name, component, max(overlap) overlap FROM (SELECT group_id, a n, b m, overlap FROM ct WHERE overlap > 0 UNION ALL SELECT group_id, b, a, overlap FROM ct WHERE overlap > 0) o JOIN mb ON mb.group_id = o.group_id AND mb.seq_name = o.m GROUP BY 1, 2, 3)
    SELECT nc.group_id, nc.seq_name, nc.component, distance, coalesce(overlap, 0)::INTEGER overlap, (distance <= CASE WHEN relaxed THEN 80.0 ELSE 40.0 END AND coalesce(overlap, 0) > {MIN_OVERLAP}) OR distance <= 40.0 / 3 assigned FROM nc LEFT JOIN ov USING (group_id, seq_name, component)""")
def nearest_component(spark: SparkSession, folder: str) -> DataFrame:
    rows, listed = src.aligned(spark, folder), src.pair_distances(spark, folder)
    members = close_components(spark, folder)
    rest = rows.join(members, ["group_id", "seq_name"], "left_anti")
    rest = src.with_outgroup(rest, src.outgroup_taxa(spark, folder))
    overlaps = pairs.overlapping(pairs.pair_counts(listed, rows), 0)
    return pairs.nearest_component(listed, members, rest, overlaps, 40.0, MIN_OVERLAP, "is_outgroup")


_PARA = f"""{COUNTS}, nr AS (SELECT pd.* FROM pd JOIN ct ON ct.group_id = pd.group_id AND ct.a = pd.a AND ct.b = pd.b WHERE overlap > {MIN_OVERLAP}),
ot AS (SELECT group_id, a n, distance FROM nr WHERE split_part(a, '|', 1) <> split_part(b, '|', 1) AND distance < 4 UNION ALL SELECT group_id, b, distance FROM nr WHERE split_part(a, '|', 1) <> split_part(b, '|', 1) AND distance < 4),
lo AS (SELECT group_id, n, min(distance) l FROM ot GROUP BY 1, 2),
kp AS (SELECT nr.*, least(coalesce(p.l, q.l), coalesce(q.l, p.l)) l FROM nr LEFT JOIN lo p ON p.group_id = nr.group_id AND p.n = nr.a LEFT JOIN lo q ON q.group_id = nr.group_id AND q.n = nr.b WHERE split_part(a, '|', 1) = split_part(b, '|', 1)),
kd AS (SELECT group_id, a, b, distance, CASE WHEN distance > 4 THEN 'paralogs' WHEN distance > l THEN 'paralogs' WHEN l IS NOT NULL THEN 'alleles' END kind FROM kp)"""


def classified(spark: SparkSession, folder: str) -> DataFrame:
    rows, listed = src.aligned(spark, folder), src.pair_distances(spark, folder)
    overlaps = pairs.overlapping(pairs.pair_counts(listed, rows), MIN_OVERLAP)
    return pairs.paralogs_and_alleles(listed, overlaps, 4.0)


@query(f"WITH {_PARA} SELECT group_id, a, b, distance, kind FROM kd WHERE kind IS NOT NULL")
def paralog_classification(spark: SparkSession, folder: str) -> DataFrame:
    return classified(spark, folder)


@query(f"""WITH {_PARA}, t AS (SELECT group_id, split_part(a, '|', 1) taxon, max(distance) FILTER (kind = 'paralogs') far, min(distance) FILTER (kind = 'paralogs') fst, max(distance) FILTER (kind = 'alleles') nea FROM kd WHERE kind IS NOT NULL GROUP BY 1, 2)
    SELECT group_id, coalesce(max(CASE WHEN far > 5 * nea THEN nea END), min(fst)) min_distance FROM t GROUP BY 1 HAVING min_distance IS NOT NULL""")
def paralog_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.paralog_threshold(classified(spark, folder), 5.0)


@query(f"""WITH {AL}, {LONG}, s AS (SELECT group_id, pos, coalesce(string_agg(DISTINCT ch, '' ORDER BY ch) FILTER (ch IN ('A','C','G','T')), '-') b FROM lf GROUP BY 1, 2)
    SELECT group_id, pos::INTEGER pos, CASE b {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in dna.IUPAC.items())} ELSE '-' END code FROM s""")
def consensus_iupac(spark: SparkSession, folder: str) -> DataFrame:
    return columns.consensus(src.aligned(spark, folder))


@query(f"""WITH {AL}, {LONG}, n AS (SELECT group_id, pos, ch, count(*) FILTER (regexp_matches(seq_name, '_allele_[01]$')) own, count(*) FILTER (NOT regexp_matches(seq_name, '_allele_[01]$')) rest FROM lf WHERE ch IN ('A','C','G','T') GROUP BY ALL),
    m AS (SELECT *, own > 0 AND rest > 0.25 * sum(rest) OVER (PARTITION BY group_id, pos) o FROM n), g AS (SELECT group_id, pos, coalesce(string_agg(ch, '' ORDER BY ch) FILTER (own > 0), '-') b, coalesce(string_agg(ch, '' ORDER BY ch) FILTER (o), '') w FROM m GROUP BY 1, 2)
    SELECT group_id, pos::INTEGER pos, CASE WHEN length(b) = 1 THEN b WHEN length(w) = 1 THEN w ELSE CASE b {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in dna.IUPAC.items())} END END code FROM g""")
def allele_consensus(spark: SparkSession, folder: str) -> DataFrame:
    rows = src.aligned(spark, folder)
    return columns.majority_consensus(rows.withColumn("path", F.col("seq_name").rlike(r"_allele_[01]\z")), "path")


@query()
def small_fragment_clean(spark: SparkSession, folder: str) -> DataFrame:
    return columns.clean_small_fragments(src.aligned(spark, folder)).select("group_id", "seq_name", "seq")


@query()
def constrained_linkage(spark: SparkSession, folder: str) -> DataFrame:
    listed, kinds = src.pair_distances(spark, folder), classified(spark, folder)
    limit = pairs.paralog_threshold(kinds, 5.0)
    cannot = kinds.join(limit, "group_id").filter("distance >= min_distance").select("group_id", "a", "b")
    edges = listed.filter("distance < 20").join(cannot, ["group_id", "a", "b"], "left_anti")
    return linkage.constrained_linkage(edges, cannot)


@query()
def path_assembly(spark: SparkSession, folder: str) -> DataFrame:
    return tools.assembly(src.aligned(spark, folder), config.Assembly(overlap_threshold=60))


_MATES = f"""o AS (SELECT read_name, seq_name, lo, seq, lead(lo) OVER w nlo, lead(seq) OVER w nseq, row_number() OVER w r FROM rd WINDOW w AS (PARTITION BY read_name, seq_name ORDER BY lo, seq)),
    k AS (SELECT *, nlo - lo - length(seq) ahead FROM o WHERE r = 1), z AS (SELECT read_name, seq_name, lo, CASE WHEN nlo IS NULL THEN seq WHEN ahead >= 0 THEN seq || repeat('-', ahead) || nseq ELSE seq || substr(nseq, (1 - ahead)::BIGINT) END seq FROM k)"""


@query(f"WITH {RD}, {_MATES} SELECT read_name, seq_name, lo, (lo + length(seq))::INTEGER hi, seq FROM z")
def mate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return reads.mate_pairs(reads.distinct_reads(table(spark, folder, "reads"), names.canonical_name(F.col("seq_name"))))


def piled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    own = reads.distinct_reads(table(spark, folder, "reads"), names.canonical_name(F.col("seq_name")))
    return own, reads.variable_positions(reads.pileup(own), 4, SNP_SHARE)


@query(f'WITH {PILE} SELECT seq_name, pos::INTEGER pos, "A", "C", "G", "T" FROM pi')
def read_pileup(spark: SparkSession, folder: str) -> DataFrame:
    return reads.pileup(reads.distinct_reads(table(spark, folder, "reads"), names.canonical_name(F.col("seq_name"))))


@query(f"WITH {PILE} SELECT seq_name, pos::INTEGER pos, reads_ref, reads_alt FROM sv")
def snp_positions(spark: SparkSession, folder: str) -> DataFrame:
    return piled(spark, folder)[1]


_NEXT = "nx AS (SELECT seq_name, pos, lead(pos) OVER (PARTITION BY seq_name ORDER BY pos) next_pos FROM sv QUALIFY next_pos IS NOT NULL)"


@query(f"WITH {PILE}, {_NEXT} SELECT seq_name, pos::INTEGER pos, next_pos::INTEGER next_pos FROM nx")
def adjacent_snp_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return reads.adjacent(piled(spark, folder)[1])


_SPAN = f"sp AS (SELECT nx.seq_name, pos, next_pos, count(rd.lo) n_reads FROM nx LEFT JOIN rd ON rd.seq_name = nx.seq_name AND rd.lo <= pos AND rd.hi > next_pos AND substr(rd.seq, (pos - rd.lo + 1)::BIGINT, 1) <> '-' AND substr(rd.seq, (next_pos - rd.lo + 1)::BIGINT, 1) <> '-' GROUP BY 1, 2, 3)"


@query(f"WITH {PILE}, {_NEXT}, {_SPAN} SELECT seq_name, pos::INTEGER pos, next_pos::INTEGER next_pos, n_reads FROM sp")
def read_spans_pair(spark: SparkSession, folder: str) -> DataFrame:
    own, snps = piled(spark, folder)
    return reads.spanning(own, reads.adjacent(snps))


@query(f"WITH {PILE}, {_NEXT}, {_SPAN} SELECT seq_name, count(*) n_pairs, round(count(*) FILTER (n_reads > 0) / count(*), 6) ratio, count(*) FILTER (n_reads > 0) / count(*) > 0.5 valid FROM sp GROUP BY 1")
def snp_validity(spark: SparkSession, folder: str) -> DataFrame:
    own, snps = piled(spark, folder)
    return reads.validity(reads.spanning(own, reads.adjacent(snps)), 0.5)


_PHASED = f"""bs AS (SELECT z.seq_name, read_name, pos, substr(z.seq, (pos - lo + 1)::BIGINT, 1) base FROM z JOIN sv ON sv.seq_name = z.seq_name AND lo <= pos AND lo + length(z.seq) > pos),
    bc AS (SELECT seq_name, pos, base, count(*) n FROM bs WHERE base IN ('A','C','G','T') GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY seq_name, pos ORDER BY n DESC, base) <= 2),
    tw AS (SELECT seq_name, pos, min(base) b0, max(base) b1 FROM bc GROUP BY 1, 2 HAVING count(*) = 2), tn AS (SELECT *, lead(pos) OVER (PARTITION BY seq_name ORDER BY pos) np FROM tw),
    cl AS (SELECT bs.seq_name, read_name, bs.pos, np, base = b1 side FROM bs JOIN tn ON tn.seq_name = bs.seq_name AND tn.pos = bs.pos AND base IN (b0, b1)),
    vt AS (SELECT p.seq_name, p.np pos, sum(CASE WHEN p.side = q.side THEN 1 ELSE -1 END) v FROM cl p JOIN cl q ON q.seq_name = p.seq_name AND q.read_name = p.read_name AND q.pos = p.np GROUP BY 1, 2),
    tu AS (SELECT tw.*, sum(CASE WHEN v < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY tw.seq_name ORDER BY tw.pos) % 2 t FROM tw LEFT JOIN vt ON vt.seq_name = tw.seq_name AND vt.pos = tw.pos),
    ph AS (SELECT seq_name, pos, 0 allele, CASE WHEN t = 0 THEN b0 ELSE b1 END base FROM tu UNION ALL SELECT seq_name, pos, 1, CASE WHEN t = 0 THEN b1 ELSE b0 END FROM tu)"""


@query(f"WITH {PILE}, {_MATES}, {_PHASED} SELECT seq_name, pos::INTEGER pos, allele::INTEGER allele, base FROM ph")
def phased_bases(spark: SparkSession, folder: str) -> DataFrame:
    own, snps = piled(spark, folder)
    return reads.phase(reads.mate_pairs(own), snps)


@query(f"""WITH r AS (SELECT DISTINCT {sql_name('seq_name')} seq_name FROM reads), c AS (SELECT {_CONTIG} seq_name FROM contigs UNION SELECT seq_name FROM target_loci)
    SELECT coalesce(r.seq_name, c.seq_name) seq_name, CASE WHEN c.seq_name IS NULL THEN 'reads only' ELSE 'reference only' END side FROM (SELECT * FROM r WHERE seq_name IS NOT NULL) r FULL JOIN (SELECT * FROM c WHERE seq_name IS NOT NULL) c ON r.seq_name = c.seq_name WHERE r.seq_name IS NULL OR c.seq_name IS NULL""")
def unmatched_references(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "reads").select(names.canonical_name(F.col("seq_name")).alias("seq_name"), F.lit(1).alias("r")).distinct().filter("seq_name IS NOT NULL")
    c = table(spark, folder, "contigs").select(names.name_of(F.col("taxon"), F.col("contig")).alias("seq_name")).unionByName(table(spark, folder, "target_loci").select("seq_name"))
    both = r.join(c.distinct().filter("seq_name IS NOT NULL").withColumn("c", F.lit(1)), "seq_name", "full_outer")
    return both.filter("r IS NULL OR c IS NULL").select("seq_name", F.when(F.col("c").isNull(), "reads only").otherwise("reference only").alias("side"))


_NEAR = """nb AS (SELECT group_id, a n, b o, distance FROM pd UNION ALL SELECT group_id, b, a, distance FROM pd),
nk AS (SELECT *, row_number() OVER (PARTITION BY group_id, n ORDER BY distance, o) rk FROM nb QUALIFY rk <= 5)"""


@query(f"WITH {PD}, {_NEAR} SELECT group_id, n seq_name, o other, distance, rk::INTEGER \"rank\" FROM nk")
def nearest_records(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.nearest(src.pair_distances(spark, folder), 5)


@query(f"WITH {PD}, {_NEAR} SELECT pd.group_id, pd.a, pd.b, count(*) n_shared FROM pd JOIN nk x ON x.group_id = pd.group_id AND x.n = pd.a JOIN nk y ON y.group_id = pd.group_id AND y.n = pd.b AND y.o = x.o GROUP BY 1, 2, 3")
def shared_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    listed = src.pair_distances(spark, folder)
    return pairs.shared_neighbours(listed, pairs.nearest(listed, 5))


@query(f"""WITH RECURSIVE {_PARA}, {_CP[len(f"{AL}, {PD}, "):]}, zs AS (SELECT group_id, component, count(*) n FROM mb GROUP BY 1, 2), bp AS (SELECT group_id, a x, b y FROM kd WHERE kind = 'paralogs' UNION ALL SELECT group_id, b, a FROM kd WHERE kind = 'paralogs'),
    hp AS (SELECT bp.group_id, p.component cx, q.component cy, count(DISTINCT x) k FROM bp JOIN mb p ON p.group_id = bp.group_id AND p.seq_name = x JOIN mb q ON q.group_id = bp.group_id AND q.seq_name = y WHERE p.component <> q.component GROUP BY 1, 2, 3)
    SELECT hp.group_id, least(cx, cy) c1, greatest(cx, cy) c2, round(max(k / n), 6) score FROM hp JOIN zs ON zs.group_id = hp.group_id AND zs.component = cx GROUP BY 1, 2, 3""")
def paralogy_scores(spark: SparkSession, folder: str) -> DataFrame:
    barred = classified(spark, folder).filter("kind = 'paralogs'").select("group_id", "a", "b")
    return pairs.paralogy(close_components(spark, folder), barred)


@query(f"""WITH {PILE}, {_MATES}, {_PHASED}, {_TEXTS}, rc AS (SELECT seq_name, seq FROM target_loci UNION ALL SELECT seq_name, seq FROM tx WHERE seq_name NOT IN (SELECT seq_name FROM target_loci)),
    al2 AS (SELECT rc.seq_name, allele, seq FROM rc JOIN (SELECT DISTINCT seq_name, allele FROM ph) p ON p.seq_name = rc.seq_name),
    lt AS (SELECT seq_name, allele, i - 1 pos, substr(seq, i::BIGINT, 1) ch FROM (SELECT *, unnest(range(1, length(seq) + 1)) i FROM al2)),
    st AS (SELECT lt.seq_name, lt.allele, string_agg(coalesce(base, ch), '' ORDER BY lt.pos) seq FROM lt LEFT JOIN ph ON ph.seq_name = lt.seq_name AND ph.allele = lt.allele AND ph.pos = lt.pos GROUP BY 1, 2)
    SELECT seq_name || '_allele_' || allele seq_name, regexp_replace(seq, '[n-]', '', 'g') seq FROM st UNION ALL SELECT seq_name, regexp_replace(seq, '[n-]', '', 'g') FROM rc WHERE seq_name NOT IN (SELECT seq_name FROM ph)""")
def phased_sequences(spark: SparkSession, folder: str) -> DataFrame:
    own = reads.distinct_reads(table(spark, folder, "reads"), names.canonical_name(F.col("seq_name")))
    loci = table(spark, folder, "target_loci").select("seq_name", "seq")
    records = loci.unionByName(contig_texts(spark, folder).join(loci, "seq_name", "left_anti"))
    return tools.phasing(own, records, config.Phasing(min_coverage=4, min_share=SNP_SHARE, stringency=0.0))


def contig_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``seq_name, seq``: of the rows of one name the text with most letters ACGT, of equally full ones the one that sorts last."""
    rows = table(spark, folder, "contigs").filter("seq IS NOT NULL").select(names.name_of(F.col("taxon"), F.col("contig")).alias("seq_name"), F.upper("seq").alias("seq"))
    letters = F.length(F.regexp_replace("seq", "[^ACGT]", ""))
    return rows.filter("seq_name IS NOT NULL").groupBy("seq_name").agg(F.max(F.struct(letters, "seq"))["seq"].alias("seq"))


def outgroup_rows(spark: SparkSession, folder: str) -> DataFrame:
    return src.with_outgroup(src.aligned(spark, folder), src.outgroup_taxa(spark, folder))


@query(f"""WITH RECURSIVE h0 AS (SELECT {sql_name('a')} a, {sql_name('b')} b, align_len, evalue FROM common_hits),
    hb AS (SELECT a, b, min(evalue) e, max(align_len) l FROM h0 WHERE a <> b AND evalue <= 1e-50 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a ORDER BY e NULLS LAST, l DESC NULLS LAST, b) <= 10),
    re AS (SELECT least(a, b) a, greatest(a, b) b FROM hb h WHERE l > 300 GROUP BY 1, 2 HAVING bool_or(h.a < h.b) AND bool_or(h.a > h.b)), {_CC}, {_TEXTS},
    n AS (SELECT component, count(DISTINCT split_part(vertex, '|', 1)) n_taxa FROM cc GROUP BY 1)
    SELECT cc.component group_id, vertex seq_name, replace(seq, 'N', '') seq, n_taxa > 1 kept FROM cc JOIN n ON n.component = cc.component JOIN tx ON tx.seq_name = vertex""")
def primary_groups(spark: SparkSession, folder: str) -> DataFrame:
    return tools.primary(src.hits(spark, folder), contig_texts(spark, folder), config.Primary(max_evalue=1e-50))


@query(f"""WITH RECURSIVE {AL}, rt AS (SELECT group_id, CASE WHEN count(*) > 20 THEN 'failed' ELSE 'passed' END route FROM al GROUP BY 1), h0 AS (SELECT {sql_name('a')} a, {sql_name('b')} b, align_len, evalue FROM common_hits),
    sh AS (SELECT DISTINCT a, b FROM h0 WHERE a <> b AND evalue <= 1e-100 AND align_len > 400), fd AS (SELECT group_id, seq_name FROM al JOIN rt USING (group_id) WHERE route = 'failed'),
    e1 AS (SELECT x.group_id, a, b FROM sh JOIN fd x ON x.seq_name = a JOIN fd y ON y.seq_name = b AND y.group_id = x.group_id), ed AS (SELECT * FROM e1 UNION SELECT group_id, b, a FROM e1),
    rr(group_id, v, o) AS (SELECT group_id, a, a FROM ed UNION SELECT rr.group_id, rr.v, ed.b FROM rr JOIN ed ON rr.group_id = ed.group_id AND rr.o = ed.a), pt AS (SELECT group_id, v seq_name, min(o) c FROM rr GROUP BY 1, 2)
    SELECT al.group_id, CASE WHEN route = 'passed' THEN al.group_id ELSE coalesce(c, al.seq_name) END subgroup, al.seq_name, replace(seq, '-', '') seq, route FROM al JOIN rt USING (group_id) LEFT JOIN pt ON pt.group_id = al.group_id AND pt.seq_name = al.seq_name""")
def secondary_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = src.aligned(spark, folder).select("group_id", "seq_name", "seq")
    return tools.secondary(rows, src.hits(spark, folder), config.Secondary(max_size=20, min_align_len=400, max_evalue=1e-100))


@query()
def outparalog_components(spark: SparkSession, folder: str) -> DataFrame:
    p = config.Outparalogs(min_overlap=MIN_OVERLAP)
    return tools.outparalogs(outgroup_rows(spark, folder), src.pair_distances(spark, folder), p, 50)


@query()
def inparalog_components(spark: SparkSession, folder: str) -> DataFrame:
    p = config.Inparalogs(overlap_splitting=80, overlap_merging=MIN_OVERLAP)
    return tools.numbered(tools.inparalogs(outgroup_rows(spark, folder), src.pair_distances(spark, folder), p))


@query()
def retrimmed(spark: SparkSession, folder: str) -> DataFrame:
    return tools.retrim(src.aligned(spark, folder)).select("group_id", "seq_name", "seq")
