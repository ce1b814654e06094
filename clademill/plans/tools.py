"""The tools as plans: groups from hits, stricter regrouping, separation and assembly of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clademill import config
from clademill.functions import dna
from clademill.functions.names import taxon_of, without_allele
from clademill.operators import columns, graph, groups, kmers, linkage, pairs, reads
from clademill.session import cut


def primary(hits: DataFrame, contigs: DataFrame, p: config.Primary = config.Primary()) -> DataFrame:
    """``group_id, seq_name, seq, kept``: groups of records linked by reciprocal hits.

    ``hits``: a, b, align_len, evalue in the direction of the search; ``contigs``: seq_name, seq. Unknowns are removed.
    A group is named after its smallest record and kept with more than ``min_taxa`` taxa. Records without a
    reciprocal hit are in no group.
    """
    near = hits.filter(F.col("evalue") <= p.max_evalue)
    best = graph.best_hits(near, p.max_targets).select("a", "b", "align_len")
    members = graph.connected_components(graph.reciprocal(best, p.min_align_len))
    sized = graph.keep_components(members.withColumn("taxon", taxon_of(F.col("vertex"))), "taxon", p.min_taxa)
    texts = contigs.select(F.col("seq_name").alias("vertex"), dna.without(F.col("seq"), "Nn").alias("seq"))
    return sized.join(texts, "vertex").select(F.col("component").alias("group_id"), F.col("vertex").alias("seq_name"), "seq", "kept")


def secondary(rows: DataFrame, hits: DataFrame, p: config.Secondary = config.Secondary()) -> DataFrame:
    """``group_id, subgroup, seq_name, seq, route``: groups that fail the size or taxon limits, linked again more strictly.

    One plan for all failed groups: hits within a group under the stricter limits are the edges, keyed by group. Passed
    groups keep their rows; members without a strict hit are subgroups of their own.
    """
    routed = groups.route(rows.withColumn("taxon", taxon_of(F.col("seq_name"))), p.max_size, p.max_occurrence, p.by_size, p.by_taxa)
    marked = rows.join(routed, "group_id")
    failed = marked.filter("route = 'failed'").select("group_id", "seq_name")
    strict = hits.filter((F.col("evalue") <= p.max_evalue) & (F.col("align_len") > p.min_align_len)).select("a", "b").distinct()
    one, two = failed.select("group_id", F.col("seq_name").alias("a")), failed.select("group_id", F.col("seq_name").alias("b"))
    edges = strict.join(one, "a").join(two, ["group_id", "b"])
    parts = graph.connected_components(edges, "a", "b", "group_id").select("group_id", F.col("vertex").alias("seq_name"), "component")
    joined = marked.join(parts, ["group_id", "seq_name"], "left")
    sub = F.when(F.col("route") == "passed", F.col("group_id")).otherwise(F.coalesce("component", "seq_name"))
    return joined.select("group_id", sub.alias("subgroup"), "seq_name", dna.without(F.col("seq"), "-").alias("seq"), "route")


def clean(rows: DataFrame, p: config.Clean = config.Clean()) -> DataFrame:
    """Masks dense stretches of singleton k-mers of ingroup rows (flag ``is_outgroup``), then drops ambiguous rows."""
    inside = rows.filter("NOT is_outgroup").withColumn("seq", dna.mask_ambiguous(F.col("seq"))).filter(F.translate("seq", "-", "") != "")
    masks = kmers.dense_masks(kmers.singletons(inside, p.k, p.min_similarity), inside, p.k, p.window, p.share, p.gap_run)
    return groups.ambiguity_filter(kmers.masked(inside, masks), p.max_ambiguous).unionByName(rows.filter("is_outgroup"))


def large_components(members: DataFrame, ratio: float) -> DataFrame:
    """Members of components larger than ``ratio`` times the largest of their group."""
    sizes = members.groupBy("group_id", "component").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("group_id").agg(F.max("n").alias("most"))
    kept = sizes.join(most, "group_id").filter(F.col("n") > F.col("most") * F.lit(ratio)).select("group_id", "component")
    return members.join(kept, ["group_id", "component"], "left_semi")


def valid_components(members: DataFrame, counts: DataFrame, keys: list[str], min_overlap: int, max_alleles: int) -> DataFrame:
    """``keys, component, valid``: whether fewer than ``max_alleles`` taxa have two records in it that overlap by more than ``min_overlap``."""
    near = counts.filter(F.col("overlap") > min_overlap).withColumn("taxon", taxon_of(F.col("a"))).filter(F.col("taxon") == taxon_of(F.col("b")))
    one, two = members.withColumnRenamed("seq_name", "a"), members.withColumnRenamed("seq_name", "b")
    inside = near.join(one.select(*keys, "a", "component"), ["group_id", "a"]).join(two.select(*keys, "b", "component"), [*keys, "b", "component"])
    taxa = inside.groupBy(*keys, "component").agg(F.count_distinct("taxon").alias("n"))
    every = members.select(*keys, "component").distinct().join(taxa, [*keys, "component"], "left")
    return every.select(*keys, "component", (F.coalesce("n", F.lit(0)) < max_alleles).alias("valid"))


def sweep(rows: DataFrame, counts: DataFrame, outgroups: DataFrame, p: config.Outparalogs = config.Outparalogs(), min_positions: int = 100) -> DataFrame:
    """``group_id, seq_name, component, k``: components of the first k-mer length that settles a group.

    All lengths are computed in one plan. A length settles a group if it gives several components, or a single one that is
    valid; of a group that none settles the first length with a component counts.
    """
    keys = ("group_id", "k")
    scores = cut(graph.with_overlap(kmers.pair_scores_by_length(rows, p.kmers, min_positions, counts), counts))
    found = graph.similarity_edges(scores, graph.outgroup_threshold(scores, outgroups, keys), outgroups, p.min_overlap, keys)
    keyed = found.withColumn("key", F.concat_ws("\u0001", F.col("group_id"), "k"))
    members = graph.connected_components(keyed, "a", "b", "key").select(F.split_part("key", F.lit("\u0001"), F.lit(1)).alias("group_id"), F.split_part("key", F.lit("\u0001"), F.lit(2)).cast("int").alias("k"), F.col("vertex").alias("seq_name"), "component")
    n = valid_components(members, counts, ["group_id", "k"], p.min_overlap, p.max_alleles).groupBy("group_id", "k").agg(F.count(F.lit(1)).alias("n"), F.bool_and("valid").alias("valid"))
    choice = n.groupBy("group_id").agg(F.min(F.struct(((F.col("n") == 1) & ~F.col("valid")).alias("unsettled"), "k"))["k"].alias("k"))
    return members.join(choice, ["group_id", "k"])


def fuse(members: DataFrame, support: DataFrame, max_jaccard: float, min_ratio: float) -> DataFrame:
    """``group_id, seq_name, component``: components whose taxa differ and whose members support each other, fused.

    ``support``: group_id, c1, c2, ratio. Pairs without a common taxon have a Jaccard index of 0. Components
    that nothing fuses stay as they are.
    """
    common = pairs.taxon_jaccard(members)
    good = support.join(common, ["group_id", "c1", "c2"], "left").filter((F.coalesce("jaccard", F.lit(0.0)) <= max_jaccard) & (F.col("ratio") > min_ratio))
    fused = graph.connected_components(good, "c1", "c2", "group_id").select("group_id", F.col("vertex").alias("component"), F.col("component").alias("fused"))
    return members.join(fused, ["group_id", "component"], "left").withColumn("component", F.coalesce("fused", "component")).drop("fused")


def association_support(rows: DataFrame, members: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """``group_id, c1, c2, ratio``: share of the positions at which two components with a common position agree on one k-mer group."""
    own = members.select("group_id", "seq_name", "component", "k")
    return kmers.component_agreement(rows.join(own, ["group_id", "seq_name"]), lengths)


def outparalogs(rows: DataFrame, distances: DataFrame, p: config.Outparalogs = config.Outparalogs(), min_positions: int = 100) -> DataFrame:
    """``group_id, seq_name, component, outcome``: every record with its component, or with the reason why it has none.

    ``rows`` carry ``taxon`` and ``is_outgroup``; ``distances`` list the pairs that are looked at.
    """
    outgroups = rows.filter("is_outgroup").select("taxon").distinct()
    counts = cut(pairs.pair_counts(distances, rows).select("group_id", "a", "b", "overlap"))
    members = cut(sweep(rows, counts, outgroups, p, min_positions).withColumn("taxon", taxon_of(F.col("seq_name"))))
    fused = fuse(members, association_support(rows, members, p.kmers), p.max_jaccard, p.min_association)
    kept = cut(large_components(fused, p.large_ratio))
    rest = rows.join(kept, ["group_id", "seq_name"], "left_anti")
    placed = pairs.nearest_component(distances, kept, rest, pairs.overlapping(counts, 0), p.max_distance, p.min_overlap, "is_outgroup")
    assigned = placed.filter("assigned").select("group_id", "seq_name", "component", F.lit("assigned").alias("outcome"))
    known = kept.select("group_id", "seq_name", "component", F.lit("component").alias("outcome")).unionByName(assigned)
    return rows.select("group_id", "seq_name").join(known, ["group_id", "seq_name"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("unassigned")))


def without_allele_pairs(members: DataFrame) -> DataFrame:
    """Members of all components but those that are only the two alleles of one record."""
    kinds = members.groupBy("group_id", "component").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(without_allele(F.col("seq_name"))).alias("bases"))
    return members.join(kinds.filter("n = 2 AND bases = 1"), ["group_id", "component"], "left_anti")


def joined_components(members: DataFrame, distances: DataFrame, cannot: DataFrame, p: config.Inparalogs) -> DataFrame:
    """``group_id, seq_name, component``: large components of one lineage joined, those with the least paralogy first.

    Pairs of components with a measured distance between them and taxa that differ enough (a Jaccard index of at most
    ``max_jaccard``) are taken; groups with fewer than two such pairs stay as they are. A pair with a paralogy score of
    ``min_taxa_share`` or more must not be joined. Where that would leave one component, the group's largest score
    becomes the limit instead, so that a separation that was found is not lost.
    """
    inside = members.select("group_id", "seq_name", "component", taxon_of(F.col("seq_name")).alias("taxon"))
    place = lambda c, to: inside.select("group_id", F.col("seq_name").alias(c), F.col("component").alias(to))
    met = distances.join(place("a", "x"), ["group_id", "a"]).join(place("b", "y"), ["group_id", "b"]).filter("x <> y")
    met = met.select("group_id", F.least("x", "y").alias("c1"), F.greatest("x", "y").alias("c2")).distinct()
    scored = met.join(pairs.taxon_jaccard(inside), ["group_id", "c1", "c2"], "left").filter(F.coalesce("jaccard", F.lit(0.0)) <= p.max_jaccard)
    scored = scored.join(pairs.paralogy(inside, cannot), ["group_id", "c1", "c2"], "left").select("group_id", F.col("c1").alias("a"), F.col("c2").alias("b"), F.coalesce("score", F.lit(0.0)).alias("distance"))
    several = scored.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("most")).filter("n > 1")
    scored = cut(scored.join(several.select("group_id", "most"), "group_id"))

    def linked(rows: DataFrame, limit: Column) -> DataFrame:
        found = linkage.constrained_linkage(rows.filter(F.col("distance") < limit).drop("most"), rows.filter(F.col("distance") >= limit).select("group_id", "a", "b"))
        return inside.select("group_id", "component").distinct().join(found.select("group_id", F.col("seq_name").alias("component"), "cluster"), ["group_id", "component"], "left")

    first = cut(linked(scored, F.lit(p.min_taxa_share)))
    one = first.groupBy("group_id").agg(F.count_distinct(F.coalesce("cluster", "component")).alias("n"), F.count(F.lit(1)).alias("before")).filter("n = 1 AND before > 1").select("group_id")
    forced = linked(scored.join(one, "group_id", "left_semi"), F.col("most"))
    final = first.join(one, "group_id", "left_anti").unionByName(forced.join(one, "group_id", "left_semi"))
    return inside.join(final, ["group_id", "component"]).select("group_id", "seq_name", F.coalesce("cluster", "component").alias("component"))


def inparalogs(rows: DataFrame, distances: DataFrame, p: config.Inparalogs = config.Inparalogs()) -> DataFrame:
    """``group_id, seq_name, component, outcome``: copies of one taxon within a group, separated by constrained linkage.

    Groups without paralogs come out as ``no_threshold``, those in which paralogs lie in less than ``min_taxa_share`` of the
    taxa as ``no_overlap``, those that fall into one large component as ``no_separation``. In the others records outside the
    components join the nearest one if it is near enough, else they are ``unassigned``.
    """
    barred = F.col("taxon").isin(*p.excluded_taxa) if p.excluded_taxa else F.lit(False)
    inner = rows.filter(~F.col("is_outgroup") & ~barred).select("group_id", "seq_name", "taxon")
    counts = cut(pairs.pair_counts(distances, rows).select("group_id", "a", "b", "overlap"))
    both = pairs.overlapping(counts, p.overlap_merging)
    listed = distances.join(inner.select("group_id", F.col("seq_name").alias("a")), ["group_id", "a"], "left_semi").join(inner.select("group_id", F.col("seq_name").alias("b")), ["group_id", "b"], "left_semi")
    kinds = cut(pairs.paralogs_and_alleles(listed, both, p.max_allele_distance))
    limit = pairs.paralog_threshold(kinds, p.distance_ratio)
    cannot = cut(kinds.join(limit, "group_id").filter("distance >= min_distance").select("group_id", "a", "b"))
    furthest = kinds.filter("kind = 'paralogs'").groupBy("group_id").agg(F.max("distance").alias("most"))
    taxa = inner.groupBy("group_id").agg(F.count_distinct("taxon").alias("n"))
    touched = cannot.groupBy("group_id").agg(F.count_distinct(taxon_of(F.col("a"))).alias("k"))
    share = furthest.join(taxa, "group_id").join(touched, "group_id", "left").select("group_id", "most", (F.coalesce("k", F.lit(0)) >= F.col("n") * F.lit(p.min_taxa_share)).alias("enough"))
    share = cut(share)
    near = listed.join(both.select("group_id", F.col("seq_name").alias("a"), F.col("other").alias("b")), ["group_id", "a", "b"], "left_semi")
    edges = near.join(share.filter("enough"), "group_id").filter("distance < most").select("group_id", "a", "b", "distance").join(cannot, ["group_id", "a", "b"], "left_anti")
    members = linkage.constrained_linkage(edges, cannot).select("group_id", "seq_name", F.col("cluster").alias("component"))
    large = large_components(cut(without_allele_pairs(members)), p.large_ratio)
    parted = large.groupBy("group_id").agg(F.count_distinct("component").alias("n")).filter("n > 1").select("group_id")
    kept = cut(joined_components(cut(large.join(parted, "group_id", "left_semi")), listed, cannot, p))
    apart = cut(kept.groupBy("group_id").agg(F.count_distinct("component").alias("n")).filter("n > 1").select("group_id"))
    kept = kept.join(apart, "group_id", "left_semi")
    rest = rows.join(kept, ["group_id", "seq_name"], "left_anti").join(share.join(apart, "group_id", "left_semi").select("group_id", "most"), "group_id")
    placed = pairs.nearest_component(distances, kept, rest, pairs.overlapping(counts, 0), "most", p.overlap_splitting, "is_outgroup")
    known = kept.withColumn("outcome", F.lit("component")).unionByName(placed.filter("assigned").select("group_id", "seq_name", "component", F.lit("assigned").alias("outcome")))
    every = rows.select("group_id", "seq_name").join(known, ["group_id", "seq_name"], "left").join(share.select("group_id", "enough"), "group_id", "left").join(apart.withColumn("apart", F.lit(True)), "group_id", "left")
    said = F.when(F.col("enough").isNull(), "no_threshold").when(~F.col("enough"), "no_overlap").when(F.col("apart").isNull(), "no_separation").otherwise("unassigned")
    return every.select("group_id", "seq_name", "component", F.coalesce("outcome", said).alias("outcome"))


def phasing(found: DataFrame, records: DataFrame, p: config.Phasing = config.Phasing()) -> DataFrame:
    """``seq_name, seq``: the haplotypes of ``records``, from distinct reads on them (``reads.distinct_reads``).

    Records of excluded taxa stay as they are, and so do those of whose neighbouring variable positions no share of
    ``stringency`` is spanned by a read; a single variable position has no neighbour and counts.
    """
    snps = cut(reads.variable_positions(reads.pileup(found), p.min_coverage, p.min_share))
    if p.excluded_taxa:
        snps = snps.filter(~taxon_of(F.col("seq_name")).isin(*p.excluded_taxa))
    if p.stringency > 0:
        bad = reads.validity(reads.spanning(found, reads.adjacent(snps)), p.stringency).filter("NOT valid")
        snps = snps.join(bad.select("seq_name"), "seq_name", "left_anti")
    return reads.haplotypes(records, reads.phase(cut(reads.mate_pairs(found)), snps))


def assembly(rows: DataFrame, p: config.Assembly = config.Assembly()) -> DataFrame:
    """``group_id, taxon, path, score, seq``: fragments of a taxon chained into longer records (``linkage.fragment_paths``)."""
    return linkage.fragment_paths(rows, p.overlap_threshold, p.overlap_cost, p.mismatch_cost)


def retrim(rows: DataFrame, trim: config.Trim = config.Trim(), fragments: config.Fragments = config.Fragments()) -> DataFrame:
    """Trims again, then blanks small fragments."""
    cut = columns.trim(rows, trim.window, trim.ungapped, trim.acid_share, trim.max_gap)
    return columns.clean_small_fragments(cut, fragments.length, fragments.flank, fragments.tiny)


def numbered(outcomes: DataFrame) -> DataFrame:
    """Adds ``number``: components of a group counted in the order of their names."""
    firsts = outcomes.filter("component IS NOT NULL").select("group_id", "component").distinct()
    n = firsts.withColumn("number", F.row_number().over(W.partitionBy("group_id").orderBy("component")))
    return outcomes.join(n, ["group_id", "component"], "left")
