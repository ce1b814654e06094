"""Pairs of aligned records: overlap, similarity and evolutionary distances of listed pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clademill.functions import dna


BASES = "ACGT"
MIXED = ("AC", "AG", "AT", "CG", "CT", "GT")


def with_bits(rows: DataFrame) -> DataFrame:
    """``group_id, seq_name`` and, made once per record, one bit per column for occupied ones (occ), bases (base) and each base."""
    occupied = dna.bits(F.translate(F.col("seq"), "-", "."), "ACGTRYSWKMBDHVNU")
    return rows.select("group_id", "seq_name", occupied.alias("occ"), dna.bits(F.col("seq"), BASES).alias("base"), *[dna.bits(F.col("seq"), x).alias(x) for x in BASES])


def pair_counts(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The listed pairs (group_id, a, b) with counts over their common columns.

    ``overlap`` columns where neither has a gap (unknowns count), ``compared`` where both have a base, ``match`` of these
    equal, ``ts`` transitions, ``gc_a`` and ``gc_b``, ``n_A`` to ``n_T`` bases of both, ``n_AC`` and so on columns with two
    different bases. Pairs are listed, never made from a whole group, so the work follows the list. Pairs of
    which a record is missing do not come out.
    """
    b = with_bits(rows)
    names = ["occ", "base", *BASES]
    one = b.select("group_id", F.col("seq_name").alias("a"), *[F.col(x).alias(f"x_{x}") for x in names])
    two = b.select("group_id", F.col("seq_name").alias("b"), *[F.col(x).alias(f"y_{x}") for x in names])
    joined = pairs.select("group_id", "a", "b").join(one, ["group_id", "a"]).join(two, ["group_id", "b"])
    both = lambda x, y: dna.common_bits(F.col(f"x_{x}"), F.col(f"y_{y}"))
    return joined.select(
        "group_id", "a", "b", both("occ", "occ").alias("overlap"), both("base", "base").alias("compared"),
        (both("A", "A") + both("C", "C") + both("G", "G") + both("T", "T")).alias("match"),
        (both("A", "G") + both("G", "A") + both("C", "T") + both("T", "C")).alias("ts"),
        (both("C", "base") + both("G", "base")).alias("gc_a"), (both("base", "C") + both("base", "G")).alias("gc_b"),
        *[(both(x, "base") + both("base", x)).alias(f"n_{x}") for x in BASES], *[(both(x, y) + both(y, x)).alias(f"n_{x}{y}") for x, y in MIXED],
    )


def distances(counts: DataFrame) -> DataFrame:
    """All distance models of counted pairs, per 100 sites and rounded to 6 digits; null where undefined."""
    n = F.col("compared")
    p, ts = dna.p_distance(n, F.col("match")), F.when(n > 0, F.col("ts") / n)
    tv = p - ts
    mixed = F.lit(0.0)
    for x, y in MIXED:
        mixed = mixed + F.when(F.col(f"n_{x}{y}") > 0, F.col(f"n_{x}{y}") * F.col(f"n_{x}{y}") * 2.0 / (F.col(f"n_{x}") * F.col(f"n_{y}"))).otherwise(0.0)
    share = [F.col(f"n_{x}") / (2 * n) for x in BASES]
    models = {
        "uncorrected": 100 * p, "jukes_cantor": dna.jukes_cantor(p), "kimura": dna.kimura(ts, tv),
        "tamura": dna.tamura(ts, tv, F.col("gc_a") / n, F.col("gc_b") / n),
        "tajima_nei": dna.tajima_nei(p, share, mixed), "jin_nei": dna.jin_nei(ts, tv),
    }
    return counts.select("group_id", "a", "b", "compared", *[F.round(F.when(n > 0, c) + F.lit(0.0), 6).alias(k) for k, c in models.items()])


def overlapping(counts: DataFrame, more_than: int) -> DataFrame:
    """Both directions of the pairs with more than so many common columns: the adjacency of overlapping records."""
    kept = counts.filter(F.col("overlap") > more_than)
    return kept.select("group_id", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"), "overlap").select("group_id", F.col("e.a").alias("seq_name"), F.col("e.b").alias("other"), "overlap")


def taxon_jaccard(members: DataFrame) -> DataFrame:
    """``group_id, c1, c2, jaccard`` of the taxon sets of two components of a group that share a taxon.

    ``members``: group_id, component, taxon. Pairs without a common taxon have 0 and are not listed, so
    components are joined on taxa, not with each other.
    """
    distinct = members.select("group_id", "component", "taxon").distinct()
    sizes = distinct.groupBy("group_id", "component").agg(F.count(F.lit(1)).alias("n"))
    left, right = distinct.withColumnRenamed("component", "c1"), distinct.withColumnRenamed("component", "c2")
    common = left.join(right, ["group_id", "taxon"]).filter("c1 < c2").groupBy("group_id", "c1", "c2").agg(F.count(F.lit(1)).alias("common"))
    both = common.join(sizes.select("group_id", F.col("component").alias("c1"), F.col("n").alias("n1")), ["group_id", "c1"]).join(sizes.select("group_id", F.col("component").alias("c2"), F.col("n").alias("n2")), ["group_id", "c2"])
    return both.select("group_id", "c1", "c2", F.round(F.col("common") / (F.col("n1") + F.col("n2") - F.col("common")), 6).alias("jaccard"))


def nearest_component(distances: DataFrame, members: DataFrame, unassigned: DataFrame, overlaps: DataFrame, max_distance: float | str, min_overlap: int, relaxed: str | None = None) -> DataFrame:
    """``group_id, seq_name, component, distance, overlap, assigned`` of the unassigned records with a distance.

    The nearest component is that of the member at the smallest distance, ties by member name. A record is
    assigned if that distance is at most ``max_distance`` (twice that where the flag column ``relaxed`` is true)
    and it overlaps a member by more than ``min_overlap``, or if the distance is at most a third of it. ``max_distance`` is a
    number or names the column of ``unassigned`` that holds it.
    """
    both = distances.select("group_id", F.explode(F.array(F.struct(F.col("a").alias("seq_name"), F.col("b").alias("member")), F.struct(F.col("b").alias("seq_name"), F.col("a").alias("member")))).alias("e"), "distance")
    both = both.select("group_id", "e.seq_name", "e.member", "distance")
    flag = F.col(relaxed) if relaxed else F.lit(False)
    most = F.col(max_distance) if isinstance(max_distance, str) else F.lit(max_distance)
    wanted = unassigned.select("group_id", "seq_name", flag.alias("relaxed"), most.alias("most"))
    inside = members.select("group_id", F.col("seq_name").alias("member"), "component")
    linked = both.join(wanted, ["group_id", "seq_name"]).join(inside, ["group_id", "member"])
    nearest = linked.groupBy("group_id", "seq_name").agg(F.min(F.struct("distance", "member", "component")).alias("m"), F.first("relaxed").alias("relaxed"), F.first("most").alias("most"))
    nearest = nearest.select("group_id", "seq_name", F.col("m.distance").alias("distance"), F.col("m.component").alias("component"), "relaxed", "most")
    shared = overlaps.select("group_id", "seq_name", F.col("other").alias("member"), "overlap").join(inside, ["group_id", "member"]).groupBy("group_id", "seq_name", "component").agg(F.max("overlap").alias("overlap"))
    judged = nearest.join(shared, ["group_id", "seq_name", "component"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    limit = F.when(F.col("relaxed"), 2 * F.col("most")).otherwise(F.col("most"))
    good = ((F.col("distance") <= limit) & (F.col("overlap") > min_overlap)) | (F.col("distance") <= F.col("most") / 3)
    return judged.select("group_id", "seq_name", "component", "distance", "overlap", good.alias("assigned"))


def paralogs_and_alleles(distances: DataFrame, overlaps: DataFrame, max_allele: float) -> DataFrame:
    """``group_id, a, b, distance, kind`` of overlapping pairs of one taxon with a distance.

    Further apart than ``max_allele``: paralogs. Else the pair is compared with the smallest distance below
    ``max_allele`` of either record to an overlapping one of another taxon: none leaves the pair out, a smaller one makes
    paralogs, otherwise the two are alleles. ``overlaps`` lists both directions.
    """
    taxon = lambda c: F.split_part(c, F.lit("|"), F.lit(1))
    near = distances.join(overlaps.select("group_id", F.col("seq_name").alias("a"), F.col("other").alias("b")), ["group_id", "a", "b"], "left_semi")
    same = near.filter(taxon(F.col("a")) == taxon(F.col("b")))
    others = near.filter((taxon(F.col("a")) != taxon(F.col("b"))) & (F.col("distance") < max_allele))
    ends = others.select("group_id", F.explode(F.array("a", "b")).alias("seq_name"), "distance").groupBy("group_id", "seq_name").agg(F.min("distance").alias("least"))
    joined = same.join(ends.select("group_id", F.col("seq_name").alias("a"), F.col("least").alias("la")), ["group_id", "a"], "left").join(ends.select("group_id", F.col("seq_name").alias("b"), F.col("least").alias("lb")), ["group_id", "b"], "left")
    least = F.least("la", "lb")
    kind = F.when(F.col("distance") > max_allele, "paralogs").when(least.isNotNull() & (F.col("distance") > least), "paralogs").when(least.isNotNull(), "alleles")
    return joined.select("group_id", "a", "b", "distance", kind.alias("kind")).filter("kind IS NOT NULL")


def paralog_threshold(classified: DataFrame, ratio: float) -> DataFrame:
    """``group_id, min_distance``: from which distance on same-taxon pairs count as paralogs.

    The largest allele distance of a taxon whose largest paralog distance exceeds it ``ratio`` times; without
    one, the smallest paralog distance of the group. Groups without paralogs have no row.
    """
    taxon = F.split_part("a", F.lit("|"), F.lit(1))
    by = classified.groupBy("group_id", taxon.alias("taxon")).agg(
        F.max(F.when(F.col("kind") == "paralogs", F.col("distance"))).alias("far"), F.min(F.when(F.col("kind") == "paralogs", F.col("distance"))).alias("first"), F.max(F.when(F.col("kind") == "alleles", F.col("distance"))).alias("near"))
    supported = F.when(F.col("far") > F.col("near") * F.lit(ratio), F.col("near"))
    return by.groupBy("group_id").agg(F.coalesce(F.max(supported), F.min("first")).alias("min_distance")).filter("min_distance IS NOT NULL")


def nearest(distances: DataFrame, k: int) -> DataFrame:
    """``group_id, seq_name, other, distance, rank``: the ``k`` nearest records of each, ties by name."""
    both = distances.select("group_id", F.explode(F.array(F.struct(F.col("a").alias("seq_name"), F.col("b").alias("other")), F.struct(F.col("b").alias("seq_name"), F.col("a").alias("other")))).alias("e"), "distance")
    order = W.partitionBy("group_id", "seq_name").orderBy("distance", "other")
    ranked = both.select("group_id", "e.seq_name", "e.other", "distance").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def shared_neighbours(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """``group_id, a, b, n_shared``: listed pairs whose nearest records, as ``nearest`` gives them, have some in common.

    The pair itself is no witness; pairs without a common one are left out.
    """
    listed = pairs.select("group_id", "a", "b")
    one = near.select("group_id", F.col("seq_name").alias("a"), F.col("other").alias("w"))
    two = near.select("group_id", F.col("seq_name").alias("b"), F.col("other").alias("w"))
    met = listed.join(one, ["group_id", "a"]).join(two, ["group_id", "b", "w"])
    return met.groupBy("group_id", "a", "b").agg(F.count(F.lit(1)).alias("n_shared"))


def paralogy(members: DataFrame, barred: DataFrame) -> DataFrame:
    """``group_id, c1, c2, score``: pairs of components between which there are paralogs.

    The score is the larger share of a component's records that have a paralog (``barred``: group_id, a, b) in the other.
    """
    inside = members.select("group_id", "seq_name", "component")
    sizes = inside.groupBy("group_id", "component").agg(F.count(F.lit(1)).alias("n"))
    both = barred.select("group_id", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("group_id", "e.x", "e.y")
    placed = both.join(inside.select("group_id", F.col("seq_name").alias("x"), F.col("component").alias("cx")), ["group_id", "x"]).join(inside.select("group_id", F.col("seq_name").alias("y"), F.col("component").alias("cy")), ["group_id", "y"]).filter("cx <> cy")
    hit = placed.groupBy("group_id", "cx", "cy").agg(F.count_distinct("x").alias("k")).join(sizes.withColumnRenamed("component", "cx"), ["group_id", "cx"])
    score = hit.groupBy("group_id", F.least("cx", "cy").alias("c1"), F.greatest("cx", "cy").alias("c2")).agg(F.max(F.col("k") / F.col("n")).alias("score"))
    return score.select("group_id", "c1", "c2", F.round("score", 6).alias("score"))
