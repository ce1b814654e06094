"""Column algebra of alignments: profiles, dropping and slicing of columns, conserved windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clademill.functions import dna
from clademill.functions.arrays import appended, blocks, collected
from clademill.operators.intervals import overlap_semi


def long_form(rows: DataFrame) -> DataFrame:
    """``group_id, seq_name, pos, ch``: one row per letter."""
    return rows.select("group_id", "seq_name", F.posexplode(F.split("seq", "")).alias("pos", "ch")).filter("ch <> ''")


def gap_profile(rows: DataFrame) -> DataFrame:
    """``group_id, pos, n_seq, n_gap``: gaps and unknowns of each column."""
    letters = rows.select("group_id", F.posexplode(F.split("seq", "")).alias("pos", "ch")).filter("ch <> ''")
    return letters.groupBy("group_id", "pos").agg(F.count(F.lit(1)).alias("n_seq"), F.count_if(F.col("ch").isin("N", "n", "-")).alias("n_gap"))


def kept_columns(rows: DataFrame, max_gap: float) -> DataFrame:
    """``group_id, kept``: for each column in order whether its gap share does not exceed ``max_gap``."""
    flags = gap_profile(rows).select("group_id", F.struct("pos", (F.col("n_gap") <= F.col("n_seq") * F.lit(max_gap)).alias("keep")).alias("c"))
    return flags.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["keep"]).alias("kept"))


def drop_gapped_columns(rows: DataFrame, max_gap: float) -> DataFrame:
    """The rows without the columns whose share of gaps and unknowns exceeds ``max_gap``.

    Only one flag per column of a group is joined to its rows, so letters are never shuffled back together.
    A group that keeps no column keeps empty texts.
    """
    joined = rows.join(kept_columns(rows, max_gap), "group_id", "left")
    letters = F.zip_with(F.split("seq", ""), F.coalesce("kept", F.array().cast("array<boolean>")), lambda c, k: F.when(k, c).otherwise(""))
    return joined.withColumn("seq", F.array_join(letters, "")).drop("kept")


def slice_columns(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """The columns ``start`` up to ``stop`` of each group, as ``bounds`` (group_id, start, stop) gives them."""
    cut = rows.join(bounds, "group_id", "left")
    whole = F.col("start").isNull()
    return cut.withColumn("seq", F.when(whole, F.col("seq")).otherwise(F.substring("seq", F.col("start") + 1, F.col("stop") - F.col("start")))).drop("start", "stop")


def fragments(rows: DataFrame, min_length: int) -> DataFrame:
    """``group_id, seq_name, lo, hi``: maximal runs without gaps and unknowns of at least ``min_length`` columns."""
    found = rows.select("group_id", "seq_name", F.explode(dna.ungapped_runs(F.col("seq"))).alias("r"))
    return found.select("group_id", "seq_name", F.col("r.start").alias("lo"), F.col("r.end").alias("hi")).filter(F.col("hi") - F.col("lo") >= min_length)


def window_votes(rows: DataFrame, width: int) -> DataFrame:
    """``group_id, start, n_votes``: for each window the number of records with a fragment that contains it.

    Fragments that no other record overlaps seed no windows but vote. Window starts are exploded from
    fragments and counted with map-side combining.
    """
    found = fragments(rows, width)
    seeds = overlap_semi(found, "group_id", "seq_name", "lo", "hi")
    starts = lambda df: df.select("group_id", "seq_name", F.explode(F.sequence(F.col("lo"), F.col("hi") - width)).alias("start"))
    votes = starts(found).groupBy("group_id", "start").agg(F.count(F.lit(1)).alias("n_votes"))
    seeded = starts(seeds).select("group_id", "start").distinct()
    return votes.join(seeded, ["group_id", "start"])


def modal_share(rows: DataFrame, width: int) -> DataFrame:
    """``group_id, start, at, share``: for each window and each of its codons the largest share of one amino acid
    among the fragments that contain the window."""
    found = fragments(rows, width).join(rows.select("group_id", "seq_name", "seq"), ["group_id", "seq_name"])
    codons = found.select("group_id", "lo", "hi", "seq", F.explode(F.sequence(F.col("lo"), F.col("hi") - 3)).alias("at"))
    codons = codons.withColumn("acid", dna.acid(F.substring("seq", F.col("at") + 1, F.lit(3))))
    first = F.greatest(F.lit(0), F.ceil((F.col("at") + width - F.col("hi")) / 3))
    last = F.least(F.lit(width // 3 - 1), F.floor((F.col("at") - F.col("lo")) / 3))
    steps = F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))
    windows = codons.select("group_id", "at", "acid", F.explode(steps).alias("k")).select("group_id", (F.col("at") - 3 * F.col("k")).alias("start"), "at", "acid")
    counts = windows.groupBy("group_id", "start", "at", "acid").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("group_id", "start", "at").agg((F.max("n") / F.sum("n")).alias("share"))


def trim_bounds(rows: DataFrame, width: int = 12, ungapped: float = 0.25, acid_share: float = 0.5) -> DataFrame:
    """``group_id, start, stop``: from the first to the last accepted window of each group.

    The width is cut to whole codons. A window is accepted with votes of at least the share ``ungapped`` of
    the records, one at least, if in each of its codons one amino acid has a share of ``acid_share`` among the voters. Groups without an accepted window have no row and stay whole.
    """
    width = width // 3 * 3
    if width < 3:
        raise ValueError("width must be at least 3")
    quorum = rows.groupBy("group_id").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.lit(ungapped))).alias("quorum"))
    voted = window_votes(rows, width).join(quorum, "group_id").filter("n_votes >= quorum").select("group_id", "start")
    least = modal_share(rows, width).groupBy("group_id", "start").agg(F.min("share").alias("least"))
    good = voted.join(least.filter(F.col("least") >= acid_share), ["group_id", "start"])
    return good.groupBy("group_id").agg(F.min("start").alias("start"), (F.max("start") + width).alias("stop"))


def trim(rows: DataFrame, width: int = 12, ungapped: float = 0.25, acid_share: float = 0.5, max_gap: float = 0.9) -> DataFrame:
    """Trims the ends of each group to conserved windows, then drops gapped columns."""
    return drop_gapped_columns(slice_columns(rows, trim_bounds(rows, width, ungapped, acid_share)), max_gap)


def consensus(rows: DataFrame) -> DataFrame:
    """``group_id, pos, code``: the code of the bases of each column, ``-`` where no record has one."""
    letters = long_form(rows).groupBy("group_id", "pos").agg(*[F.max(F.when(F.col("ch") == x, F.lit(x))).alias(x) for x in "ACGT"])
    bases = F.array_compact(F.array(*"ACGT"))
    return letters.select("group_id", "pos", F.coalesce(F.when(F.size(bases) > 0, dna.iupac(bases)), F.lit("-")).alias("code"))


def majority_consensus(rows: DataFrame, path: str, min_share: float = 0.25) -> DataFrame:
    """``group_id, pos, code`` for the rows flagged by column ``path``: their base where they agree.

    Where they differ, the one differing base that more than ``min_share`` of the other rows' bases have; else the
    exact ambiguity code. No base at all gives ``-``; the column is always kept.
    """
    letters = rows.select("group_id", F.col(path).alias("own"), F.posexplode(F.split("seq", "")).alias("pos", "ch")).filter(F.col("ch").isin(*"ACGT"))
    counts = letters.groupBy("group_id", "pos", "ch").agg(F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("rest"))
    total = F.sum("rest").over(W.partitionBy("group_id", "pos"))
    marked = counts.withColumn("often", (F.col("own") > 0) & (F.col("rest") > total * F.lit(min_share)))
    agg = marked.groupBy("group_id", "pos").agg(
        F.array_sort(F.collect_list(F.when(F.col("own") > 0, F.col("ch")))).alias("bases"),
        F.array_sort(F.collect_list(F.when(F.col("often"), F.col("ch")))).alias("often"),
    )
    code = F.when(F.size("bases") == 0, "-").when(F.size("bases") == 1, F.get("bases", F.lit(0))).when(F.size("often") == 1, F.get("often", F.lit(0))).otherwise(dna.iupac(F.col("bases")))
    return agg.select("group_id", "pos", code.alias("code"))


def sequence_bounds(rows: DataFrame, k: int) -> DataFrame:
    """``group_id, seq_name, start, stop``: from the first to the last run of ``k`` letters without gap.

    Null where a record has no such run.
    """
    first = F.regexp_instr("seq", F.lit(f"[^-]{{{k}}}"))
    last = F.regexp_instr(F.reverse("seq"), F.lit(f"[^-]{{{k}}}"))
    return rows.select("group_id", "seq_name", F.when(first > 0, first - 1).alias("start"), F.when(last > 0, F.length("seq") - last + 1).alias("stop"))


def clean_small_fragments(rows: DataFrame, length: int = 50, flank: int = 15, tiny: int = 3) -> DataFrame:
    """Blanks small fragments between gaps. Upper case, ``N`` as ``-``; rows without a base stay as they are.

    Neighbouring runs are joined into a fragment while it spans at most ``length`` columns from its start. A
    fragment is blanked if it has at most ``tiny`` columns, or at most ``length`` and ``flank`` gaps on each inner side;
    at an end of the row the other side decides.
    """
    seq = dna.mask_ambiguous(F.col("seq"))
    placed = rows.withColumn("seq", seq).withColumn("__runs", dna.runs(F.col("seq"), "[^-]", "-"))
    span = "struct<start:int,end:int>"
    start = F.struct(*blocks(span), F.lit(None).cast(span).alias("last"))

    def join_run(done, r):
        last = done["last"]
        fits = last.isNotNull() & (r["end"] - last["start"] <= length)
        grown = F.struct(F.when(fits, last["start"]).otherwise(r["start"]).alias("start"), r["end"].alias("end"))
        return F.struct(*appended(done, last, ~fits & last.isNotNull()), grown.alias("last"))

    placed = placed.withColumn("__parts", F.aggregate("__runs", start, join_run, lambda done: F.concat(collected(done), F.array_compact(F.array(done["last"])))))
    width = F.length("seq")

    def blank(r):
        size = r["end"] - r["start"]
        left = F.translate(F.substring("seq", F.greatest(r["start"] - flank, F.lit(0)) + 1, F.least(r["start"], F.lit(flank))), "-", "") == ""
        right = F.translate(F.substring("seq", r["end"] + 1, F.lit(flank)), "-", "") == ""
        wide_left, wide_right = r["start"] >= flank, r["end"] + flank <= width
        sided = F.when(wide_left & wide_right, left & right).when(wide_left, left).when(wide_right, right).otherwise(F.lit(False))
        return (size <= tiny) | ((size <= length) & sided)

    placed = placed.withColumn("__blank", F.filter("__parts", blank))
    done = F.aggregate("__blank", F.col("seq"), lambda s, r: F.overlay(s, F.repeat(F.lit("-"), r["end"] - r["start"]), r["start"] + 1))
    return placed.withColumn("seq", done).drop("__runs", "__parts", "__blank")
