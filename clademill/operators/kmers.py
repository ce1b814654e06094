"""k-mers by alignment position: groups, singletons, masking and pair scores."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clademill.functions import dna
from clademill.functions.names import without_allele
from clademill.session import BROADCAST_BYTES, cut, written


def by_position(rows: DataFrame, k: int, clean: bool = True) -> DataFrame:
    """``group_id, seq_name, pos, kmer``; with ``clean`` only those without gap and unknown, else all but pure gaps."""
    found = rows.select("group_id", "seq_name", F.explode(dna.kmers(F.col("seq"), k)).alias("k")).select("group_id", "seq_name", "k.pos", "k.kmer")
    return found.filter(~F.col("kmer").rlike("[Nn-]")) if clean else found.filter(F.col("kmer").rlike("[^-]"))


def kmer_counts(kmers: DataFrame) -> DataFrame:
    """``group_id, pos, kmer, n``."""
    return kmers.groupBy("group_id", "pos", "kmer").agg(F.count(F.lit(1)).alias("n"))


# functions of this module travel to the tasks themselves, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Letters of one group that a task compares at a time, nearly, and the least and most positions of a block.
LETTERS, NARROW, WIDE = 6_000_000, 64, 4_096


def blocked(rows: DataFrame, lengths: list[int], pairs: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """``group_id, block, width, a, b, part`` and the columns ``more``: the texts of each group cut into blocks of positions, and its pairs with each block.

    ``part`` has the ``width`` positions of its block and the letters that k-mers reach beyond them; it is null in rows of
    pairs. Groups of many records have narrow blocks, so the size of a group bounds no task. Rows of a block are together
    and sorted. Texts travel once and k-mers never do: as rows they are many times the input.
    """
    rows = cut(rows.filter("group_id IS NOT NULL AND seq_name IS NOT NULL").select("group_id", "seq_name", "seq", *more))
    least, most = min(lengths), max(lengths)
    count = lambda size: F.ceil((size - least) / F.col("width")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1)).alias("block")
    width = F.greatest(F.lit(NARROW), F.least(F.lit(WIDE), F.floor(F.lit(LETTERS) / F.count(F.lit(1))))).cast("int")
    sizes = rows.groupBy("group_id").agg(width.alias("width"), F.max(F.length("seq")).alias("size")).filter(F.col("size") > least)
    sizes, seen = written(sizes)
    sizes = F.broadcast(sizes) if seen["bytes"] <= BROADCAST_BYTES else sizes
    texts = rows.filter(F.length("seq") > least).join(sizes.select("group_id", "width"), "group_id")
    texts = texts.select("group_id", "width", F.col("seq_name").alias("a"), F.lit(None).cast("string").alias("b"), "seq", *more, each(count(F.length("seq"))))
    texts = texts.select("group_id", "block", "width", "a", "b", F.substring("seq", F.col("block") * F.col("width") + 1, F.col("width") + most).alias("part"), *more)
    if pairs is not None:
        asked = pairs.select("group_id", "a", "b").distinct().join(sizes, "group_id").select("group_id", each(count(F.col("size"))), "width", "a", "b", F.lit(None).cast("string").alias("part"))
        texts = texts.unionByName(asked)
    # few bytes but much work, so tasks are not merged
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(tasks, "group_id", "block").sortWithinPartitions("group_id", "block")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole blocks, as many at a time as make about ``LETTERS``, each with the number of its block by row."""

    def split(table: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray]]:
        group, block = table["group_id"].to_pylist(), table["block"].to_numpy()
        key = np.cumsum([0, *(x != y for x, y in zip(group, group[1:]))]) if len(group) > 1 else np.zeros(len(group), int)
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
        size = np.maximum.reduceat(pc.fill_null(pc.utf8_length(table["part"]), 0).to_numpy(), first)
        held = np.add.reduceat(table["part"].is_valid().to_numpy().astype(np.int64), first)
        number = np.repeat(np.arange(len(first)), np.diff([*first, len(key)]))
        start, n, wide = 0, 0, 0
        for i in range(len(first)):
            if i > start and (n + held[i]) * max(wide, size[i]) > LETTERS:
                yield table.slice(first[start], first[i] - first[start]), number[first[start] : first[i]] - start
                start, n, wide = i, 0, 0
            n, wide = n + held[i], max(wide, size[i])
        yield table.slice(first[start]), number[first[start] :] - start

    kept, last = [], None
    for t in batches:
        if not t.num_rows:
            continue
        keys = list(zip(t["group_id"].to_pylist(), t["block"].to_pylist()))
        i = t.num_rows - 1
        while i and keys[i - 1] == keys[-1]:
            i -= 1
        if kept and (i or keys[0] != last):
            yield from split(pa.Table.from_batches([*kept, t.slice(0, i)]))
            kept, t = [], t.slice(i)
        kept, last = [*kept, t], keys[-1]
    if kept:
        yield from split(pa.Table.from_batches(kept))


def kinds(parts: list[str], key: np.ndarray, width: np.ndarray, lengths: list[int], shared: bool = True) -> list[np.ndarray]:
    """For each length, in rising order, a matrix of records by positions: the number of the k-mer that starts there.

    Equal k-mers of one position and block ``key`` have equal numbers, from 1; 0 where a gap, an unknown or no whole k-mer is, and with
    ``shared`` where no other record of the block has the k-mer. Letters are compared, not hashes. A row of zeros is added at the end.
    """
    n, size = len(parts), np.array([len(x) for x in parts], np.int64)
    across = max(0, min(int(width.max(initial=0)), int(size.max(initial=0)) - lengths[0]))
    out = [np.zeros((n + 1, across), np.int32) for _ in lengths]
    data = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.flatnonzero(np.bincount(data)) if len(data) else np.array([], np.int64)
    good = used[~np.isin(used, [ord(c) for c in "Nn-"])]
    if not len(good) or not across:
        return out
    table = np.full(used.max() + 1, -1, np.int32)
    table[good] = np.arange(len(good))
    grid = np.full((n, int(size.max())), -1, np.int32)
    grid[np.arange(grid.shape[1]) < size[:, None]] = table[data]
    grid = np.ascontiguousarray(grid.T)
    limits, blocks = [np.minimum(width, size - k) for k in lengths], int(key.max()) + 1
    for j in range(across):
        code, top, ok, at = key.astype(np.int64), blocks, np.ones(n, bool), 0
        for found, limit, k in zip(out, limits, lengths):
            if j + k > len(grid):
                break
            for letter in grid[j + at : j + k]:
                if top * len(good) >= 1 << 62:
                    code, top = np.unique(code, return_inverse=True)[1], n
                code = code * len(good) + letter
                ok &= letter >= 0
                top *= len(good)
            at = k
            own = np.flatnonzero(ok & (j < limit))
            if not len(own):
                continue
            order = own[np.argsort(code[own])]
            ordered = code[order]
            new = np.r_[True, ordered[1:] != ordered[:-1]]
            number = np.cumsum(new)
            if shared:
                number[new & np.r_[new[1:], True]] = 0
            found[order, j] = number
    return out


def kmer_groups(rows: DataFrame, k: int) -> DataFrame:
    """``group_id, pos, kmer, seq_name``: the records of each k-mer that two or more have at one position.

    One row per record, not a list per k-mer, so a k-mer that all records of a large group share stays spread out.
    """
    at = blocked(rows, [k])
    group = at.schema["group_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, key in chunks(batches):
            (found,) = kinds(table["part"].to_pylist(), key, table["width"].to_numpy(), [k])
            record, place = np.nonzero(found[:-1])
            ends = np.r_[0, np.cumsum(np.bincount(record, minlength=len(key)))]
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
            yield from table.select(["group_id", "block", "width", "a", "part"]).append_column("places", places).combine_chunks().to_batches()

    done = at.mapInArrow(run, f"group_id {group}, block int, width int, a string, part string, places array<int>")
    one = done.select("group_id", "block", "width", "a", "part", F.explode("places").alias("p"))
    return one.select("group_id", (F.col("block") * F.col("width") + F.col("p")).alias("pos"), F.substring("part", F.col("p") + 1, F.lit(k)).alias("kmer"), F.col("a").alias("seq_name"))


def singletons(rows: DataFrame, k: int, min_similarity: int, first: int = 4) -> DataFrame:
    """``group_id, seq_name, pos`` of the k-mers that only one record, or one pair of alleles, has at a position.

    A k-mer is supported if another k-mer of its position equals it in more than ``min_similarity`` letters that are no
    gap. Kinds of k-mer, not records, are compared: rare ones first with the ``first`` most frequent kinds of
    their position, which support most of them; what is left with those that share a block of letters in place: of
    ``min_similarity + 1`` equal letters, one of the blocks below has to be equal throughout and free of gaps.
    """
    kmers = by_position(rows, k, clean=False)
    kinds = kmers.groupBy("group_id", "pos", "kmer").agg(F.count(F.lit(1)).alias("n"), F.min("seq_name").alias("one"), F.max("seq_name").alias("two"))
    pair = F.col("one").rlike(r"_allele_0\z") & F.col("two").rlike(r"_allele_1\z") & (without_allele(F.col("one")) == without_allele(F.col("two")))
    once = (F.col("n") == 1) | ((F.col("n") == 2) & pair)
    quick = k <= dna.PACKED
    mine, theirs = (dna.packed(F.col("kmer"), "u"), dna.packed(F.col("kmer"), "v")) if quick else (F.col("kmer"), F.col("kmer"))
    same = dna.packed_similarity(F.col("mine"), F.col("theirs"), k) if quick else dna.similarity(F.col("mine"), F.col("theirs"))
    near = (F.col("other") != F.col("kmer")) & (same > min_similarity)
    coded = cut(kinds.select("group_id", "pos", "kmer", "n", once.alias("once"), mine.alias("mine"), theirs.alias("theirs")))
    place, name = ["group_id", "pos"], ["group_id", "pos", "kmer"]
    often = F.row_number().over(W.partitionBy(*place).orderBy(F.desc("n"), "kmer"))
    top = coded.select(*place, F.col("kmer").alias("other"), "theirs", often.alias("r")).filter(F.col("r") <= first).drop("r")
    rare = coded.filter("once").select(*name, "mine")
    known = rare.join(top, place).filter(near).select(*name).distinct()
    rare = cut(rare.join(known, name, "left_anti"))
    number = k - min_similarity
    size = max(1, k // number)
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.substring("kmer", i * size + 1, size if i < number - 1 else k).alias("part")) for i in range(number)])
    blocks = lambda df: df.withColumn("b", F.explode(parts)).withColumn("i", F.col("b.i")).withColumn("part", F.col("b.part")).drop("b").filter("NOT contains(part, '-')")
    keys = [*place, "i", "part"]
    other = blocks(coded.select(*name, "theirs")).withColumnRenamed("kmer", "other")
    supported = blocks(rare).join(other, keys).filter(near).select(*name).distinct()
    alone = rare.join(supported, name, "left_anti").select(*name)
    return kmers.join(alone, name, "left_semi").select("group_id", "seq_name", "pos")


def dense_masks(flags: DataFrame, rows: DataFrame, k: int, window: int, share: float, gap_run: int) -> DataFrame:
    """``group_id, seq_name, lo, hi``: stretches to be masked, between the first and the last run of ``k`` letters.

    A window of ``window`` positions that starts at a flagged one, holds more than ``floor(window * share)`` flagged ones
    and no run of ``gap_run`` gaps masks its positions up to ``window - k``.
    """
    texts = rows.select("group_id", "seq_name", "seq")
    last = F.length("seq") - F.regexp_instr(F.reverse("seq"), F.lit(f"[^-]{{{k}}}")) + 1
    inside = flags.join(texts, ["group_id", "seq_name"]).filter((F.col("pos") >= F.regexp_instr("seq", F.lit(f"[^-]{{{k}}}")) - 1) & (F.col("pos") <= last))
    ahead = W.partitionBy("group_id", "seq_name").orderBy("pos").rangeBetween(0, window - 1)
    counted = inside.withColumn("n", F.count(F.lit(1)).over(ahead)).filter(F.col("n") > int(window * share))
    free = counted.filter(~F.contains(F.substring("seq", F.col("pos") + 1, F.lit(window)), F.repeat(F.lit("-"), gap_run)))
    return free.select("group_id", "seq_name", F.col("pos").alias("lo"), (F.col("pos") + (window - k)).alias("hi"))


def masked(rows: DataFrame, masks: DataFrame) -> DataFrame:
    """The rows with the letters of the masks as ``N``; masks of a record are merged in place, text by text."""
    spots = masks.groupBy("group_id", "seq_name").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spots"))
    joined = rows.join(spots, ["group_id", "seq_name"], "left")
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    size = lambda m: F.least(m["hi"], F.length("seq")) - m["lo"]
    done = F.aggregate(F.coalesce("spots", none), F.col("seq"), lambda s, m: F.overlay(s, F.repeat(F.lit("N"), size(m)), m["lo"] + 1))
    return joined.withColumn("seq", done).drop("spots")


def pair_scores(rows: DataFrame, k: int, min_positions: int, pairs: DataFrame | None = None) -> DataFrame:
    """``group_id, a, b, together, compared, score``: how often two records fall into one k-mer group.

    Only k-mers that two or more records share at a position count. Records grouped at ``min_positions`` positions or
    fewer are left out, and ``score`` is 0 unless more positions than that were compared. Candidates are ``pairs``
    (group_id, a, b) if given, else those that are grouped somewhere.
    """
    if pairs is None:
        grouped = kmer_groups(rows, k)
        one, two = grouped.withColumnRenamed("seq_name", "a"), grouped.withColumnRenamed("seq_name", "b")
        pairs = one.join(two, ["group_id", "pos", "kmer"]).filter("a < b").select("group_id", "a", "b").distinct()
    return pair_scores_by_length(rows, (k,), min_positions, pairs).drop("k")


def pair_scores_by_length(rows: DataFrame, lengths: tuple[int, ...], min_positions: int, pairs: DataFrame) -> DataFrame:
    """``group_id, a, b, k, together, compared, score``: ``pair_scores`` of the listed pairs for each length, from one pass over texts and pairs."""
    lengths = sorted(set(lengths))
    at = blocked(rows, lengths, pairs)
    names = [f"{x}_{k}" for k in lengths for x in ("together", "compared", "na", "nb")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, key in chunks(batches):
            held = table["part"].is_valid().to_numpy()
            texts, asked = table.filter(held), table.filter(~held)
            if not len(texts) or not len(asked):
                continue
            found = kinds(texts["part"].to_pylist(), key[held], texts["width"].to_numpy(), lengths)
            row = {x: i for i, x in enumerate(zip(key[held].tolist(), texts["a"].to_pylist()))}
            wanted = key[~held].tolist()
            a, b = (np.array([row.get(x, -1) for x in zip(wanted, asked[c].to_pylist())], np.int64) for c in "ab")
            counts = []
            for f in found:
                own, together, compared = np.count_nonzero(f, 1), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
                step = max(1, (1 << 19) // max(1, f.shape[1]))
                for i in range(0, len(a), step):
                    x, y = f[a[i : i + step]], f[b[i : i + step]]
                    both = (x > 0) & (y > 0)
                    compared[i : i + step] = both.sum(1)
                    together[i : i + step] = (both & (x == y)).sum(1)
                counts += [together, compared, own[a], own[b]]
            some = np.any(np.array(counts) > 0, 0)
            done = pa.table({**{c: asked[c] for c in ("group_id", "a", "b")}, **{c: pa.array(x, pa.int32()) for c, x in zip(names, counts)}})
            yield from done.filter(some).combine_chunks().to_batches()

    group = at.schema["group_id"].dataType.simpleString()
    parts = at.mapInArrow(run, f"group_id {group}, a string, b string, " + ", ".join(f"{c} int" for c in names))
    total = parts.groupBy("group_id", "a", "b").agg(*[F.sum(c).cast("int").alias(c) for c in names])
    by = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.col(f"{x}_{k}").alias(x) for x in ("together", "compared", "na", "nb")]) for k in lengths]))
    counted = total.select("group_id", "a", "b", by.alias("c")).select("group_id", "a", "b", "c.*").filter((F.col("together") > 0) & (F.col("na") > min_positions) & (F.col("nb") > min_positions))
    score = F.when(F.col("compared") > min_positions, F.col("together") / F.col("compared")).otherwise(0.0)
    return counted.select("group_id", "a", "b", "k", "together", "compared", F.round(score, 6).alias("score"))


def component_agreement(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """``group_id, c1, c2, ratio``: share of the positions common to two components of a group at which all their records have one k-mer.

    ``rows``: group_id, seq_name, seq, component, k; ``k`` is one of ``lengths``, the same in a group.
    """
    lengths = sorted(set(lengths))
    at = blocked(rows, lengths, more=("component", "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, key in chunks(batches):
            for k in lengths:
                mine = table["k"].to_numpy() == k
                if mine.any():
                    yield from agreed(table.filter(mine), np.unique(key[mine], return_inverse=True)[1], k)

    def agreed(table: pa.Table, key: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        (found,) = kinds(table["part"].to_pylist(), key, table["width"].to_numpy(), [k], shared=False)
        place = {x: i for i, x in enumerate(sorted(set(zip(key.tolist(), table["component"].to_pylist()))))}
        of = np.array([place[x] for x in zip(key.tolist(), table["component"].to_pylist())])
        order = np.argsort(of, kind="stable")
        first = np.searchsorted(of[order], np.arange(len(place)))
        high = np.maximum.reduceat(found[order], first, axis=0)
        low = np.minimum.reduceat(np.where(found[order] == 0, np.iinfo(np.int32).max, found[order]), first, axis=0)
        one = np.where(low == high, high, -(high > 0).astype(np.int32))  # 0: none, -1: several
        names, block = np.array([c for _, c in sorted(place)], object), np.array([x for x, _ in sorted(place)])
        starts = np.searchsorted(block, np.arange(block[-1] + 2))
        source = np.searchsorted(key, np.arange(block[-1] + 1))
        step = max(1, (1 << 19) // max(1, one.shape[1]))
        groups = table["group_id"].combine_chunks()
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            rows, c1, c2, same, met = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([groups.take(pa.array(rows)), pa.array(c1, pa.string()), pa.array(c2, pa.string()), pa.array(same), pa.array(met)], ["group_id", "c1", "c2", "same", "met"])

        for x, y, row in zip(starts, starts[1:], source):
            for i in range(x, y - 1):
                for lo in range(i + 1, y, step):
                    theirs = one[lo : min(y, lo + step)]
                    both = (one[i] != 0) & (theirs != 0)
                    met, same = both.sum(1), ((theirs == one[i]) & (one[i] > 0)).sum(1)
                    some = np.flatnonzero(met)
                    if len(some):
                        held.append((np.full(len(some), row), np.full(len(some), names[i], object), names[lo + some], same[some], met[some]))
                        size += len(some)
                    if size > 50_000:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()

    group = at.schema["group_id"].dataType.simpleString()
    parts = at.mapInArrow(run, f"group_id {group}, c1 string, c2 string, same long, met long")
    return parts.groupBy("group_id", "c1", "c2").agg((F.sum("same") / F.sum("met")).alias("ratio"))
