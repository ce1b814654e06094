"""Long exact spans shared between records: k-mers as edges, nonbranching paths compacted by joins, texts compared at their coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clademill.operators.intervals import merged_periods
from clademill.session import cut

#: Letters of a span; a k-mer of this length is an edge.
SPAN = 120
SEED = 32  # letters that fit one 64-bit number
#: Letters that one step of the array code takes at once; about 150 bytes of memory each.
BLOCK = 1 << 20
#: Column name and type of the edges: run, place in it, k-mer, neighbouring letters.
EDGE = {"id": T.LongType(), "i": T.IntegerType(), "edge": T.LongType(), "beside": T.ShortType()}
NONE = 4  # neither of the four letters

CODES = np.full(256, NONE, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    CODES[_c] = CODES[_c | 32] = _i


def scrambled(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers, so that the smallest seed is a random one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(code: np.ndarray) -> np.ndarray:
    """The ``SEED`` letters from each place on, two bits each, as a number."""
    out, width = (code & 3).astype(np.uint64), 1
    while width < SEED:
        out = out[:-width] << np.uint64(2 * width) | out[width:]
        width *= 2
    return out


def seed_runs(code: np.ndarray, word: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed, first window and number of windows of each run of k-mers with one smallest seed.

    ``code`` holds letters 0 to 3 and ``NONE`` for anything else, which no k-mer contains. Equal k-mers have equal smallest
    seeds, so a k-mer shared by two records lies in a run of one seed in both.
    """
    low, width, wanted = scrambled(word), 1, span - SEED + 1
    while width * 2 <= wanted:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = wanted - width
    low = np.minimum(low[: len(low) - rest], low[rest:])
    bad = np.concatenate([[0], np.cumsum(code == NONE)])
    good = bad[span:] == bad[:-span]
    new = np.concatenate([[True], low[1:] != low[:-1]])
    start = np.flatnonzero(good & (new | ~np.concatenate([[False], good[:-1]])))
    stop = np.flatnonzero(good & (np.concatenate([new[1:], [True]]) | ~np.concatenate([good[1:], [False]])))
    return low[start].view(np.int64), start, stop - start + 1


def binaries(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """Consecutive ``count`` numbers each as one binary value."""
    ends = np.concatenate([[0], np.cumsum(count)]) * 8
    return pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def packed_runs(code: np.ndarray, word: np.ndarray, start: np.ndarray, windows: np.ndarray, span: int) -> pa.Array:
    """Each run with the letter before and after it, where there is one: a head number and the letters, two bits each."""
    left = (start > 0) & (code[start - 1] < NONE)
    after = np.minimum(start + windows + span - 1, len(code) - 1)
    right = (start + windows + span - 1 < len(code)) & (code[after] < NONE)
    size = windows + span - 1 + left + right
    n = -(-size // SEED) + 1
    first = np.cumsum(n) - n
    j = np.arange(n.sum()) - np.repeat(first, n)
    at = np.repeat(start - left, n) + np.minimum((j - 1) * SEED, np.repeat(size - SEED, n))
    values = word[np.maximum(at, 0)]
    values[first] = size.astype(np.uint64) | left.astype(np.uint64) << np.uint64(62) | right.astype(np.uint64) << np.uint64(63)
    return binaries(values, n)


def seeded_runs(df: DataFrame, span: int = SPAN) -> DataFrame:
    """``seed, owner, doc, at, run, windows``: stretches of each text ``seq`` whose ``windows`` k-mers share their smallest seed, packed.

    ``df`` as ``records`` gives it; ``at`` is the first letter of the first k-mer. Where a run ends does not matter
    for what follows, so long texts are worked through in blocks.
    """
    schema = T.StructType([T.StructField("seed", T.LongType()), T.StructField("owner", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("run", T.BinaryType()), T.StructField("windows", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            begin = (offsets - offsets[0])[:-1]
            for lo in range(0, len(data) - span + 1, BLOCK):
                low = max(lo - 1, 0)
                code = CODES[data[low : lo + BLOCK + span]]
                word = words(code)
                seed, start, windows = seed_runs(code, word, span)
                if low < lo:  # the first letter belongs to the block before
                    windows = np.where(start == 0, windows - 1, windows)
                    start = np.maximum(start, 1)
                past = np.minimum(windows, lo + BLOCK - low - start)
                keep = past > 0
                seed, start, windows = seed[keep], start[keep], past[keep]
                owner = np.searchsorted(begin, start + low, side="right") - 1
                take = pa.array(owner)
                at = (start + low - begin[owner]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(seed), batch.column(1).take(take), batch.column(0).take(take), pa.array(at), packed_runs(code, word, start, windows, span), pa.array(windows.astype(np.int32))], names=schema.names)

    parted = df.filter(F.length("seq") >= span).select("doc", F.xxhash64("name").alias("owner"), F.concat("seq", F.lit("\n")).alias("seq"))
    return parted.mapInArrow(run, schema)


def records(df: DataFrame, name: Column, row: Column, seq: Column) -> DataFrame:
    """``doc, name, row, seq``: the distinct records with a name and a text; gaps ``-`` are removed."""
    rows = df.select(name.alias("name"), row.cast("long").alias("row"), F.translate(seq, "-", "").alias("seq")).filter("name IS NOT NULL AND seq IS NOT NULL")
    return rows.select(F.xxhash64("name", "row", "seq").alias("doc"), "name", "row", "seq")


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of packed runs, one after the other, with the offset and size of each and whether it has a letter before and after it."""
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    values = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
    n = np.diff(offsets) // 8
    first = np.cumsum(n) - n
    head = values[first]
    size = (head & np.uint64((1 << 62) - 1)).astype(np.int64)
    begin = np.cumsum(size) - size
    j = np.arange(len(values)) - np.repeat(first, n) - 1
    at = (np.repeat(begin, n) + np.minimum(j * SEED, np.repeat(size - SEED, n)))[j >= 0]
    code = np.zeros(int(size.sum()), np.uint8)
    shifts = np.arange(2 * SEED - 2, -1, -2, dtype=np.uint64)
    code[at[:, None] + np.arange(SEED)] = (values[j >= 0][:, None] >> shifts & np.uint64(3)).astype(np.uint8)
    return code, begin, size, (head >> np.uint64(62) & np.uint64(1)).astype(np.int64), (head >> np.uint64(63)).astype(np.int64)


def edges(distinct: DataFrame, wanted: tuple[str, ...], span: int) -> DataFrame:
    """The ``wanted`` columns of ``EDGE``: one row per k-mer of the distinct runs (``id, run``).

    ``beside`` has a bit for the letter before the k-mer, of five, and one for the letter after it; the fifth means none.
    """
    schema = T.StructType([T.StructField(x, EDGE[x]) for x in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = np.cumsum(4 * np.diff(np.frombuffer(batch.column(1).cast(pa.large_binary()).buffers()[1], np.int64)[batch.column(1).offset :][: len(batch) + 1]))
            cuts = np.unique(np.concatenate([[0], np.searchsorted(letters, np.arange(BLOCK, letters[-1] if len(letters) else 0, BLOCK)), [len(batch)]]))
            for lo, hi in zip(cuts, cuts[1:]):
                code, begin, size, left, right = unpacked(batch.column(1).slice(lo, hi - lo))
                windows = size - left - right - (span - 1)
                owner = np.repeat(np.arange(len(size)), windows)
                i = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
                at = (begin + left)[owner] + i
                out = {"i": i.astype(np.int32)}
                if "id" in wanted:
                    out["id"] = batch.column(0).slice(lo, hi - lo).to_numpy()[owner]
                word, edge = words(code), np.full(len(at), span, np.uint64)
                for step in range(-(-span // SEED)):
                    edge = scrambled(edge + word[at + min(step * SEED, span - SEED)])
                out["edge"] = edge.view(np.int64)
                if "beside" in wanted:
                    before = np.where((i > 0) | (left[owner] > 0), code[np.maximum(at - 1, 0)], NONE)
                    after = np.where((i < windows[owner] - 1) | (right[owner] > 0), code[np.minimum(at + span, len(code) - 1)], NONE)
                    out["beside"] = (1 << before.astype(np.int16)) | (32 << after.astype(np.int16))
                yield pa.RecordBatch.from_arrays([pa.array(out[x], pa.int16() if x == "beside" else None) for x in wanted], names=list(wanted))

    return distinct.select("id", "run").mapInArrow(run, schema)


def compacted(distinct: DataFrame, span: int = SPAN) -> DataFrame:
    """``id, skip, n, begins, ends``: the nonbranching paths of ``n`` k-mers, from the ``skip``-th of each distinct run on.

    An edge leads on to the next without a branch if the one is always followed by the same letter and the other always
    has the same letter before it. Counting the letters beside each edge over all runs and joining them back to those edges
    that branch gives the places where paths part; ``begins`` and ``ends`` tell whether a path does begin or end at the
    ends of its run, or goes on in the neighbouring run of the record.
    """
    single = lambda bits: bits.isin(1, 2, 4, 8)
    seen = edges(distinct, ("edge", "beside"), span).groupBy("edge").agg(F.bit_or("beside").cast("int").alias("m"))
    judged = seen.select("edge", single(F.col("m").bitwiseAND(31)).alias("one_in"), single(F.shiftright("m", 5).bitwiseAND(31)).alias("one_out"))
    parting = judged.filter("NOT (one_in AND one_out)")
    spots = edges(distinct, ("edge", "id", "i"), span).join(parting.hint("merge"), "edge")
    sides = F.array(F.struct(F.col("i").alias("c"), (~F.col("one_in")).alias("parts")), F.struct((F.col("i") + 1).alias("c"), (~F.col("one_out")).alias("parts")))
    parts = spots.select("id", F.explode(sides).alias("s")).select("id", "s.*").filter("parts")
    bounds = distinct.select("id", F.explode(F.array(F.lit(0), F.col("windows"))).alias("c"), F.lit(False).alias("parts"))
    told = parts.unionByName(bounds).repartition("id").groupBy("id", "c").agg(F.bool_or("parts").alias("parts"))
    w = W.partitionBy("id").orderBy("c")
    paths = told.select("id", F.col("c").alias("skip"), (F.lead("c").over(w) - F.col("c")).alias("n"), F.col("parts").alias("begins"), F.lead("parts").over(w).alias("ends"))
    return paths.filter("n IS NOT NULL")


def placed_paths(df: DataFrame, name: Column, row: Column, seq: Column, span: int = SPAN) -> DataFrame:
    """``doc, key, path, name, row, at``: the nonbranching paths of k-mers at each of their places.

    Only runs whose seed lies in more than one name take part, and equal runs stand for all their copies, so a group of copies costs
    one run. Paths that go on in the next run of a record are joined. The path is the text itself, taken from
    the source at its coordinates, and ``key`` its digest, so equal keys are equal spans, whatever the numbers of the k-mers said.
    All joins are on sorted keys: no side is bounded, and a run that a third of the records have is split by adaptive skew handling.
    """
    source = records(df, name, row, seq)
    runs = cut(seeded_runs(source, span))
    seeds = runs.groupBy("seed").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).filter("lo <> hi").select("seed")
    held = cut(runs.join(seeds.hint("merge"), "seed", "left_semi").select("doc", "at", "run", "windows"))
    distinct = cut(held.groupBy("run").agg(F.first("windows").alias("windows")).withColumn("id", F.monotonically_increasing_id()))
    known = distinct.select("run", "id").join(compacted(distinct, span).hint("merge"), "id")
    there = held.select("run", "doc", "at").distinct().join(known.drop("id").hint("merge"), "run")
    steps = there.select("doc", (F.col("at") + F.col("skip")).alias("at"), "n", "begins", "ends")
    w = W.partitionBy("doc").orderBy("at")
    goes_on = ~F.col("begins") & ~F.lag("ends").over(w) & (F.lag("at").over(w) + F.lag("n").over(w) == F.col("at"))
    headed = steps.withColumn("head", F.when(goes_on, 0).otherwise(1))
    numbered = headed.withColumn("k", F.sum("head").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    joined = numbered.groupBy("doc", "k").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n"))
    read = joined.join(source.hint("merge"), "doc")
    path = F.substring("seq", F.col("at") + 1, F.col("n") + (span - 1))
    return read.select("doc", F.upper(path).alias("path"), "name", "row", "at").withColumn("key", F.unhex(F.md5("path")))


def shared_paths(df: DataFrame, name: Column, row: Column, seq: Column, span: int = SPAN) -> DataFrame:
    """``doc, key, path, name, row, at``: every place of a path of k-mers that lies in more than one name."""
    placed = cut(placed_paths(df, name, row, seq, span))
    several = placed.groupBy("key").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).filter("lo <> hi").select("key")
    return placed.join(several.hint("merge"), "key", "left_semi")


def span_pairs(paths: DataFrame) -> DataFrame:
    """Distinct ``name_a < name_b`` that have a path in common."""
    owners = cut(paths.select("key", "name").distinct())
    left, right = owners.withColumnRenamed("name", "name_a"), owners.withColumnRenamed("name", "name_b")
    return left.join(right.hint("merge"), "key").filter("name_a < name_b").select("name_a", "name_b").distinct()


def shared_share(df: DataFrame, paths: DataFrame, name: Column, row: Column, seq: Column) -> DataFrame:
    """``row, name, n_letters, n_shared, longest``: how much of each record lies in spans that other names have too.

    ``n_letters`` are the letters without gaps; ``longest`` is the longest stretch covered by shared spans.
    """
    letters = F.translate(seq, "-", "")
    doc = lambda r, n, s: F.xxhash64(n, r, s)
    periods = merged_periods(paths, F.col("doc"), F.col("at"), F.col("at") + F.length("path"))
    covered = periods.groupBy("key").agg(F.sum(F.col("period_end") - F.col("period_start")).alias("n_shared"), F.max(F.col("period_end") - F.col("period_start")).alias("longest"))
    records = df.select(row.cast("long").alias("row"), name.alias("name"), letters.alias("s"))
    keyed = records.select("row", "name", F.coalesce(F.length("s"), F.lit(0)).cast("long").alias("n_letters"), F.when(F.col("name").isNotNull(), doc(F.col("row"), F.col("name"), F.col("s"))).alias("key"))
    zero = F.lit(0).cast("long")
    return keyed.join(covered.hint("merge"), "key", "left").select("row", "name", "n_letters", F.coalesce("n_shared", zero).alias("n_shared"), F.coalesce("longest", zero).alias("longest"))
