"""Splitting oversized texts at natural boundaries, measured in tokens, with overlapping pieces."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clademill.functions.arrays import running_totals
from clademill.llm import encode as enc

LIMIT, OVERLAP = 512, 32
#: Lines that begin a message, a file or a hunk of a commit; any other line is a plain one.
LINES = re.compile(rb"(?m)^(?:(commit [0-9a-f]{7,40}\b|From [0-9a-f]{7,40} |sha: [0-9a-f]{7,40}\b)|(diff --git )|(@@ -))")
# The mark of a token by what ends with it; strength rises to the right.
CUT_INSIDE, CUT_CHARACTER, CUT_PIECE, CUT_LINE, CUT_HUNK, CUT_FILE, CUT_MESSAGE = range(7)
MARKS = "xcwlhfm"


def strengths(text: bytes) -> np.ndarray:
    """The strength of a cut before each byte of ``text``, and at its end."""
    data = np.frombuffer(text, np.uint8)
    out = np.full(len(data) + 1, CUT_CHARACTER, np.uint8)
    out[:-1][(data & 0xC0) == 0x80] = CUT_INSIDE
    feed = np.flatnonzero(data == 10)
    out[feed + 1] = CUT_LINE
    for found in LINES.finditer(text):
        out[found.start()] = CUT_MESSAGE if found[1] else CUT_FILE if found[2] else CUT_HUNK
    out[feed] = np.maximum(out[feed], out[feed + 1])  # before the line feed is as good as after it
    return out


def marked(df: DataFrame, text: str, keep: list[str], limit: int, folder: str | None = None, ranks: str = enc.RANKS) -> DataFrame:
    """``keep``, ``text``, ``n_tokens`` and, of texts above ``limit``, the byte ``ends`` and ``marks`` of their tokens."""
    path = os.path.join(folder or enc.TOKENIZERS, ranks)
    schema = T.StructType([df.schema[x] for x in keep] + [
        T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ends", T.ArrayType(T.IntegerType(), False)), T.StructField("marks", T.StringType())])
    kept = list(keep)
    letters = np.frombuffer(MARKS.encode(), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = enc.piece_encoder(path)
        for batch in batches:
            pieces = batch.column(len(kept))
            offsets, ids = work(pieces)
            lengths = work.lengths[ids]
            ends, marks = [], []
            texts = pc.binary_join(pieces, "")
            for k in np.flatnonzero(np.diff(offsets) > limit):
                raw = texts[k].as_buffer().to_pybytes()
                at = np.cumsum(lengths[offsets[k] : offsets[k + 1]])
                force = strengths(raw)
                own = np.cumsum(pc.binary_length(pieces[k].values).to_numpy(zero_copy_only=False))
                force[own] = np.maximum(force[own], CUT_PIECE)
                ends.append((k, at))
                marks.append(letters[force[at]].tobytes().decode())
            count = np.zeros(len(batch) + 1, np.int32)
            for k, at in ends:
                count[k + 1] = len(at)
            mask = np.ones(len(batch), bool)
            mask[[k for k, _ in ends]] = False
            values = np.concatenate([at for _, at in ends] or [np.zeros(0, np.int64)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(count), pa.int32()), pa.array(values), mask=pa.array(mask))
            said = np.full(len(batch), None, object)
            said[~mask] = marks
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], texts, pa.array(np.diff(offsets)), lists, pa.array(said, pa.string())],
                schema=pa.schema([*(batch.schema.field(i) for i in range(len(kept))), ("text", pa.string()), ("n_tokens", pa.int64()), ("ends", pa.list_(pa.int32())), ("marks", pa.string())]))

    return df.select(*[F.col(x) for x in kept], enc.pieces(F.col(text)).alias("__pieces")).mapInArrow(run, schema)


def cut_pattern(step: int) -> str:
    """Bounded alternatives, strongest boundary first: the whole rest, then the last message, file, hunk or line
    end of the second half of a step, then those of the first half in the same order, then a piece, and at last a
    character, of which each has at most four tokens."""
    half = max(0, step // 2 - 1)
    late = [f".{{{half},{step - 1}}}{m}" for m in "mfhl"]
    early = [f".{{0,{half}}}{m}" for m in "mfhl"]
    return "|".join([rf".{{1,{step}}}\z", *late, *early, f".{{0,{step - 1}}}w", f".{{0,{step - 1}}}[^x]"])


def stops(marks: Column, step: int) -> Column:
    """The token numbers at which the new parts of the pieces of a marked text end."""
    return running_totals(F.transform(F.regexp_extract_all(marks, F.lit(cut_pattern(step)), F.lit(0)), F.length))


def with_spans(df: DataFrame, step: int, overlap: int) -> DataFrame:
    """Adds ``spans``, an array of ``(start, stop)`` token numbers of the pieces.

    Texts without marks are one piece. Pieces after the first begin ``overlap`` tokens before the end of the one
    before, or up to three later where that would be inside a character.
    """
    whole = F.array(F.col("n_tokens").cast("int"))
    ended = df.withColumn("stops", F.when(F.col("marks").isNull(), whole).otherwise(stops(F.col("marks"), step)))

    def piece(stop: Column, k: Column) -> Column:
        before = F.coalesce(F.get(F.col("stops"), k - 1), F.lit(0))
        back = F.greatest(before - overlap, F.lit(0))
        inside = F.when(back > 0, F.length(F.regexp_extract(F.substring(F.col("marks"), back, F.lit(8)), "^x*", 0))).otherwise(0)
        return F.struct(F.least(back + inside, before).alias("start"), stop.alias("stop"))

    return ended.withColumn("spans", F.transform("stops", piece))


def split_texts(df: DataFrame, item: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, folder: str | None = None, ranks: str = enc.RANKS) -> DataFrame:
    """``item, piece, n_pieces, start_token, n_tokens, text``: texts above ``limit`` tokens in overlapping pieces.

    Each piece has at most ``limit`` tokens; neighbours share ``overlap`` tokens; no character is cut. Texts within the limit are one
    piece; null and empty texts are one piece of 0 tokens with the text as it is (null stays null). Offsets are in
    bytes, so a cut costs the same anywhere in a long text.
    """
    if overlap < 0 or limit - overlap < 4:
        raise ValueError("limit must exceed overlap by the tokens of a character, 4")
    step = limit - overlap
    m = marked(df, text, [item], limit, folder, ranks).withColumn("raw", F.encode("text", "UTF-8"))
    m = with_spans(m, step, overlap)

    def piece(s: Column, k: Column) -> Column:
        low = F.coalesce(F.get(F.col("ends"), s["start"] - 1), F.lit(0))
        high = F.get(F.col("ends"), s["stop"] - 1)
        part = F.when(F.col("marks").isNull(), F.col("text")).otherwise(F.decode(F.substring("raw", low + 1, high - low), "UTF-8"))
        return F.struct(k.alias("piece"), s["start"].alias("start_token"), (s["stop"] - s["start"]).cast("long").alias("n_tokens"), part.alias("text"))

    return m.select(F.col(item), F.size("spans").alias("n_pieces"), F.explode(F.transform("spans", piece)).alias("p")).select(item, "p.piece", "n_pieces", "p.start_token", "p.n_tokens", "p.text")
