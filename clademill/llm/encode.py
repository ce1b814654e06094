"""Encoding of a text column with a public byte-pair tokenizer, and its inverse."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clademill.functions.names import WHITE
from clademill.llm.tokenizer import Decoder, Transducer, load_ranks, token_lengths

#: Folder of the vocabulary files; the same path must exist on each executor.
TOKENIZERS = os.environ.get("CLADEMILL_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the tokenizer's pattern, with the Unicode white space that Java's \s leaves out.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Pieces of text whose ids a worker keeps; beyond that it starts anew.
CACHE = 500_000

_workers: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Ids of many pieces of text at once, kept for the life of a Python worker."""

    def __init__(self, path: str) -> None:
        self.ranks = load_ranks(path)
        self.machine = Transducer(self.ranks)
        self.lengths = token_lengths(self.ranks)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # the number of each piece
        self.count, self.values = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __call__(self, pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the token lists of the rows; a null row has none."""
        coded = pc.list_flatten(pieces).dictionary_encode()
        if len(self.known) > CACHE:
            self.forget()
        known, each = self.known, coded.dictionary.to_pylist()
        new = sorted(x for x in each if x not in known)
        if new:
            found, ids = self.machine.encode_sorted([x.encode() for x in new])
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.count = np.concatenate([self.count, np.array(found, np.int64)])
            self.values = np.concatenate([self.values, np.array(ids, np.int32)])
        number = np.fromiter(map(known.__getitem__, each), np.int64, len(each))
        count, values, begin = self.count[number], self.values, (np.cumsum(self.count) - self.count)[number]
        index = coded.indices.to_numpy(zero_copy_only=False)
        n = count[index]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = values[np.repeat(begin[index] - upto[:-1], n) + np.arange(upto[-1])]
        rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False))])
        return upto[rows], ids


def piece_encoder(path: str) -> PieceEncoder:
    """The worker's encoder for the rank file ``path``."""
    if path not in _workers:
        _workers[path] = PieceEncoder(path)
    return _workers[path]


def pieces(text: Column) -> Column:
    """The pieces of a text between which no merge happens; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0))


def encode(df: DataFrame, text: str, keep: list[str], folder: str | None = None, ranks: str = RANKS) -> DataFrame:
    """``keep`` columns and ``ids``, the token ids of ``text`` without special tokens.

    Null and empty texts get an empty list. The JVM splits the texts into pieces; a batch's distinct pieces are
    encoded once and its rows gathered from them. Nothing is shuffled, each row is read once, other columns
    are ignored.
    """
    path = os.path.join(folder or TOKENIZERS, ranks)
    schema = T.StructType([df.schema[x] for x in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = piece_encoder(path)
        for batch in batches:
            offsets, ids = work(batch.column(len(kept)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], lists], names=[*kept, "ids"])

    return df.select(*[F.col(x) for x in kept], pieces(F.col(text)).alias("__pieces")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, keep: list[str], folder: str | None = None, ranks: str = RANKS) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of ``text``; 0 for null and empty texts."""
    path = os.path.join(folder or TOKENIZERS, ranks)
    schema = T.StructType([df.schema[x] for x in keep] + [T.StructField("n_tokens", T.LongType())])
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = piece_encoder(path)
        for batch in batches:
            offsets, _ = work(batch.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.diff(offsets))], names=[*kept, "n_tokens"])

    return df.select(*[F.col(x) for x in kept], pieces(F.col(text)).alias("__pieces")).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, keep: list[str], folder: str | None = None, ranks: str = RANKS) -> DataFrame:
    """``keep`` columns and ``text``, the text of the token ``ids``; broken UTF-8 becomes U+FFFD, null stays null.

    The bytes of a batch are gathered at once; only rows with broken UTF-8, which ids cut anywhere may give, go through the
    streaming machine one by one.
    """
    path = os.path.join(folder or TOKENIZERS, ranks)
    schema = T.StructType([df.schema[x] for x in keep] + [T.StructField("text", T.StringType())])
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Decoder(load_ranks(path))
        for batch in batches:
            lists = batch.column(len(kept))
            data, upto = machine.raw(pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            ends = upto[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])]
            valid = np.packbits(pc.is_valid(lists).to_numpy(zero_copy_only=False), bitorder="little")
            found = pa.Array.from_buffers(pa.large_binary(), len(lists), [pa.py_buffer(valid.tobytes()), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
            try:
                texts = found.cast(pa.large_string()).cast(pa.string())
            except pa.ArrowInvalid:
                texts = pa.array([None if x is None else "".join(machine.stream([x])) for x in lists.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], texts], names=[*kept, "text"])

    return df.select(*[F.col(x) for x in kept], F.col(ids).alias("__ids")).mapInArrow(run, schema)
