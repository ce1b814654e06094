"""Rows that fail to parse: structural indexing of delimited lines into typed rows and reasoned rejects."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clademill.functions.names import WHITE

QUOTE, COMMA, LF, CR = 34, 44, 10, 13
#: Structural reasons by code, strongest first; 0 stands for none.
REASONS = ("", "null line", "unclosed quote", "line break outside quotes", "quote inside an unquoted field",
           "text after a closing quote", "wrong number of fields")


def index_lines(lines: pa.Array, n_fields: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Reason code of each line, and its fields (null where the code is not 0).

    Works on the bytes of the whole batch: the running parity of the quotes of a line tells which bytes lie
    inside quotes, commas at even parity are delimiters, line breaks at even parity end a record too early.
    """
    lines = lines.cast(pa.large_string())
    n = len(lines)
    null = np.asarray(lines.is_null())
    lines = lines.fill_null("")
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + n + 1]
    body = lines.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    length = np.diff(offsets)
    start = offsets[:-1] - offsets[0]
    line = np.repeat(np.arange(n), length)

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.bincount(line[mask], minlength=n)

    quote = data == QUOTE
    running = np.concatenate([[0], np.cumsum(quote)])
    inside_from = running[:-1] - running[start][line]  # quotes of the line before this byte
    odd_before = (inside_from & 1).astype(bool)
    odd_after = odd_before ^ quote
    last = start + length - 1
    filled = length > 0
    final = np.zeros(len(data), bool)
    final[last[filled]] = True
    end_cr = final & (data == CR) & ~odd_before
    delim = (data == COMMA) & ~odd_before
    broken = ((data == LF) | (data == CR)) & ~odd_before & ~end_cr

    nothing = np.zeros(1, bool)
    first = np.zeros(len(data), bool)
    first[start[filled]] = True
    field_first = first | np.concatenate([nothing, delim[:-1]])[: len(data)]
    following = np.concatenate([delim[1:] | end_cr[1:], nothing])[: len(data)]
    field_last = final | following
    previous_quote = np.concatenate([nothing, quote[:-1]])[: len(data)] & ~first
    next_quote = np.concatenate([quote[1:], nothing])[: len(data)] & ~final
    opening, closing = quote & odd_after, quote & ~odd_after
    inner = opening & ~field_first & ~(previous_quote & ~odd_before)
    trailing = closing & ~field_last & ~next_quote

    code = np.zeros(n, np.int64)
    for k, bad in ((6, per_line(delim) != n_fields - 1), (5, per_line(trailing) > 0), (4, per_line(inner) > 0),
                   (3, per_line(broken) > 0), (2, per_line(quote) % 2 == 1), (1, null)):
        code[bad] = k

    position = np.cumsum(delim) - delim
    position = position - (position[start[filled]].repeat(length[filled]) if len(data) else 0)
    keep = ~delim & ~end_cr & ~opening & ~(closing & field_last) & (code == 0)[line]
    fields = []
    valid = pa.py_buffer(np.packbits(code == 0, bitorder="little").tobytes())
    for k in range(n_fields):
        own = keep & (position == k)
        ends = np.concatenate([[0], np.cumsum(per_line(own))]).astype(np.int64)
        fields.append(pa.Array.from_buffers(pa.large_string(), n, [valid, pa.py_buffer(ends), pa.py_buffer(data[own].tobytes())]).cast(pa.string()))
    return code, fields


def split_lines(df: DataFrame, raw: str, fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, a struct ``fields`` of texts and the structural ``reason`` (null if none).

    Null lines get the reason ``null line``; an empty line has one empty field. Only ``keep`` and ``raw``
    are read, so other columns of any name are ignored.
    """
    names = list(fields)
    inner = T.StructType([T.StructField(x, T.StringType()) for x in names])
    schema = T.StructType([df.schema[x] for x in keep] + [T.StructField("fields", inner), T.StructField("reason", T.StringType())])
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = pa.array([x or None for x in REASONS])
        for batch in batches:
            code, parts = index_lines(batch.column(len(kept)), len(names))
            struct = pa.StructArray.from_arrays(parts, names=names)
            columns = [batch.column(i) for i in range(len(kept))] + [struct, said.take(pa.array(code))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "fields", "reason"])

    source = df.select(*[F.col(x) for x in kept], F.col(raw).alias("__raw"))
    return source.mapInArrow(run, schema)


def first_reason(structural: Column, checks: Sequence[tuple[Column, str]]) -> Column:
    """The structural reason, else the text of the first check that is not true, else null."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in checks]
    return F.coalesce(structural, *broken)


def parse_contig_lines(df: DataFrame, raw: str = "raw", keep: Sequence[str] = ("raw_id",)) -> DataFrame:
    """Typed contig records, or the reason why a line is none.

    Columns: ``keep``, ``seq_id``, ``loaded_on`` (date), ``n_bases`` (int), ``seq``, ``description``, ``reason``.
    Valid lines have a null ``reason``; rejected ones have nulls in the typed columns. One row comes out for
    each row that goes in; repeated rows stay repeated.
    """
    s = split_lines(df, raw, ("seq_id", "loaded_on", "n_bases", "seq", "description"), keep)
    f = F.col("fields")
    digits = F.regexp_replace(f["n_bases"], r"^0+(?=[0-9])", "")
    checks = [
        (f["seq_id"].rlike(rf"^[^|{WHITE}]+\|[^|{WHITE}]+\z"), "seq_id is not taxon|contig"),
        (f["loaded_on"].rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & f["loaded_on"].try_cast("date").isNotNull(), "loaded_on is no day"),
        (f["n_bases"].rlike(r"^[0-9]+\z"), "n_bases is no number"),
        (f["seq"].rlike(r"^[ACGTURYSWKMBDHVNacgturyswkmbdhvn-]+\z"), "seq has other letters or none"),
        (digits == F.length(f["seq"]).cast("string"), "n_bases is not the length of seq"),
    ]
    r = s.withColumn("reason", first_reason(F.col("reason"), checks))
    good = F.col("reason").isNull()
    return r.select(
        *keep,
        F.when(good, f["seq_id"]).alias("seq_id"),
        F.when(good, f["loaded_on"].try_cast("date")).alias("loaded_on"),
        F.when(good, f["n_bases"].try_cast("int")).alias("n_bases"),
        F.when(good, f["seq"]).alias("seq"),
        F.when(good, f["description"]).alias("description"),
        "reason",
    )
