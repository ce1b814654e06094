"""Session helpers: lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A written table above this many bytes, uncompressed, is never broadcast.
BROADCAST_BYTES = 8 << 20

_folders: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster has to name it in ``spark.checkpoint.dir``; only a session on one machine (``local``), as in tests,
    gets a private folder where that is unset.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and context.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="clademill-"))
    return context.getCheckpointDir()


def table_dir(spark: SparkSession) -> str:
    """The folder of the session's written tables; it is deleted when the application ends."""
    at = checkpoint_dir(spark)
    if at not in _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/tables")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders[at] = f"{at}/tables"
    return _folders[at]


def width(kind: T.DataType, value: Column) -> Column:
    """Bytes of a value in memory, nearly."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 24
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(value), F.lit(0)) * 16 + 24
    return F.lit(16)


def written(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``df`` as a table in the shared checkpoint folder, read back, and ``counts`` of its rows, taken while writing.

    A new lineage that survives executors. Unlike a checkpoint, which hands on the estimated sizes of the plan
    it replaces, a written table has a size of its own. That is the size of compressed files, which says little about memory; so
    bytes are measured too, and joins with a table above ``BROADCAST_BYTES`` are told to shuffle.
    """
    spark = df.sparkSession
    path = f"{table_dir(spark)}/{uuid.uuid4().hex}"
    seen = Observation()
    size = sum((width(f.dataType, df[f"`{f.name}`"]) for f in df.schema.fields), F.lit(0))
    df.observe(seen, F.sum(size.cast("long")).alias("bytes"), *[c.cast("long").alias(name) for name, c in counts.items()]).write.parquet(path)
    found = {k: v or 0 for k, v in seen.get.items()}
    table = spark.read.schema(df.schema).parquet(path)
    return (table.hint("merge") if found["bytes"] > BROADCAST_BYTES else table), found


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table and read back, as ``written`` does it."""
    return written(df)[0]


def is_empty(df: DataFrame) -> bool:
    """True if ``df`` has no rows; reads at most one row."""
    return not df.take(1)
