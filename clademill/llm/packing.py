"""Filling fixed-capacity containers with items by sum-of-squares placement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.session import cut

CAPACITY = 2048
#: Tokens that one task packs; about 4,000 containers, whose level counts then are dense enough.
SHARD_TOKENS = 8_000_000


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container number and offset of each size (1 to ``capacity``), in the order given.

    ``level[h]`` counts the open containers filled up to ``h``. An item goes to the level, or into a new
    container, for which the sum of the squared counts grows least; of equal levels to the fullest. Full
    containers count no more.
    """
    level = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    container, offset, opened = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for k, s in enumerate(sizes.tolist()):
        here, there = level[: capacity - s + 1], level[s:]
        cost = np.where(here > 0, 2 * (there - here) + 2, 1 << 60)
        cost[0] = 2 * level[s] + 1 if s < capacity else 0
        if s < capacity and level[capacity - s]:
            cost[capacity - s] = 1 - 2 * level[capacity - s]
        h = len(cost) - 1 - int(np.argmin(cost[::-1]))
        if h:
            c = waiting[h].pop()
            level[h] -= 1
        else:
            c, opened = opened, opened + 1
        container[k], offset[k] = c, h
        if h + s < capacity:
            level[h + s] += 1
            waiting[h + s].append(c)
    return container, offset


def pack(items: DataFrame, item: str, size: str, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``item, piece, container, offset, n_tokens``: where each item lies, no container above ``capacity``.

    An item larger than the capacity is cut into full containers and a rest; all others stay whole. Items
    without size (0 or null) take no space: one row with piece 0, no container, 0 tokens. Repeated items are packed
    as often as they come. Items are dealt to shards of about ``shard_tokens``, whatever their keys; each shard is packed
    by itself and its containers are named ``shard:number``, so work and memory of a task stay bounded.
    """
    sizes = cut(items.select(F.col(item).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")))
    whole = sizes.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-whole // shard_tokens))
    dealt = sizes.filter("size > 0").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    schema = f"item {sizes.schema['item'].dataType.simpleString()}, piece int, container string, offset long, n_tokens long"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", kind="stable")
        n = rows["size"].to_numpy()
        full, rest = n // capacity, n % capacity
        small = rest > 0
        container, offset = place(rest[small], capacity)
        parts = [pd.DataFrame({"item": rows["item"][small], "piece": full[small], "number": container, "offset": offset, "n_tokens": rest[small]})]
        if full.any():
            piece = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
            first = int(container.max()) + 1 if len(container) else 0
            parts.append(pd.DataFrame({"item": rows["item"].repeat(full), "piece": piece, "number": np.arange(full.sum()) + first, "offset": 0, "n_tokens": capacity}))
        out = pd.concat(parts)
        out["container"] = f"{key[0]}:" + out["number"].astype(str)
        return out[["item", "piece", "container", "offset", "n_tokens"]]

    packed = dealt.groupBy("shard").applyInPandas(run, schema)
    none = sizes.filter("size <= 0").select("item", F.lit(0).alias("piece"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("long").alias("offset"), F.lit(0).cast("long").alias("n_tokens"))
    return packed.unionByName(none).withColumnRenamed("item", item)
