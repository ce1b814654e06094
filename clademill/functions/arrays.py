"""Folds over arrays whose results are arrays, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Results that are copied at each step; full blocks are set aside, so that a long result does not cost its square.
BLOCK = 256


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def blocks(kind: str) -> tuple[Column, Column]:
    """The empty start of a result of elements of type ``kind``: full blocks and the one that grows."""
    return F.array().cast(f"array<array<{kind}>>").alias("full"), F.array().cast(f"array<{kind}>").alias("part")


def appended(state: Column, item: Column, wanted: Column | None = None) -> tuple[Column, Column]:
    """The blocks of ``state`` with ``item`` at the end, if it is ``wanted``."""
    ready = F.size(state["part"]) >= BLOCK
    full = F.when(ready, F.concat(state["full"], F.array(state["part"]))).otherwise(state["full"])
    part = F.when(ready, F.array(item)).otherwise(F.concat(state["part"], F.array(item)))
    if wanted is not None:
        full, part = F.when(wanted, full).otherwise(state["full"]), F.when(wanted, part).otherwise(state["part"])
    return full.alias("full"), part.alias("part")


def collected(state: Column) -> Column:
    """The elements of the blocks of ``state``."""
    return F.flatten(F.concat(state["full"], F.array(state["part"])))


def running_totals(numbers: Column) -> Column:
    """The sums of the first one, two, and so on, of ``numbers``."""
    start = F.struct(*blocks("int"), F.lit(0).alias("total"))

    def step(state: Column, n: Column) -> Column:
        total = state["total"] + n
        return F.struct(*appended(state, total), total.alias("total"))

    return F.aggregate(numbers, start, step, collected)
