"""Operators that are sequential within a group: constrained linkage and assembly of fragment paths."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clademill.operators.graph import connected_components
from clademill.session import cut, written


#: Edges of one connected component that one task links; larger components are linked in rounds of joins.
LOCAL_EDGES = 200_000


def constrained_linkage(edges: DataFrame, cannot: DataFrame) -> DataFrame:
    """``group_id, component, cluster, seq_name``: single linkage by rising distance under cannot-link pairs.

    ``edges`` (group_id, a, b, distance) are taken in the order of distance, a, b; two clusters join unless some pair of
    their members is in ``cannot`` (group_id, a, b). Edges of different connected components never meet, so each
    component of at most ``LOCAL_EDGES`` edges is linked in a task of its own; for larger ones ``linkage_rounds`` gives the
    same result without a sequential pass.
    """
    comp = cut(connected_components(edges, "a", "b", "group_id"))
    inside = comp.select("group_id", F.col("vertex").alias("a"), "component")
    kind = edges.schema["group_id"].dataType.simpleString()
    links = edges.select("group_id", "a", "b", F.col("distance").cast("double").alias("distance")).join(inside, ["group_id", "a"])
    barred = cannot.select("group_id", "a", "b", F.lit(None).cast("double").alias("distance")).join(inside, ["group_id", "a"])
    barred = barred.join(comp.select("group_id", F.col("vertex").alias("b"), F.col("component").alias("cb")), ["group_id", "b"]).filter("component = cb").drop("cb")
    names = ["group_id", "component", "a", "b", "distance"]
    rows = cut(links.select(names).unionByName(barred.select(names)))
    large, found = written(rows.groupBy("group_id", "component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LOCAL_EDGES), n=F.count(F.lit(1)))
    small = rows.join(large, ["group_id", "component"], "left_anti") if found["n"] else rows

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        apart: dict[str, set[str]] = {}
        for a, b in rows.loc[rows["distance"].isna(), ["a", "b"]].itertuples(index=False):
            apart.setdefault(a, set()).add(b)
            apart.setdefault(b, set()).add(a)
        own: dict[str, set[str]] = {}
        for a, b in rows[rows["distance"].notna()].sort_values(["distance", "a", "b"])[["a", "b"]].itertuples(index=False):
            x, y = own.setdefault(a, {a}), own.setdefault(b, {b})
            if x is y or any(not apart.get(m, set()).isdisjoint(y) for m in x):
                continue
            x |= y
            for m in y:
                own[m] = x
        return pd.DataFrame([(key[0], key[1], min(c), m) for m, c in own.items()], columns=["group_id", "component", "cluster", "seq_name"])

    done = small.groupBy("group_id", "component").applyInPandas(run, f"group_id {kind}, component string, cluster string, seq_name string")
    if not found["n"]:
        return done
    rest = cut(rows.join(large, ["group_id", "component"], "left_semi"))
    linked = linkage_rounds(rest.filter("distance IS NOT NULL"), rest.filter("distance IS NULL"))
    return done.unionByName(linked.join(comp.select("group_id", F.col("vertex").alias("seq_name"), "component"), ["group_id", "seq_name"]).select("group_id", "component", "cluster", "seq_name"))


def linkage_rounds(edges: DataFrame, cannot: DataFrame) -> DataFrame:
    """``group_id, cluster, seq_name``: the linkage in rounds; in each, every edge that is the smallest of both its clusters joins them.

    An edge inside a cluster or between clusters with a cannot-link pair never counts again, as clusters only grow. So nothing
    that comes earlier in the order can change the two clusters of such an edge, and the order of single linkage is kept.
    """
    ends = edges.select("group_id", F.explode(F.array("a", "b")).alias("seq_name")).distinct()
    members = cut(ends.withColumn("cluster", F.col("seq_name")))
    live = edges.select("group_id", F.struct("distance", "a", "b").alias("e"), F.col("a").alias("x"), F.col("b").alias("y"))
    both = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
    barred = cut(cannot.select("group_id", F.explode(both).alias("p")).select("group_id", "p.x", "p.y").distinct())
    live = live.join(barred, ["group_id", "x", "y"], "left_anti")
    while True:
        live, left = written(live.groupBy("group_id", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("e").alias("e")), n=F.count(F.lit(1)))
        if not left["n"]:
            return members
        first = live.select("group_id", "e", F.explode(F.array("x", "y")).alias("x")).groupBy("group_id", "x").agg(F.min("e").alias("e"))
        mutual = live.join(first.withColumnRenamed("e", "ex"), ["group_id", "x"]).join(first.select("group_id", F.col("x").alias("y"), F.col("e").alias("ey")), ["group_id", "y"]).filter("e = ex AND e = ey")
        moves = cut(mutual.select("group_id", F.col("y").alias("old"), F.col("x").alias("new")))
        renamed = lambda df, c: df.join(moves.withColumnRenamed("old", c), ["group_id", c], "left").withColumn(c, F.coalesce("new", c)).drop("new")
        members = cut(renamed(members, "cluster"))
        barred = cut(renamed(renamed(barred, "x"), "y").distinct())
        live = renamed(renamed(live, "x"), "y").filter("x <> y").join(barred, ["group_id", "x", "y"], "left_anti")


def fragment_paths(rows: DataFrame, max_overlap: int, overlap_cost: float = 1.0, mismatch_cost: float = 20.0) -> DataFrame:
    """``group_id, taxon, path, score, seq``: records of one taxon chained from left to right into longer ones.

    The records of a taxon in a group, by start, form a graph with an edge where the next one starts later and
    shares at most ``max_overlap`` columns. The best chain, by covered columns less costs of overlapping and of
    differing columns, is taken out again and again until no record is left. The best chain is found by dynamic
    programming over the ends, not by listing all. ``seq`` has the first record's letter where several have one.
    Common columns are counted once for all chains, as products of matrices; after a chain is taken out only the ends
    are placed again whose best chain went through it, since the scores of the others cannot have changed.
    """
    kind = rows.schema["group_id"].dataType.simpleString()
    types = [to_arrow_type(rows.schema["group_id"].dataType), pa.string(), pa.string(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (x for t in batches for x in zip(*(t[c].to_pylist() for c in ("group_id", "taxon", "seq_name", "seq"))))
        done = (x for key, part in itertools.groupby(every, key=lambda x: x[:2]) for x in chains(key, part))
        while held := list(itertools.islice(done, 5_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], ["group_id", "taxon", "path", "score", "seq"])

    def chains(key: tuple, part: Iterator[tuple]) -> list[tuple]:
        found = []
        for *_, name, seq in part:
            filled = seq.replace("N", "-")
            if held := filled.strip("-"):
                lo = len(filled) - len(filled.lstrip("-"))
                found.append((lo, lo + len(held), name, seq))
        found.sort(key=lambda x: x[:3])
        if len(found) == 1:
            ((_, _, name, seq),) = found
            return [(*key, f"{key[1]}|{name.split('|', 1)[-1]}", float(len(seq) - seq.count("-") - seq.count("N")), seq.replace("N", "-"))]
        n, across = len(found), max((len(x[3]) for x in found), default=0)
        grid = np.full((n, across), ord("-"), np.uint32)
        for i, (*_, seq) in enumerate(found):
            grid[i, : len(seq)] = np.frombuffer(seq.encode("utf-32-le"), np.uint32)
        where = (grid != ord("-")) & (grid != ord("N"))
        starts, full = np.array([x[0] for x in found], np.int64), where.sum(1)
        before = np.searchsorted(starts, starts)  # so many records start earlier
        occupied = where.astype(np.float32)
        letters = [((grid == x) & where).astype(np.float32) for x in np.unique(grid[where])] if n else []
        edges = []
        for lo in range(0, n, 256):
            hi = min(n, lo + 256)
            share = occupied[lo:hi] @ occupied[:hi].T
            equal = sum((x[lo:hi] @ x[:hi].T for x in letters), np.zeros_like(share))
            for i in range(lo, hi):
                common = share[i - lo, : before[i]]
                near = np.flatnonzero(common <= max_overlap)
                both = common[near].astype(np.int32)
                edges.append((near.astype(np.int32), both, both - equal[i - lo, near].astype(np.int32)))
        later: list[list[int]] = [[] for _ in range(n)]
        score, link = full.astype(float), np.full(n, -1)
        alive = np.ones(n, bool)

        def place(i: int) -> None:
            earlier, common, differ = edges[i]
            score[i], link[i] = float(full[i]), -1
            if len(earlier):
                value = score[earlier] + full[i] - common - overlap_cost * common - mismatch_cost * differ
                m = int(np.argmax(value))
                if value[m] > score[i]:
                    score[i], link[i] = value[m], earlier[m]
                    later[link[i]].append(i)

        for i in range(n):
            place(i)
        out = []
        while alive.any():
            best = score[alive].max()
            ends = np.flatnonzero(alive & (score == best))

            def chain(i: int) -> list[int]:
                path = [i]
                while link[path[-1]] >= 0:
                    path.append(int(link[path[-1]]))
                return path[::-1]

            path = max((chain(int(i)) for i in ends), key=lambda p: [-ord(c) for c in found[p[0]][2]])
            text = grid[path[0]].copy()
            text[text == ord("N")] = ord("-")
            for i in path[1:]:
                spots = where[i] & (text == ord("-"))
                text[spots] = grid[i, spots]
            text = text[: max(len(found[path[0]][3]), *(found[i][1] for i in path))]
            out.append((key[0], key[1], "|".join([key[1], *(found[i][2].split("|", 1)[-1] for i in path)]), float(best), text.tobytes().decode("utf-32-le")))
            alive[path] = False
            score[path] = -np.inf
            # only ends whose best chain went through a record that is gone are placed again, from left to right
            todo = [i for m in path for i in later[m] if alive[i] and link[i] == m]
            heapq.heapify(todo)
            while todo:
                i = heapq.heappop(todo)
                while todo and todo[0] == i:
                    heapq.heappop(todo)
                old = score[i]
                place(i)
                if score[i] != old:
                    for x in later[i]:
                        if alive[x] and link[x] == i:
                            heapq.heappush(todo, x)
        return out

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = rows.select("group_id", "taxon", "seq_name", "seq").repartition(tasks, "group_id", "taxon").sortWithinPartitions("group_id", "taxon")
    return parted.mapInArrow(run, f"group_id {kind}, taxon string, path string, score double, seq string")
