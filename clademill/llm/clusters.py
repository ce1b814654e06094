"""Similarity clusters from measured distances: density clustering of reduced vectors in overlapping cells."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clademill.llm.components import components
from clademill.session import cut, written

#: Distances below this are close; the data leave 15 to 20 empty.
CLOSE = 17.5
DIMENSIONS, ROUNDS, SHARPNESS = 32, 5, 4
#: Neighbours in the space of unit vectors; also the width by which cells overlap.
RADIUS = 0.2
#: Points per cell that is aimed at; larger cells are parted.
CELL_POINTS = 2000
#: Records within the radius of a core point, itself included; two, as pairs have to come out as clusters.
MIN_WEIGHT = 2


def measured(df: DataFrame, group: Column, a: Column, b: Column, distance: Column) -> DataFrame:
    """``group, a < b, distance``: the median of a pair's measurements; nulls, NaN and self comparisons are none."""
    rows = df.select(group.alias("group"), a.alias("x"), b.alias("y"), distance.cast("double").alias("distance"))
    rows = rows.filter(F.col("group").isNotNull() & (F.col("x") != F.col("y")) & F.col("distance").isNotNull() & ~F.isnan("distance"))
    pairs = rows.select("group", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    return pairs.groupBy("group", "a", "b").agg(F.median("distance").alias("distance"))


#: Names of the coordinates while they are columns, and SQL for all of them at once; single Column calls would take longer than the work.
V = [f"v{i}" for i in range(DIMENSIONS)]


def with_unit(df: DataFrame) -> DataFrame:
    """``group, name, v``: the coordinates as an array of length one."""
    long = df.selectExpr("`group`", "name", *V, f"sqrt({' + '.join(f'{x} * {x}' for x in V)}) AS norm")
    return long.selectExpr("`group`", "name", f"array({', '.join(f'float({x} / norm)' for x in V)}) AS v")


def sign(name: str, i: int) -> str:
    """SQL of number ``i`` of the random vector of +1 and -1 that depends on the name only."""
    return f"(1 - 2 * (shiftrightunsigned(xxhash64({name}), {i}) & 1))"


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), DIMENSIONS)


def pulls(near: DataFrame, vectors: DataFrame) -> DataFrame:
    """``group, name, v``: sums of the vectors of the close records of each record, by a power of their cosine with its own.

    The join leaves the pairs of a record beside each other, so that each task adds up most of them at once.
    """
    there = vectors.select("group", F.col("name").alias("other"), F.col("v").alias("ov"))
    both = near.join(there, ["group", "other"]).join(vectors, ["group", "name"]).select("group", "name", "v", "ov")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            group, name = batch.column(0), batch.column(1)
            same = pc.and_(pc.equal(group[1:], group[:-1]), pc.equal(name[1:], name[:-1])).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            own, other = matrix(batch.column(2)), matrix(batch.column(3))
            weight = np.maximum(np.einsum("ij,ij->i", own, other), 0) ** SHARPNESS
            total = np.add.reduceat(other * weight[:, None], first, axis=0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * DIMENSIONS, pa.int32()), pa.array(total.astype(np.float32).ravel()))
            take = pa.array(first)
            yield pa.RecordBatch.from_arrays([group.take(take), name.take(take), lists], names=["group", "name", "v"])

    return both.mapInArrow(run, vectors.select("group", "name", "v").schema)


def reduced_vectors(pairs: DataFrame, close: float = CLOSE) -> DataFrame:
    """``group, name, v``: unit vectors that members of one cluster share, nearly.

    A record starts as the sum of random vectors of itself and its close records, so the cosine of two
    records estimates how far their neighbourhoods agree. In each further round it moves towards its close
    records by a power of that cosine. Members of a cluster, whose neighbourhoods agree even if one
    measurement is missing or wrong, fall together; records that one wrong measurement makes close hardly move. The cost is
    proportional to the close pairs, however dense a cluster is. The number of rounds is part of the definition: they sharpen
    the start, they are no search for a fixed point.
    """
    near = pairs.filter(F.col("distance") < close).select("group", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("group", F.col("e.a").alias("name"), F.col("e.b").alias("other"))
    near = cut(near)
    start = near.groupBy("group", "name").agg(*[F.expr(f"sum({sign('other', i)}) AS {x}") for i, x in enumerate(V)])
    vectors = cut(with_unit(start.selectExpr("`group`", "name", *[f"{x} + {sign('name', i)} AS {x}" for i, x in enumerate(V)])))
    for _ in range(ROUNDS - 1):
        moved = pulls(near, vectors).unionByName(vectors).groupBy("group", "name").agg(*[F.expr(f"sum(v[{i}]) AS {x}") for i, x in enumerate(V)])
        vectors = cut(with_unit(moved))
    return vectors


def point_of() -> Column:
    """The name of the fine grid cell of the vector ``v``."""
    grid = RADIUS / DIMENSIONS**0.5
    return F.md5(F.concat_ws(",", F.transform("v", lambda x: F.round(x / grid).cast("int").cast("string"))))


def micro_points(vectors: DataFrame) -> DataFrame:
    """``group, point, v, weight``: records in one fine grid cell, whose diagonal is the radius, are one point.

    The records of a dense spot thus cost one row, however many they are.
    """
    keyed = vectors.withColumn("point", point_of())
    mean = F.expr(f"array({', '.join(f'float(avg(v[{i}]))' for i in range(DIMENSIONS))})")
    return keyed.groupBy("group", "point").agg(mean.alias("v"), F.count(F.lit(1)).alias("weight"))


KEPT = ["point", "v", "weight"]


def parted(rows: DataFrame) -> DataFrame:
    """``group, cell, before, point, v, weight``: each cell of ``rows`` (with its size ``n``) in overlapping cells around some of its points.

    A point lies in the cell of each pivot whose bisector with the point's nearest pivot it passes by half the radius at
    most. The midpoint of two points within the radius has a nearest pivot, and both lie in that one's cell. Pivots are a small
    share of the points, so they are sent to every task.
    """
    many = F.greatest(F.lit(8), F.least(F.lit(256), F.ceil(4 * F.col("n") / CELL_POINTS)))
    pivots: dict[tuple, list] = {}
    for r in rows.filter(F.pmod(F.xxhash64("cell", "point"), F.col("n")) < many).select("group", "cell", "v").collect():
        pivots.setdefault((r["group"], r["cell"]), []).append(r["v"])
    centres = {k: normed(x) for k, x in pivots.items()}

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(["group", "cell"], sort=False):
                c = centres.get(key)
                if c is None:
                    yield part.assign(cell=part["cell"] + ".")
                    continue
                for lo in range(0, len(part), 2048):
                    own = part.iloc[lo : lo + 2048]
                    cosine = normed(own["v"]) @ c.T
                    nearest = cosine.argmax(axis=1)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))[nearest]
                    behind = 2 * (cosine[np.arange(len(own)), nearest][:, None] - cosine)
                    i, j = np.nonzero(behind <= RADIUS * apart + 1e-5)
                    yield own.iloc[i].assign(cell=own["cell"].to_numpy()[i] + "." + j.astype(str).astype(object))

    plain = rows.select("group", "cell", F.col("n").alias("before"), *KEPT)
    return plain.mapInPandas(split, plain.schema)


def cells(points: DataFrame) -> DataFrame:
    """``group, cell, point, v, weight``: overlapping cells of about ``CELL_POINTS`` points at most.

    Two points within ``RADIUS`` share a cell. A group that is small enough is one cell; larger cells are parted again and
    again. Where that hardly separates points, as in a spot no wider than the radius, each pair of blocks of the points
    is a cell.
    """
    found = []
    rest = points.select("group", F.lit("").alias("cell"), F.lit(None).cast("bigint").alias("before"), "point", "v", "weight")
    while True:
        large, n = written(rest.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL_POINTS), n=F.count(F.lit(1)))
        if not n["n"]:
            found.append(rest.select("group", "cell", *KEPT))
            break
        found.append(rest.join(large, ["group", "cell"], "left_anti").select("group", "cell", *KEPT))
        over = cut(rest.join(large, ["group", "cell"]).withColumn("stuck", F.coalesce(F.col("n") > 0.7 * F.col("before"), F.lit(False))))
        blocks = F.ceil(3 * F.col("n") / CELL_POINTS).cast("int")
        block = F.pmod(F.xxhash64("point"), blocks).cast("int")
        both = over.filter("stuck").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        name = F.concat_ws("-", F.concat("cell", F.lit(":"), F.least("block", "other").cast("string")), F.greatest("block", "other").cast("string"))
        found.append(both.select("group", name.alias("cell"), *KEPT))
        rest = cut(parted(over.filter("NOT stuck")))
    return reduce(DataFrame.unionByName, found)


def normed(rows: Iterable) -> np.ndarray:
    """Vectors as rows of length one."""
    v = np.stack([np.asarray(x, dtype=np.float32) for x in rows])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def unit_rows(rows: pa.Table) -> np.ndarray:
    """The vectors ``v`` as rows of length one."""
    v = matrix(rows["v"].combine_chunks())
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def spread(rows: DataFrame) -> DataFrame:
    """Cells by the number of shuffle partitions: they hold few bytes for the work that they make, so they must not be merged by size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group", "cell")


def core_points(held: DataFrame) -> DataFrame:
    """``group, point`` of the points of ``cells`` that have records of ``MIN_WEIGHT`` within the radius in one of their cells.

    For a minimum of two, which one neighbour or one double point meets, that is the same as over all cells.
    """

    def run(rows: pa.Table) -> pa.Table:
        v, weight = unit_rows(rows), rows["weight"].to_numpy()
        total = np.concatenate([(2 - 2 * (v[lo : lo + 512] @ v.T) <= RADIUS**2) @ weight for lo in range(0, len(v), 512)])
        return rows.select(["group", "point"]).filter(pa.array(total >= MIN_WEIGHT))

    kind = held.schema["group"].dataType.simpleString()
    return spread(held).groupBy("group", "cell").applyInArrow(run, f"group {kind}, point string").distinct()


def local_links(points: DataFrame) -> DataFrame:
    """``group, point, rep``: core points with the first one of their local cluster, other points with their nearest core point.

    A local cluster is what core points of one cell reach over core points within ``RADIUS``; a core point that lies in several
    cells links its local clusters. A point that is no core one joins the core point nearest to it within the radius, if
    there is one, and links nothing else.
    """
    held = cut(cells(points))
    flagged = held.join(core_points(held).withColumn("core", F.lit(True)), ["group", "point"], "left").withColumn("core", F.coalesce("core", F.lit(False)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("point")
        names, every, core = rows["point"].combine_chunks(), unit_rows(rows), rows["core"].to_numpy()
        v = every[core]
        first, left = np.arange(len(v)), np.arange(len(v))
        while len(left):
            reached, left = left[:1], left[1:]
            seed = reached[0]
            while len(reached) and len(left):
                near = np.zeros(len(left), dtype=bool)
                for lo in range(0, len(reached), 512):
                    near |= (2 - 2 * (v[reached[lo : lo + 512]] @ v[left].T) <= RADIUS**2).any(axis=0)
                reached, left = left[near], left[~near]
                first[reached] = seed
        of_core, of_rest = np.flatnonzero(core), np.flatnonzero(~core)
        point, rep, apart = [of_core], [of_core[first]], [np.full(len(of_core), -1.0)]
        if len(of_core) and len(of_rest):
            far = 2 - 2 * (every[of_rest] @ v.T)
            nearest = far.argmin(axis=1)
            least = far[np.arange(len(far)), nearest]
            kept = least <= RADIUS**2
            point.append(of_rest[kept])
            rep.append(of_core[nearest[kept]])
            apart.append(np.maximum(least[kept], 0).astype(float))
        point, rep = pa.array(np.concatenate(point)), pa.array(np.concatenate(rep))
        return pa.table({"group": rows["group"].combine_chunks().take(point), "point": names.take(point), "rep": names.take(rep), "apart": np.concatenate(apart)})

    kind = points.schema["group"].dataType.simpleString()
    found = cut(spread(flagged).groupBy("group", "cell").applyInArrow(run, f"group {kind}, point string, rep string, apart double"))
    inner = found.filter("apart < 0 AND point <> rep").select("group", "point", "rep").distinct()
    outer = found.filter("apart >= 0").groupBy("group", "point").agg(F.min(F.struct("apart", "rep"))["rep"].alias("rep"))
    return inner.unionByName(outer)


def density_clusters(pairs: DataFrame, close: float = CLOSE) -> DataFrame:
    """``group, name, cluster``: records of the clusters of two or more; ``cluster`` is the smallest name.

    ``pairs`` as ``measured`` gives them. A record that, measured against its cluster, is far more often than close
    leaves it; records close to nobody do not come out.
    """
    pairs = cut(pairs)
    vectors = reduced_vectors(pairs, close)
    points = cut(micro_points(vectors))
    key = F.concat_ws("\u0001", F.col("group").cast("string"), "point")
    links = local_links(points).select(key.alias("a"), F.concat_ws("\u0001", F.col("group").cast("string"), "rep").alias("b"))
    joined = components(links)
    placed = vectors.withColumn("point", point_of())
    placed = placed.select("group", "name", key.alias("vertex")).join(joined, "vertex", "left").select("group", "name", F.coalesce("component", "vertex").alias("c"))
    placed = cut(placed)
    left = placed.select("group", F.col("name").alias("a"), F.col("c").alias("ca"))
    right = placed.select("group", F.col("name").alias("b"), F.col("c").alias("cb"))
    inside = pairs.join(left, ["group", "a"]).join(right, ["group", "b"]).filter("ca = cb")
    judged = inside.select("group", F.explode(F.array("a", "b")).alias("name"), F.when(F.col("distance") < close, 1).otherwise(-1).alias("vote"))
    kept = judged.groupBy("group", "name").agg(F.sum("vote").alias("votes")).filter("votes >= 0").select("group", "name")
    members = placed.join(kept, ["group", "name"])
    named = members.groupBy("group", "c").agg(F.min("name").alias("cluster"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return members.join(named.select("group", "c", "cluster"), ["group", "c"]).select("group", "name", "cluster")


def describe_clusters(members: DataFrame, pairs: DataFrame, top: int = 3) -> DataFrame:
    """``group, cluster, size, medoids``: the ``top`` members of the smallest mean measured distance to the others."""
    left = members.select("group", F.col("name").alias("a"), F.col("cluster").alias("ca"))
    right = members.select("group", F.col("name").alias("b"), F.col("cluster").alias("cb"))
    inside = pairs.join(left, ["group", "a"]).join(right, ["group", "b"]).filter("ca = cb")
    means = inside.select("group", F.col("ca").alias("cluster"), F.explode(F.array("a", "b")).alias("name"), "distance").groupBy("group", "cluster", "name").agg(F.avg("distance").alias("mean"))
    first = means.withColumn("r", F.row_number().over(W.partitionBy("group", "cluster").orderBy("mean", "name"))).filter(F.col("r") <= top)
    medoids = first.groupBy("group", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("medoids"))
    return members.groupBy("group", "cluster").agg(F.count(F.lit(1)).alias("size")).join(medoids, ["group", "cluster"])
