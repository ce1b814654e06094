import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from clademill.llm import clusters, components, fusion, queries


def test_components_against_union_find(spark):
    rnd = random.Random(7)
    names = [f"n{i:03d}" for i in range(120)]
    pairs = [tuple(rnd.sample(names, 2)) for _ in range(90)] + [("n000", "n000"), (None, "n001"), ("n002", None), (None, None)]
    pairs += pairs[:20] + [(b, a) for a, b in pairs[:20]] + [("hub", n) for n in names[:30]]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {x: find(x) for x in root}
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("v", F.lit("clash"))
    got = {r.vertex: r.component for r in components.components(df).collect()}
    assert got == want


def test_long_chain_and_empty(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    chain = spark.createDataFrame(list(zip(order, order[1:])), "a int, b int")
    got = components.components(chain).collect()
    assert len(got) == 200 and {r.component for r in got} == {0}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0
    assert components.components(spark.createDataFrame([("x", "x")], "a string, b string")).count() == 0


def test_fusion_learns_who_is_right(spark):
    rnd = random.Random(9)
    rows = []
    for e in range(60):
        for s in ("good1", "good2", "bad1", "bad2", "bad3"):
            value = f"true{e}" if s.startswith("good") or rnd.random() < 0.2 else f"wrong{e}{s}" if rnd.random() < 0.5 else f"wrong{e}"
            rows.append((f"e{e}", s, value, 1))
    df = spark.createDataFrame(rows, "e string, s string, v string, entity int")
    claims = fusion.claims_of(df, F.col("e"), F.col("s"), {"v": fusion.Field(F.col("v"))})
    _, reliability, rounds = fusion.discover(claims, 0.001)
    assert 2 < rounds < 40
    w = {r.source: r.w for r in reliability.collect()}
    assert min(w["good1"], w["good2"]) > max(w["bad1"], w["bad2"], w["bad3"])
    fused = {r.entity: r.v for r in fusion.fuse(df, F.col("e"), F.col("s"), {"v": fusion.Field(F.col("v"))}, 0.001).collect()}
    assert sum(v == f"true{e[1:]}" for e, v in fused.items()) >= 57
    voted = {r.entity: r.v for r in fusion.fuse(df, F.col("e"), F.col("s"), {"v": fusion.Field(F.col("v"))}, float("inf")).collect()}
    assert voted != fused, "the rounds change what survives"


def test_rounds_decide_the_row_that_is_found(spark, tmp_path):
    """One row has the most letters, the latest load and the highest trust; copies of a lesser one outvote it until the rounds end."""
    when = lambda d: datetime.datetime(2024, 1, d)
    rows = [(i, "T x", "c1", "AC", 1, when(1)) for i in range(9)] + [(9, "t_x", "C1 more", "acgtN", 2, when(2)), (10, "t_x", "c1", "ACGT-", 2, when(2)), (11, "t y", "c", "A", None, None), (12, "t y", "c", "AC", 3, when(1)), (13, "t y", "c", "A", 3, when(4)), (14, None, "c", "A", 3, when(4)), (15, "t z", "c", None, None, None), (16, "t z", "c", None, None, None)]
    spark.createDataFrame(rows, "row_id long, taxon string, contig string, seq string, trust int, loaded_at timestamp").withColumn("description", F.lit(None).cast("string")).withColumn("n", F.lit("clash")).write.parquet(f"{tmp_path}/contigs.parquet")
    assert {r.row_id for r in queries.p2_found(spark, str(tmp_path)).collect()} == {9, 15}
    assert {r.row_id for r in queries.p2_found(spark, str(tmp_path), float("inf")).collect()} == {0, 13, 15}


def test_fusion_rules(spark):
    rows = [("a", "s", "AC", 1, "x"), ("a", "s", "ACG", None, "y"), ("a", None, None, 3, "x"), ("b", "s", None, None, None), (None, "s", "A", 1, "z")]
    df = spark.createDataFrame(rows * 2, "e string, s string, seq string, t int, d string")
    fields = {"seq": fusion.Field(F.col("seq"), F.length("seq"), strict=True), "t": fusion.Field(F.col("t"), F.col("t"), strict=True), "d": fusion.Field(F.col("d"))}
    got = {r.entity: (r.seq, r.t, r.d) for r in fusion.fuse(df, F.col("e"), F.col("s"), fields).collect()}
    assert got == {"a": ("ACG", "3", "x"), "b": (None, None, None)}
    assert fusion.fuse(df.limit(0), F.col("e"), F.col("s"), fields).count() == 0


def distances(rnd, groups):
    rows, truth = [], set()
    for g, sizes in groups.items():
        members = [(c, f"t|{g}_{c}_{i}") for c, n in enumerate(sizes) for i in range(n)]
        for i, (c, a) in enumerate(members):
            for d, b in members[i + 1 :]:
                if c == d:
                    truth.add(tuple(sorted((a, b))))
                rows.append([g, *rnd.sample((a, b), 2), rnd.uniform(1, 12) if c == d else rnd.uniform(25, 60)])
    return rows, truth


def test_clusters_with_wrong_and_missing_measurements(spark):
    rows, truth = distances(random.Random(2), {"g": [6, 5, 4, 1, 1], "h": [2, 3], "i": [1, 1]})
    by = {tuple(sorted(r[1:3])): r for r in rows}
    by["t|g_0_0", "t|g_0_1"][3] = 55.0
    by["t|g_0_2", "t|g_1_0"][3] = 3.0
    rows.remove(by["t|g_1_1", "t|g_1_2"])
    rows += [["g", "t|g_0_0", "t|g_0_0", 0.0], ["g", None, "x", 1.0], ["g", "t|g_3_0", "t|g_4_0", float("nan")], ["g", "t|g_3_0", "t|g_4_0", None], [None, "t|a", "t|b", 1.0]] + rows[:10]
    df = spark.createDataFrame(rows, "g string, a string, b string, d double").withColumn("name", F.lit("clash"))
    pairs = clusters.measured(df, F.col("g"), F.col("a"), F.col("b"), F.col("d"))
    members = clusters.cut(clusters.density_clusters(pairs))
    own = {}
    for r in members.collect():
        own.setdefault((r.group, r.cluster), []).append(r.name)
    got = {tuple(sorted((x, y))) for c in own.values() for x in c for y in c if x < y}
    assert got == truth
    described = {(r.group, r.cluster): r for r in clusters.describe_clusters(members, pairs).collect()}
    assert described["g", "t|g_0_0"].size == 6 and len(described["g", "t|g_0_0"].medoids) == 3
    assert "t|g_0_0" not in described["g", "t|g_0_0"].medoids
    assert clusters.density_clusters(pairs.limit(0)).count() == 0


def test_cells_change_nothing(spark, monkeypatch):
    rows, truth = distances(random.Random(4), {"g": [5] * 12})
    df = spark.createDataFrame(rows, "g string, a string, b string, d double")
    monkeypatch.setattr(clusters, "CELL_POINTS", 2)
    members = clusters.density_clusters(clusters.measured(df, F.col("g"), F.col("a"), F.col("b"), F.col("d"))).collect()
    got = {tuple(sorted((x.name, y.name))) for x in members for y in members if x.cluster == y.cluster and x.name < y.name}
    assert got == truth


def test_cells_are_bounded_and_hold_every_near_pair(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(300, 32))
    v = np.concatenate([rnd.normal(size=(900, 32)), centres / np.linalg.norm(centres, axis=1, keepdims=True), np.repeat(centres[:100], 6, axis=0) + rnd.normal(size=(600, 32)) * 0.08])
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    spot = v[0] + rnd.normal(size=(300, 32)) * 0.002
    v = np.concatenate([v, (spot / np.linalg.norm(spot, axis=1, keepdims=True)).astype(np.float32)])
    df = spark.createDataFrame([("g", f"p{i:04d}", x.tolist()) for i, x in enumerate(v)], "group string, point string, v array<float>").withColumn("weight", F.lit(1).cast("long"))
    monkeypatch.setattr(clusters, "CELL_POINTS", 150)
    held = {}
    for r in clusters.cells(df).collect():
        held.setdefault(r.cell, []).append(int(r.point[1:]))
    assert max(map(len, held.values())) <= 150
    close = 2 - 2 * (v.astype(float) @ v.T.astype(float)) < 0.2**2
    assert {int(r.point[1:]) for r in clusters.core_points(clusters.cells(df)).collect()} == set(np.flatnonzero(close.sum(axis=1) >= 2))
    near = {(i, j) for i, j in zip(*np.nonzero(2 - 2 * (v.astype(float) @ v.T.astype(float)) < 0.2**2 - 1e-5)) if i < j}
    shared = {(i, j) for members in held.values() for i in members for j in members if i < j}
    assert len(near) > 40_000 and near <= shared
    joined = {r.vertex: r.component for r in components.components(clusters.local_links(df).select(F.col("point").alias("a"), F.col("rep").alias("b"))).collect()}
    assert all(joined[f"p{i:04d}"] == joined[f"p{j:04d}"] for i, j in near)
    monkeypatch.setattr(clusters, "CELL_POINTS", 10_000)
    assert joined == {r.vertex: r.component for r in components.components(clusters.local_links(df).select(F.col("point").alias("a"), F.col("rep").alias("b"))).collect()}


def test_border_points_never_merge(spark, monkeypatch):
    """Two dense spots and a thin bridge of single points between them: one cluster without density, two with it."""
    turn = lambda a: [np.cos(a), np.sin(a)] + [0.0] * 30
    angles = [-0.05, -0.04, -0.03, -0.02, 0.0, 0.19, 0.36, 0.55, 0.57, 0.58, 0.59, 0.6]
    df = spark.createDataFrame([("g", f"p{i:02d}", [float(x) for x in turn(a)], 1) for i, a in enumerate(angles)], "group string, point string, v array<float>, weight long")
    for least, sizes in ((2, [12]), (5, [6, 6])):
        monkeypatch.setattr(clusters, "MIN_WEIGHT", least)
        joined = components.components(clusters.local_links(df).select(F.col("point").alias("a"), F.col("rep").alias("b"))).groupBy("component").count().collect()
        assert sorted(r["count"] for r in joined) == sizes
