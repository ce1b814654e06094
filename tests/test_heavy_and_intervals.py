import random

from pyspark.sql import functions as F

from clademill.operators import heavy, intervals


def test_profile(spark):
    rows = [("a", v) for v in [1, 1, 2, 3, 100, None]] + [(None, 5)] * 3 + [("b", None)]
    df = spark.createDataFrame(rows, "k string, v int").withColumn("key", F.lit("clash")).withColumn("value", F.lit("clash"))
    w = heavy.weighted_values(df, F.col("k"), F.col("v"))
    got = {r.key: r for r in heavy.key_profile(w).collect()}
    assert (got["a"].n_rows, got["a"].n_distinct, got["a"].mode, got["a"].total) == (6, 4, 1, 107)
    assert (got[None].n_rows, got["b"].n_rows, got["b"].mode) == (3, 1, None)
    half = {r.key: r.percentile for r in heavy.key_percentile(w, 0.5).collect()}
    assert half == {"a": 2, None: 5}
    shares = heavy.keys_above_share(heavy.key_profile(w), 0.5).collect()
    assert [r.key for r in shares] == ["a"]
    assert heavy.key_profile(heavy.weighted_values(df.limit(0), F.col("k"), F.col("v"))).count() == 0


def test_percentile_against_sorting(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("xxxy"), rnd.randint(-300, 300)) for _ in range(2000)]
    w = heavy.weighted_values(spark.createDataFrame(rows, "k string, v int"), F.col("k"), F.col("v"))
    for p in (0.0, 0.1, 0.5, 1.0):
        got = {r.key: r.percentile for r in heavy.key_percentile(w, p).collect()}
        for k in "xy":
            values = sorted(v for x, v in rows if x == k)
            assert got[k] == values[max(0, -(-int(p * 1000) * len(values) // 1000) - 1)]


def brute(rows):
    covered = {}
    for k, a, b in rows:
        if None not in (k, a, b) and b > a:
            covered.setdefault(k, set()).update(range(a, b))
    gaps, periods = set(), set()
    for k, c in covered.items():
        starts = sorted(x for x in c if x - 1 not in c)
        ends = sorted(x + 1 for x in c if x + 1 not in c)
        periods |= {(k, a, b) for a, b in zip(starts, ends)}
        gaps |= {(k, b, a) for b, a in zip(ends, starts[1:])}
    return gaps, periods


def test_gaps_and_periods(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", "c", None]), a, rnd.choice([a + rnd.randint(-2, 30), None] if rnd.random() < 0.1 else [a + rnd.randint(-2, 30)])) for a in (rnd.randint(-50, 3000) for _ in range(300))]
    rows += rows[:50] + [("d", None, 3), ("e", 5, 5), ("f", 0, 10), ("f", 10, 20)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    gaps, periods = brute(rows)
    for block in (16, 4096):
        assert {tuple(r) for r in intervals.gaps(df, F.col("k"), F.col("a"), F.col("b"), block).collect()} == gaps
        assert {tuple(r)[:3] for r in intervals.merged_periods(df, F.col("k"), F.col("a"), F.col("b"), block).collect()} == periods
    assert intervals.gaps(df.limit(0), F.col("k"), F.col("a"), F.col("b")).count() == 0


def test_joins(spark):
    outer = spark.createDataFrame([("g", 1, 5, 100), ("g", 2, 90, 95), ("h", 3, 0, 9)], "k string, o int, lo int, hi int")
    inner = spark.createDataFrame([("g", 10, 20), ("g", 91, 95), ("g", 99, 101), ("h", 0, 9)], "k string, s int, e int")
    got = {(r.o, r.s) for r in intervals.containment_join(outer, inner, "k", "lo", "hi", "s", "e", 8).collect()}
    assert got == {(1, 10), (1, 91), (2, 91), (3, 0)}
    bag = spark.createDataFrame([("x", 1, 5, 10), ("x", 2, 6, 11), ("x", 3, 6, 11), ("x", 7, 20, 25)], "g string, owner int, lo int, hi int")
    assert {r.owner for r in intervals.overlap_semi(bag, "g", "owner", "lo", "hi", 4).collect()} == {1, 2, 3}
