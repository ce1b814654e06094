import time
import random

from clademill.operators import graph, groups, linkage


def roots(edges):
    """The smallest member of the set of each end of an edge, by union and find."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        up[high] = low
    return {x: find(x) for x in list(up)}


def test_components_of_random_edges(spark):
    rnd = random.Random(12)
    edges = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(60)] + [(200, x) for x in range(0, 30, 7)]
    edges = [(a, b) for a, b in edges if a != b]
    rows = edges + edges[:9] + [(b, a) for a, b in edges[:5]] + [(None, 1), (3, 3), (500, 500)]
    got = {r.vertex: r.component for r in graph.connected_components(spark.createDataFrame(rows, "a int, b int")).collect()}
    assert got == roots(edges)
    assert graph.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_long_chain_in_two_groups(spark):
    chain = list(range(40))
    random.Random(1).shuffle(chain)
    edges = [(g, a, b) for g in "xy" for a, b in zip(chain, chain[1:])]
    got = graph.connected_components(spark.createDataFrame(edges, "g string, a int, b int"), "a", "b", "g").collect()
    assert len(got) == 80 and {r.component for r in got} == {0}


def test_reciprocal(spark):
    hits = [("a", "b", 400), ("b", "a", 301), ("a", "c", 400), ("c", "a", 300), ("a", "b", 500), ("d", "e", None), ("e", "d", 900)]
    assert [tuple(r) for r in graph.reciprocal(spark.createDataFrame(hits, "a string, b string, align_len int"), 300).collect()] == [("a", "b")]


def test_constrained_linkage(spark):
    edges = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "b", "c", 2.0), ("g", "c", "d", 3.0), ("h", "x", "y", 1.0)], "group_id string, a string, b string, distance double")
    cannot = spark.createDataFrame([("g", "a", "c")], "group_id string, a string, b string")
    got = {(r.group_id, r.seq_name): r.cluster for r in linkage.constrained_linkage(edges, cannot).collect()}
    assert got == {("g", "a"): "a", ("g", "b"): "a", ("g", "c"): "c", ("g", "d"): "c", ("h", "x"): "x", ("h", "y"): "x"}


def test_fragment_paths(spark):
    rows = [("g", "t", "t|a", "ACGT------"), ("g", "t", "t|b", "----ACG---"), ("g", "t", "t|c", "-------TTT"), ("g", "t", "t|d", "TTTT------"), ("g", "u", "u|z", "----------")]
    got = linkage.fragment_paths(spark.createDataFrame(rows, "group_id string, taxon string, seq_name string, seq string"), 0).collect()
    assert {(r.path, r.seq) for r in got} == {("t|a|b|c", "ACGTACGTTT"), ("t|d", "TTTT------")}


def test_routes(spark):
    rows = [("g", "t", f"t|{i}", "AC") for i in range(5)] + [("h", "u", "u|1", "--")]
    df = spark.createDataFrame(rows, "group_id string, taxon string, seq_name string, seq string")
    assert {tuple(r) for r in groups.route(df, 4, 5).collect()} == {("g", "failed"), ("h", "passed")}
    assert {tuple(r) for r in groups.route(df, 4, 6).collect()} == {("g", "passed"), ("h", "passed")}
    assert {r.group_id: r.n_taxa for r in groups.group_sizes(df).collect()} == {"g": 1, "h": 0}
    assert {tuple(r) for r in groups.outcome(df, 2, 1, 1).collect()} == {("g", "complete"), ("h", "too_small")}


def test_linkage_in_rounds_is_the_same(spark, monkeypatch):
    rnd = random.Random(21)
    names = [f"n{i:02d}" for i in range(24)]
    pairs = list({tuple(sorted(rnd.sample(names, 2))) for _ in range(90)})
    edges = spark.createDataFrame([("g", a, b, float(rnd.randrange(12))) for a, b in pairs[:60]], "group_id string, a string, b string, distance double")
    cannot = spark.createDataFrame([("g", a, b) for a, b in pairs[60:]], "group_id string, a string, b string")
    want = {(r.component, r.cluster, r.seq_name) for r in linkage.constrained_linkage(edges, cannot).collect()}
    monkeypatch.setattr(linkage, "LOCAL_EDGES", 3)
    assert {(r.component, r.cluster, r.seq_name) for r in linkage.constrained_linkage(edges, cannot).collect()} == want


def chained(rows, max_overlap):
    """Chains of the records of one taxon, all found anew after each."""
    left, out = {}, []
    for name, seq in rows:
        where = [i for i, c in enumerate(seq) if c not in "-N"]
        if where:
            left[name] = (where[0], where[-1] + 1, seq, set(where))
    while left:
        names, best = sorted(left, key=lambda n: (left[n][0], left[n][1], n)), {}
        for n in names:
            best[n] = (float(len(left[n][3])), (n,))
            for m in names[: names.index(n)]:
                common = left[n][3] & left[m][3]
                if left[m][0] < left[n][0] and len(common) <= max_overlap:
                    score = best[m][0] + len(left[n][3]) - 2 * len(common) - 20 * sum(left[n][2][i] != left[m][2][i] for i in common)
                    if score > best[n][0]:
                        best[n] = (score, (*best[m][1], n))
        score, path = max(best.values(), key=lambda v: (v[0], [-ord(c) for c in v[1][0]]))
        text = list(left[path[0]][2].replace("N", "-"))
        for n in path[1:]:
            for i in left[n][3]:
                text[i] = left[n][2][i] if text[i] == "-" else text[i]
        out.append(("|".join(["t", *(n.split("|", 1)[-1] for n in path)]), score, "".join(text)))
        for n in path:
            del left[n]
    return sorted(out)


def test_fragment_paths_of_many_records(spark):
    rnd = random.Random(3)
    root = "".join(rnd.choice("ACGT") for _ in range(120))

    def record():
        lo, hi = sorted(rnd.sample(range(121), 2))
        return "-" * lo + "".join(rnd.choice("ACGTRN-") if rnd.random() < 0.05 else c for c in root[lo:hi]) + "-" * (120 - hi)

    rows = [(f"t|r{i}", record()) for i in range(150)]
    schema = "group_id string, taxon string, seq_name string, seq string"
    got = linkage.fragment_paths(spark.createDataFrame([("g", "t", *r) for r in rows], schema), 10).collect()
    assert sorted((r.path, r.score, r.seq) for r in got) == chained(rows, 10)
    uneven = [("g", "t", "t|a", "AC"), ("g", "t", "t|b", "--GT--"), ("g", "t", "t|c", "---")]
    assert [(r.path, r.seq) for r in linkage.fragment_paths(spark.createDataFrame(uneven, schema), 10).collect()] == [("t|a|b", "ACGT")]
    many = [("g", "t", f"t|r{i}", record()) for i in range(1500)]
    began = time.time()
    found = linkage.fragment_paths(spark.createDataFrame(many, schema), 10).collect()
    assert time.time() - began < 60 and sum(r.path.count("|") for r in found) == sum(bool(set(r[3]) - set("-N")) for r in many)
