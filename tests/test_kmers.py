import random
from collections import Counter, defaultdict

import numpy as np

from clademill.operators import kmers

SCHEMA = "group_id string, seq_name string, seq string"


def family(rnd, n, size, letters="ACGT"):
    """Records that share most of their letters, with gaps, unknowns and some shorter texts."""
    root = [rnd.choice(letters) for _ in range(size)]
    return ["".join(rnd.choice(letters) if rnd.random() < 0.05 else rnd.choice("N-n") if rnd.random() < 0.02 else c for c in root)[: size - rnd.choice((0, 0, 0, 25))] for _ in range(n)]


def tables(spark):
    rnd = random.Random(5)
    rows = [(g, f"t{i}|c", s) for g, n, size, letters in (("g", 9, 90, "ACGT"), ("h", 5, 70, "ACGTRYSWKMBDHVU"), ("i", 4, 60, "ACé\U0001f600"), ("j", 3, 8, "ACGT")) for i, s in enumerate(family(rnd, n, size, letters))]
    return rows, spark.createDataFrame(rows, SCHEMA)


def grouped(rows, k):
    every = [(g, p, s[p : p + k], n) for g, n, s in rows for p in range(len(s) - k) if not set(s[p : p + k]) & set("Nn-")]
    seen = Counter(x[:3] for x in every)
    return sorted(x for x in every if seen[x[:3]] > 1)


def scored(rows, k, least, pairs):
    places = defaultdict(dict)
    for g, p, word, n in grouped(rows, k):
        places[g, n][p] = word
    found = []
    for g, a, b in pairs:
        x, y = places[g, a], places[g, b]
        together, compared = sum(y.get(p) == word for p, word in x.items()), len(x.keys() & y.keys())
        if together and min(len(x), len(y)) > least:
            found.append((g, a, b, together, compared, round(together / compared, 6) if compared > least else 0.0))
    return sorted(found)


def travels(df):
    """Lines of the plan that move or join k-mers as rows."""
    plan = df._jdf.queryExecution().toString()
    return [x for x in plan.splitlines() if ("Exchange" in x or "Join" in x) and "kmer" in x]


def narrow(monkeypatch):
    monkeypatch.setattr(kmers, "NARROW", 16)
    monkeypatch.setattr(kmers, "WIDE", 16)


def test_pair_scores_do_not_move_kmers(spark, monkeypatch):
    rows, df = tables(spark)
    names = sorted({(g, n) for g, n, _ in rows})
    pairs = [(g, a, b) for g, a in names for h, b in names if g == h and a < b] + [("g", "t0|c", "zz"), ("zz", "a", "b")]
    listed = spark.createDataFrame(pairs, "group_id string, a string, b string")
    assert not travels(kmers.pair_scores(df, 9, 8, listed))
    for k in (4, 9, 15):
        want = scored(rows, k, 8, pairs)
        assert want and sorted(map(tuple, kmers.pair_scores(df, k, 8, listed).collect())) == want
    narrow(monkeypatch)
    got = defaultdict(list)
    for r in kmers.pair_scores_by_length(df, (15, 4), 8, listed.unionByName(listed)).collect():
        got[r.k].append((r.group_id, r.a, r.b, r.together, r.compared, r.score))
    assert {k: sorted(x) for k, x in got.items()} == {k: scored(rows, k, 8, pairs) for k in (4, 15)}
    assert sorted(map(tuple, kmers.pair_scores(df, 9, 8).collect())) == scored(rows, 9, 8, pairs)


def test_kmer_groups_do_not_move_kmers(spark, monkeypatch):
    rows, df = tables(spark)
    assert not travels(kmers.kmer_groups(df, 9))
    assert sorted(map(tuple, kmers.kmer_groups(df, 9).collect())) == grouped(rows, 9)
    narrow(monkeypatch)
    assert sorted(map(tuple, kmers.kmer_groups(df, 5).collect())) == grouped(rows, 5)
    assert kmers.kmer_groups(spark.createDataFrame([], SCHEMA), 5).count() == 0


def test_kinds_are_exact_when_codes_outgrow_a_long():
    rnd = random.Random(1)
    letters = [chr(0x100 + i) for i in range(3000)]
    words = ["".join(rnd.choice(letters) for _ in range(15)) for _ in range(40)]
    texts = [rnd.choice(words) + "A" for _ in range(200)]
    key = np.arange(200) % 3
    (found,) = kmers.kinds(texts, key, np.full(200, 1), [15], shared=False)
    place = defaultdict(set)
    for i, x in enumerate(texts):
        place[key[i], x].add(int(found[i, 0]))
    assert all(len(x) == 1 for x in place.values()) and len(set.union(*place.values())) == len(place)


def test_component_agreement_against_brute_force(spark, monkeypatch):
    rows, _ = tables(spark)
    rnd = random.Random(4)
    given = [(*x, f"c{rnd.randrange(3)}", {"g": 4, "h": 9}.get(x[0], 4)) for x in rows]
    df = spark.createDataFrame(given, SCHEMA + ", component string, k int")
    words = defaultdict(set)
    for g, _, s, c, k in given:
        for p in range(len(s) - k):
            if not set(s[p : p + k]) & set("Nn-"):
                words[g, c, p].add(s[p : p + k])
    want = {}
    for g, x, y in {(g, x, y) for g, x, _ in words for h, y, _ in words if g == h and x < y}:
        met = [p for h, c, p in words if (h, c) == (g, x) and (g, y, p) in words]
        if met:
            want[g, x, y] = sum(len(words[g, x, p] | words[g, y, p]) == 1 for p in met) / len(met)
    assert want
    for _ in range(2):
        assert not travels(kmers.component_agreement(df, (4, 9)))
        assert {(r.group_id, r.c1, r.c2): r.ratio for r in kmers.component_agreement(df, (4, 9)).collect()} == want
        narrow(monkeypatch)


def test_sweep_and_similarity_do_not_move_kmers(spark):
    from clademill import config
    from clademill.plans import tools

    rows, df = tables(spark)
    counts = spark.createDataFrame([("g", "t0|c", f"t{i}|c", 80) for i in range(1, 9)], "group_id string, a string, b string, overlap int")
    out = spark.createDataFrame([("t8",)], "taxon string")
    members = tools.sweep(df, counts, out, config.Outparalogs(kmers=(4, 9), min_overlap=20), 8)
    assert not travels(members) and {r.group_id for r in members.collect()} == {"g"}
    assert not travels(tools.association_support(df, members, (4, 9)))
