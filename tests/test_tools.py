import random

import pytest
from pyspark.sql import functions as F

from clademill import config, session
from clademill.plans import alignments, tools

ROWS = "group_id string, seq_name string, taxon string, seq string, is_outgroup boolean"
PAIRS = "group_id string, a string, b string, distance double"


def family(rnd):
    """Two copies of three taxa, each copy its own lineage, and an outgroup."""
    word = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    change = lambda s, p: "".join(rnd.choice("ACGT") if rnd.random() < p else c for c in s)
    root = word(300)
    one, two = change(root, 0.35), change(root, 0.35)
    rows = [("g", f"t{t}|c{k}", f"t{t}", change(s, 0.03), False) for t in range(3) for k, s in ((1, one), (2, two))]
    rows.append(("g", "o|x", "o", change(root, 0.2), True))
    return rows


def differ(rows):
    out = []
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            a, b = sorted((x[1], y[1]))
            out.append(("g", a, b, 100 * sum(p != q for p, q in zip(x[3], y[3])) / 300))
    return out


def test_every_record_gets_an_outcome(spark):
    rows = family(random.Random(3))
    df, listed = spark.createDataFrame(rows, ROWS), spark.createDataFrame(differ(rows), PAIRS)
    got = tools.outparalogs(df, listed, config.Outparalogs(kmers=(6, 9), min_overlap=100), 20).collect()
    assert len(got) == len(rows)
    copies = {r.seq_name: r.component for r in got if r.outcome == "component"}
    assert len({copies[f"t{t}|c1"] for t in range(3)}) == 1 and copies["t0|c1"] != copies["t0|c2"]
    got = tools.inparalogs(df, listed, config.Inparalogs(overlap_splitting=80, overlap_merging=100, max_allele_distance=8.0)).collect()
    assert len(got) == len(rows) and {r.seq_name for r in got} == {r[1] for r in rows}
    kept = {r.seq_name: r.component for r in got if r.outcome == "component"}
    assert all(kept.get(f"t{t}|c1") != kept.get(f"t{t}|c2") or kept.get(f"t{t}|c1") is None for t in range(3))


def test_primary_and_secondary(spark):
    hits = [("a|1", "b|1", 500, 1e-200), ("b|1", "a|1", 500, 1e-200), ("b|1", "c|1", 500, 1e-120), ("c|1", "b|1", 400, 1e-120), ("c|1", "d|1", 900, 1e-10), ("d|1", "c|1", 900, 1e-10)]
    h = spark.createDataFrame(hits, "a string, b string, align_len int, evalue double")
    c = spark.createDataFrame([(f"{x}|1", "ACnG") for x in "abc"], "seq_name string, seq string")
    got = tools.primary(h, c, config.Primary(min_taxa=1)).collect()
    assert {(r.group_id, r.seq_name, r.seq, r.kept) for r in got} == {("a|1", f"{x}|1", "ACG", True) for x in "abc"}
    rows = spark.createDataFrame([("g", f"{x}|1", "A-C") for x in "abc"] + [("h", "z|1", "A")], "group_id string, seq_name string, seq string")
    parts = tools.secondary(rows, h, config.Secondary(max_size=2, max_evalue=1e-150, min_align_len=300)).collect()
    assert {(r.group_id, r.subgroup, r.seq_name) for r in parts} == {("g", "a|1", "a|1"), ("g", "a|1", "b|1"), ("g", "c|1", "c|1"), ("h", "h", "z|1")}


def test_outparalog_query_sweeps_every_length(monkeypatch):
    seen = []
    monkeypatch.setattr(alignments, "outgroup_rows", lambda spark, folder: None)
    monkeypatch.setattr(alignments.src, "pair_distances", lambda spark, folder: None)
    monkeypatch.setattr(tools, "outparalogs", lambda rows, distances, p, min_positions: seen.append(p))
    alignments.QUERIES["outparalog_components"](None, "")
    assert [p.kmers for p in seen] == [(6, 9, 12, 15)]


def test_checkpoint_folder_has_to_be_shared():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_written_measures_bytes_and_counts(spark, monkeypatch):
    df = spark.createDataFrame([("a" * 100, [1, 2]), (None, None)], "s string, n array<int>")
    table, found = session.written(df, full=F.count_if(F.col("s").isNotNull()))
    assert found["full"] == 1 and found["bytes"] > 100 and table.count() == 2
    assert session.written(df.limit(0), n=F.count(F.lit(1)))[1] == {"bytes": 0, "n": 0}
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1)
    big = session.cut(df.select("s"))
    assert "strategy=merge" in df.join(big, "s")._jdf.queryExecution().optimizedPlan().toString()


def test_a_component_with_too_many_doubled_taxa_is_not_valid(spark):
    members = spark.createDataFrame([("g", f"t{t}|{c}", comp) for t in range(2) for c, comp in (("x", "c1"), ("y", "c1"), ("z", "c2"))], "group_id string, seq_name string, component string")
    counts = spark.createDataFrame([("g", "t0|x", "t0|y", 150), ("g", "t1|x", "t1|y", 150), ("g", "t0|x", "t0|z", 150), ("g", "t0|x", "t1|x", 150)], "group_id string, a string, b string, overlap int")
    valid = lambda overlap, most: {(r.component, r.valid) for r in tools.valid_components(members, counts, ["group_id"], overlap, most).collect()}
    assert valid(100, 2) == {("c1", False), ("c2", True)}
    assert valid(100, 3) == valid(200, 1) == {("c1", True), ("c2", True)}


def test_pairs_of_alleles_are_no_component(spark):
    rows = [("g", "t|a_allele_0", "p"), ("g", "t|a_allele_1", "p"), ("g", "t|b_allele_0", "q"), ("g", "u|b_allele_1", "q"), ("g", "t|c_allele_0", "r"), ("g", "t|c_allele_1", "r"), ("g", "u|d", "r")]
    kept = tools.without_allele_pairs(spark.createDataFrame(rows, "group_id string, seq_name string, component string")).collect()
    assert {r.component for r in kept} == {"q", "r"}


def test_components_with_least_paralogy_are_joined(spark):
    names = {"c1": ["t0|a", "t1|a"], "c2": ["t2|b", "t3|b"], "c3": ["t4|c", "t5|c", "t0|c"]}
    members = spark.createDataFrame([(g, n, c) for g in "gh" for c, own in names.items() for n in own], "group_id string, seq_name string, component string")
    pairs = [("t0|a", "t2|b"), ("t1|a", "t4|c"), ("t3|b", "t5|c")]
    listed = spark.createDataFrame([(g, a, b, 9.0) for g in "gh" for a, b in pairs], PAIRS)
    cannot = spark.createDataFrame([("g", "t0|a", "t0|c")], "group_id string, a string, b string")
    got = {}
    for r in tools.joined_components(members, listed, cannot, config.Inparalogs(min_taxa_share=0.3, max_jaccard=0.5)).collect():
        got.setdefault((r.group_id, r.component), set()).add(r.seq_name)
    assert set(map(frozenset, (v for (g, _), v in got.items() if g == "g"))) == {frozenset(names["c1"] + names["c2"]), frozenset(names["c3"])}
    assert {len(v) for (g, _), v in got.items() if g == "h"} == {2, 3}, "without paralogs all would be one, so the limit is the largest score and nothing is joined"
    apart = tools.joined_components(members, listed, cannot, config.Inparalogs(min_taxa_share=0.0)).groupBy("group_id", "component").count().count()
    assert apart == 6


def test_inparalog_outcomes(spark):
    rows = family(random.Random(3))
    df, listed = spark.createDataFrame(rows, ROWS), spark.createDataFrame(differ(rows), PAIRS)
    said = lambda of=df, **k: {r.outcome for r in tools.inparalogs(of, listed, config.Inparalogs(overlap_splitting=80, overlap_merging=100, **k)).collect()}
    assert said(df.filter("seq_name NOT LIKE '%c2'"), max_allele_distance=8.0) == {"no_threshold"}
    assert said(max_allele_distance=8.0, min_taxa_share=1.1) == {"no_overlap"}
    assert "component" in said(max_allele_distance=8.0, min_taxa_share=0.9)
    assert said(max_allele_distance=8.0, large_ratio=1.0) <= {"no_separation", "component", "assigned", "unassigned"}


def test_phasing_passes_excluded_taxa(spark):
    rows = [("t|x", f"r{i}", 0, "ACGTACGT") for i in range(4)] + [("t|x", f"s{i}", 0, "ACTTACCT") for i in range(4)] + [("u|y", f"q{i}", 0, "AACC") for i in range(4)] + [("u|y", f"p{i}", 0, "ATCC") for i in range(4)]
    found = spark.createDataFrame(rows, "seq_name string, read_name string, lo int, seq string").withColumn("hi", F.col("lo") + F.length("seq"))
    records = spark.createDataFrame([("t|x", "ACGTACGT"), ("u|y", "AACC"), ("v|z", "A-n")], "seq_name string, seq string")
    got = {r.seq_name: r.seq for r in tools.phasing(found, records, config.Phasing(excluded_taxa=("u",))).collect()}
    assert got.pop("u|y") == "AACC" and got.pop("v|z") == "A"
    assert set(got) == {"t|x_allele_0", "t|x_allele_1"} and set(got.values()) == {"ACGTACGT", "ACTTACCT"}
