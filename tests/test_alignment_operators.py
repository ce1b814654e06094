import random

from pyspark.sql import functions as F

from clademill import config
from clademill.functions import arrays, dna
from clademill.operators import columns, kmers, pairs, reads
from clademill.plans import alignments

SCHEMA = "group_id string, seq_name string, seq string"


def test_small_fragments(spark):
    rows = [("g", "a", "A" * 20 + "-" * 20 + "ACG" + "-" * 20 + "ACGTA" + "-" * 20 + "A" * 20), ("g", "b", "------"), ("g", "c", "A" + "-" * 15 + "n" + "A" * 60)]
    got = {r.seq_name: r.seq for r in columns.clean_small_fragments(spark.createDataFrame(rows, SCHEMA), 10, 15, 3).collect()}
    assert got["a"] == "A" * 20 + "-" * 68 + "A" * 20
    assert got["b"] == "------" and got["c"] == "-" * 17 + "A" * 60


def test_drop_and_slice(spark):
    df = spark.createDataFrame([("g", "a", "A-GN"), ("g", "b", "A-G-"), ("h", "c", "----")], SCHEMA)
    assert {r.seq_name: r.seq for r in columns.drop_gapped_columns(df, 0.5).collect()} == {"a": "AG", "b": "AG", "c": ""}
    bounds = spark.createDataFrame([("g", 1, 3)], "group_id string, start int, stop int")
    assert {r.seq_name: r.seq for r in columns.slice_columns(df, bounds).collect()} == {"a": "-G", "b": "-G", "c": "----"}


def test_distances_against_brute_force(spark):
    rnd = random.Random(2)
    seqs = {n: "".join(rnd.choice("ACGTACGTACGTN-") for _ in range(130)) for n in "abcd"}
    rows = spark.createDataFrame([("g", n, s) for n, s in seqs.items()], SCHEMA)
    listed = spark.createDataFrame([("g", "a", "b"), ("g", "a", "c"), ("g", "c", "d"), ("g", "a", "zz")], "group_id string, a string, b string")
    got = {(r.a, r.b): r for r in pairs.pair_counts(listed, rows).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("c", "d")}
    for (x, y), r in got.items():
        both = [(p, q) for p, q in zip(seqs[x], seqs[y])]
        ok = [(p, q) for p, q in both if p in "ACGT" and q in "ACGT"]
        assert r.overlap == sum(p != "-" and q != "-" for p, q in both)
        assert (r.compared, r.match) == (len(ok), sum(p == q for p, q in ok))
        assert r.ts == sum({p, q} in ({"A", "G"}, {"C", "T"}) for p, q in ok)
    same = pairs.pair_counts(spark.createDataFrame([("g", "a", "a")], "group_id string, a string, b string"), rows)
    d = pairs.distances(same).first()
    assert (d.uncorrected, d.jukes_cantor, d.kimura, d.tajima_nei) == (0.0, 0.0, 0.0, 0.0)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ATGNNA-CG", "AT")], "s string, t string")
    s = F.col("s")
    row = df.select(dna.translate_codons(s), dna.ungapped_runs(s), dna.kmers(s, 7), dna.similarity(s, F.lit("ATCNNA-CC")), dna.iupac(F.array(F.lit("G"), F.lit("A"), F.lit("A"))), dna.kmers(F.col("t"), 3)).first()
    assert row[0] == "MXX" and [tuple(r) for r in row[1]] == [(0, 3), (5, 6), (7, 9)] and [tuple(r) for r in row[2]] == [(0, "ATGNNA-"), (1, "TGNNA-C")]
    assert (row[3], row[4], row[5]) == (6, "R", [])


def test_singletons_have_no_near_partner(spark):
    rnd = random.Random(4)
    base = "".join(rnd.choice("ACGT") for _ in range(40))
    rows = [("g", f"r{i}", "".join(c if rnd.random() < 0.8 else rnd.choice("ACGT-") for c in base)) for i in range(6)]
    got = {(r.seq_name, r.pos) for r in kmers.singletons(spark.createDataFrame(rows, SCHEMA), 8, 4).collect()}
    want = set()
    for _, n, s in rows:
        for p in range(32):
            own = s[p : p + 8]
            others = [t[p : p + 8] for _, m, t in rows if m != n]
            if own.strip("-") and own not in others and not any(sum(x == y != "-" for x, y in zip(own, o)) > 4 for o in others):
                want.add((n, p))
    assert got == want


def test_mates_and_spans(spark):
    rows = [("s", "r1", 0, "ACGT"), ("s", "r1", 6, "GG"), ("s", "r2", 2, "GTAA"), ("s", "r2", 4, "AACC")]
    df = spark.createDataFrame(rows, "seq_name string, read_name string, lo int, seq string").withColumn("hi", F.col("lo") + F.length("seq"))
    got = {r.read_name: (r.lo, r.hi, r.seq) for r in reads.mate_pairs(df).collect()}
    assert got == {"r1": (0, 8, "ACGT--GG"), "r2": (2, 8, "GTAACC")}
    near = spark.createDataFrame([("s", 2, 4), ("s", 0, 7)], "seq_name string, pos int, next_pos int")
    assert {(r.pos, r.n_reads) for r in reads.spanning(reads.mate_pairs(df), near, 3).collect()} == {(2, 1), (0, 1)}


def test_config(tmp_path):
    path = tmp_path / "x.ini"
    path.write_text("[GLOBAL]\nroot=/data\n[S4]\nkmers=[6, 9]\nmax_jaccard=3/4\nmax_alleles=4\n")
    p = config.load(config.Outparalogs, str(path), "S4")
    assert p.kmers == (6, 9) and p.max_jaccard == 0.75 and p.max_alleles == 4
    try:
        config.Clean(k=5, min_similarity=6)
    except ValueError:
        return
    raise AssertionError


def test_packed_similarity(spark):
    rnd = random.Random(1)
    rows = [tuple("".join(rnd.choice("ACGTNRV-") for _ in range(12)) for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    quick = dna.packed_similarity(dna.packed(F.col("a"), "u"), dna.packed(F.col("b"), "v"), 12)
    assert df.filter(quick != dna.similarity(F.col("a"), F.col("b"))).count() == 0


def test_nearest_and_shared(spark):
    listed = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "a", "c", 2.0), ("g", "b", "c", 1.0), ("g", "c", "d", 9.0)], "group_id string, a string, b string, distance double")
    near = pairs.nearest(listed, 1)
    assert {(r.seq_name, r.other) for r in near.collect()} == {("a", "b"), ("b", "a"), ("c", "b"), ("d", "c")}
    assert {(r.a, r.b, r.n_shared) for r in pairs.shared_neighbours(listed, near).collect()} == {("a", "c", 1)}


def test_haplotypes(spark):
    records = spark.createDataFrame([("s", "ACGTn-A"), ("t", "AC")], "seq_name string, seq string")
    phased = spark.createDataFrame([("s", 0, 0, "T"), ("s", 0, 1, "G"), ("s", 3, 0, "A"), ("s", 3, 1, "C"), ("s", 99, 0, "A")], "seq_name string, pos int, allele int, base string")
    got = {r.seq_name: r.seq for r in reads.haplotypes(records, phased).collect()}
    assert got == {"s_allele_0": "TCGAA", "s_allele_1": "GCGCA", "t": "AC"}


def test_phase_follows_reads(spark):
    rows = [("s", f"r{i}", 0, "AAAAA" if i % 2 else "TAAAC") for i in range(6)] + [("s", f"q{i}", 4, "AGG" if i % 2 else "CGT") for i in range(6)]
    df = spark.createDataFrame(rows, "seq_name string, read_name string, lo int, seq string").withColumn("hi", F.col("lo") + F.length("seq"))
    snps = reads.variable_positions(reads.pileup(df), 4, 0.33)
    got = {}
    for r in reads.phase(df, snps).collect():
        got.setdefault(r.allele, {})[r.pos] = r.base
    assert sorted("".join(v[p] for p in sorted(v)) for v in got.values()) == ["AAG", "TCT"]


def test_phased_sequences_of_contigs_and_loci(spark, tmp_path):
    spark.createDataFrame([("gen_sp|l1", "ACGT")], "seq_name string, seq string").write.parquet(f"{tmp_path}/target_loci.parquet")
    contigs = [("gen_sp", "l1", "TTTT"), ("gen_sp", "c1", "acgta"), ("gen_sp", "c2", "CCCC"), ("gen_sp", "c3", None)]
    spark.createDataFrame(contigs, "taxon string, contig string, seq string").write.parquet(f"{tmp_path}/contigs.parquet")
    reads_of = [("gen_sp|c1", f"r{i}", 1, "CGT" if i % 2 else "GGA") for i in range(6)]
    spark.createDataFrame(reads_of, "seq_name string, read_name string, read_start int, seq string").write.parquet(f"{tmp_path}/reads.parquet")
    got = {r.seq_name: r.seq for r in alignments.QUERIES["phased_sequences"](spark, str(tmp_path)).collect()}
    assert got.keys() == {"gen_sp|l1", "gen_sp|c1_allele_0", "gen_sp|c1_allele_1", "gen_sp|c2"}
    assert got["gen_sp|l1"] == "ACGT" and {got["gen_sp|c1_allele_0"], got["gen_sp|c1_allele_1"]} == {"ACGTA", "AGGAA"}


def test_mates_are_the_first_two_reads(spark):
    rows = [("m", "x", 4, 6, "GG"), ("m", "x", 0, 2, "AC"), ("m", "x", 7, 9, "TT"), ("m", "y", 1, 2, "A"), ("o", "x", 0, 3, "AAA"), ("o", "x", 1, 3, "CC")]
    got = {(r.read_name, r.seq_name): (r.lo, r.hi, r.seq) for r in reads.mate_pairs(spark.createDataFrame(rows, "read_name string, seq_name string, lo int, hi int, seq string")).collect()}
    assert got == {("m", "x"): (0, 6, "AC--GG"), ("m", "y"): (1, 2, "A"), ("o", "x"): (0, 3, "AAA")}


def test_running_totals(spark):
    df = spark.createDataFrame([([1] * 2000,), ([3, 4],), ([],), (None,)], "n array<int>")
    got = [r[0] for r in df.select(arrays.running_totals(F.col("n"))).collect()]
    assert got == [list(range(1, 2001)), [3, 7], [], None]


def test_many_runs_of_one_text(spark):
    df = spark.createDataFrame([("AC-" * 1500 + "A",)], "s string")
    got = [tuple(r) for r in df.select(dna.ungapped_runs(F.col("s"))).first()[0]]
    assert got == [(3 * i, 3 * i + 2) for i in range(1500)] + [(4500, 4501)]
