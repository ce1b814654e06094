from pyspark.sql import functions as F

from clademill.functions import names

CASES = [
    ("velo_arctea|c1_g2", "velo_arctea|c1_g2"),
    (" Velo  arctea | C1_G2 len=5 cov=2", "velo_arctea|c1_g2"),
    ("_R_velo_arctea|c1", "velo_arctea|c1"),
    ("velo_arctea|_R_c1 path=[1:2]", "velo_arctea|c1"),
    ("VELO_ARCTEA |\tc1_allele_0\t", "velo_arctea|c1_allele_0"),
    ("_r_velo arctea|c1", "velo_arctea|c1"),
    ("no bar", None), ("|x", None), ("x|", None), ("", None), (None, None),
]


def test_canonical_name(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, n string")
    got = [r[0] for r in df.orderBy("i").select(names.canonical_name(F.col("n"))).collect()]
    assert got == [b for _, b in CASES]


def test_parts(spark):
    df = spark.createDataFrame([("t_a|contig_9_allele_1",)], "n string")
    n = F.col("n")
    row = df.select(names.taxon_of(n), names.contig_of(n), names.allele_of(n), names.without_allele(n), names.short_label(n)).first()
    assert tuple(row) == ("t_a", "contig_9_allele_1", 1, "t_a|contig_9", "t_a|9_a_1")
