from pyspark.sql import functions as F

from clademill.sources import fasta, hits, manifest, sam
from clademill.streaming import arrivals


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "in.fasta").write_text(">t|a first one\r\nACGT\r\nAC\r\n>t|b\nGG\n")
    (tmp_path / "bad.fasta").write_text(">x\n>y\nAC\n")
    got = [tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "in.fasta")).select("name", "description", "seq").orderBy("name").collect()]
    assert got == [("t|a", "first one", "ACGTAC"), ("t|b", "", "GG")]
    bad = fasta.invalid_fasta(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in bad] == [("bad.fasta", "record without sequence")]
    rows = spark.createDataFrame([("g", n, s) for n, _, s in got], "group_id string, seq_name string, seq string")
    fasta.write_fasta(rows, str(tmp_path / "out"), "group_id")
    back = fasta.read_fasta(spark, str(tmp_path / "out" / "group_id=g")).select("name", "seq")
    assert {tuple(r) for r in back.collect()} == {("t|a", "ACGTAC"), ("t|b", "GG")}


def test_fastq(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\n@@\n")
    assert {tuple(r)[1:] for r in fasta.read_fastq(spark, str(tmp_path / "x.fq")).collect()} == {("r1", "ACGT", "IIII"), ("r2", "GG", "@@")}


def test_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@SQ\tSN:c1\tLN:99\nr1\t3\tc1\t5\t60\t2S3M1D2M1I\t=\t1\t9\tACGTACGT\tIIIIIIII\nr2\t0\tc1\t1\t60\t*\t*\t0\t0\tAC\tII\n")
    got = {r.read_name: (r.read_start, r.read_end) for r in sam.read_sam(spark, str(tmp_path / "x.sam")).collect()}
    assert got == {"r1": (4, 10), "r2": (0, 0)}
    assert sam.properly_paired(sam.read_sam(spark, str(tmp_path / "x.sam"))).count() == 1
    assert tuple(sam.references(spark, str(tmp_path / "x.sam")).first()) == ("c1", 99)


def test_hits(spark, tmp_path):
    hsp = "<Hsp><Hsp_evalue>1e-9</Hsp_evalue><Hsp_align-len>{}</Hsp_align-len></Hsp>"
    hit = "<Hit><Hit_def>t|b</Hit_def><Hit_hsps>" + hsp.format(10) + hsp.format(400) + "</Hit_hsps></Hit>"
    (tmp_path / "x.xml").write_text(f"<O><Iteration><Iteration_query-def>t|a x</Iteration_query-def><Iteration_hits>{hit}</Iteration_hits></Iteration></O>")
    got = hits.long_hits(hits.read_xml(spark, str(tmp_path / "x.xml")), 300).collect()
    assert [(r.query, r.target, r.align_len) for r in got] == [("t|a x", "t|b", 400)]


def test_pending(spark):
    df = spark.createDataFrame([("a",), ("b",)], "group_id string")
    assert [r[0] for r in manifest.pending(df, df.limit(1)).collect()] == ["b"]


def test_fasta_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(">t|a\nAC\n>t|b\nGG\n")
    q = arrivals.fasta_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert {r["name"] for r in spark.table("arrived").collect()} == {"t|a", "t|b"}


def test_windowed_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:01:00"), ("a", "2024-01-01 00:02:00"), ("b", "2024-01-01 00:12:00")], "n string, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    counted = arrivals.counts_by_window(stream, F.col("n"), "t", "10 minutes", "1 hour")
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert {(r["seq_name"], r["n"]) for r in spark.table("counted").collect()} == {("a", 2), ("b", 1)}
