import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from clademill.operators import rejects

GOOD = "t|c,2024-02-29,4,ACGT,d"
CASES = {
    GOOD: None, GOOD + "\r": None, '"t|c","2024-02-29","4","ACGT","a ""b"", c\nd"': None, "t|c,2024-02-29,4,ACGT,": None,
    't|c,2024-02-29,04,ac-N,"x\ry"': None,
    None: "null line", "": "wrong number of fields", "t|c,2024-02-29,4,ACGT": "wrong number of fields", GOOD + ",": "wrong number of fields",
    't|c,2024-02-29,4,ACGT,"d': "unclosed quote", GOOD + "\n": "line break outside quotes", GOOD + "\r\r": "line break outside quotes",
    't|c,2024-02-29,4,ACGT,a"b"': "quote inside an unquoted field", 't|c,2024-02-29,4,ACGT,"a"b': "text after a closing quote",
    "t|c|d,2024-02-29,4,ACGT,d": "seq_id is not taxon|contig", "t |c,2024-02-29,4,ACGT,d": "seq_id is not taxon|contig", "|c,2024-02-29,4,ACGT,d": "seq_id is not taxon|contig",
    "t|c x,2024-02-29,4,ACGT,d": "seq_id is not taxon|contig",
    "t|c,2023-02-29,4,ACGT,d": "loaded_on is no day", "t|c,2024-2-29,4,ACGT,d": "loaded_on is no day", "t|c,2024-02-29,x,ACGT,d": "n_bases is no number",
    "t|c,2024-02-29,5,ACGT,d": "n_bases is not the length of seq", "t|c,2024-02-29,0,,d": "seq has other letters or none", "t|c,2024-02-29,4,ACGJ,d": "seq has other letters or none",
}


def test_reasons(spark):
    rows = [(i, raw, "extra") for i, raw in enumerate(CASES)] + [(0, GOOD, "extra")]
    df = spark.createDataFrame(rows, "raw_id long, raw string, seq string")
    got = rejects.parse_contig_lines(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = list(CASES.values())[r.raw_id]
        assert r.reason == want, (list(CASES)[r.raw_id], r.reason)
        assert (r.seq_id is None) == (want is not None)
    quoted = next(r for r in got if r.raw_id == 2)
    assert quoted.description == 'a "b", c\nd' and quoted.n_bases == 4


def test_empty_and_long(spark):
    assert rejects.parse_contig_lines(spark.createDataFrame([], "raw_id long, raw string")).count() == 0
    long = "t|c,2024-01-01,300000," + "A" * 300000 + ",d"
    assert rejects.parse_contig_lines(spark.createDataFrame([(1, long)], "raw_id long, raw string")).first().reason is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(st.sampled_from('ab,"\n é'), max_size=6), min_size=3, max_size=3), min_size=1, max_size=5))
def test_well_formed_lines_come_back(rows):
    lines = []
    for r in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(r)
        lines.append(out.getvalue())
    code, fields = rejects.index_lines(pa.array(lines), 3)
    assert not code.any()
    assert [list(x) for x in zip(*(f.to_pylist() for f in fields))] == rows
