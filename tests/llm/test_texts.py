import os
import random

import pytest
from pyspark.sql import functions as F

from clademill.llm import encode, packing, spans, splitting, tokenizer

tiktoken = pytest.importorskip("tiktoken")
RANKS = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(encode.TOKENIZERS, RANKS[0])), reason="no vocabulary files")
TEXTS = [
    None, "", " ", "\n\n\n", "a", "it's  we'll 'tis ''s\n'd", "def f(x):\n    return x  # café 你好 \U0001f600\n", "\t\t x\r\n\r\n  y  z　", "=" * 700, "A1b2" * 400,
    "a" * 30000, "mixed �\u0000 123456789 ١٢ é", "x'll'sama 's", "   \u0085 end ",
]


def reference(name):
    ranks = tokenizer.load_ranks(os.path.join(encode.TOKENIZERS, name))
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS + TEXTS[:4])]
    return spark.createDataFrame(rows, "id int, text string, ids string")


@pytest.mark.parametrize("name", RANKS)
def test_encode_and_decode(spark, texts, name):
    want = reference(name)
    encoded = encode.encode(texts, "text", ["id"], ranks=name)
    got = {r.id: r.ids for r in encoded.collect()}
    rows = {r.id: r.text for r in texts.collect()}
    assert got == {i: want.encode_ordinary(t or "") for i, t in rows.items()}
    back = {r.id: r.text for r in encode.decode(encoded, "ids", ["id"], ranks=name).collect()}
    assert back == {i: t or "" for i, t in rows.items()}
    counted = {r.id: r.n_tokens for r in encode.count_tokens(texts, "text", ["id"], ranks=name).collect()}
    assert counted == {i: len(x) for i, x in got.items()}
    assert encode.encode(texts.limit(0), "text", ["id"], ranks=name).count() == 0


@pytest.mark.parametrize("name", RANKS)
@pytest.mark.parametrize("states", [50, 10**9])
def test_transducer_equals_merging(name, states, monkeypatch):
    monkeypatch.setattr(tokenizer, "MAX_STATES", states)
    want, rnd = reference(name), random.Random(states)
    machine = tokenizer.Transducer(tokenizer.load_ranks(os.path.join(encode.TOKENIZERS, name)))
    for _ in range(1500):
        letters = rnd.choice(["ab", "abc ", "\t ", "=-", "éüß", "的一", "0123", "thein", "abcdefgh"])
        piece = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))).encode()
        assert machine.encode(piece) == want._encode_single_piece(piece)
    assert len(machine.keys) <= states + 60


@pytest.mark.parametrize("name", RANKS)
@pytest.mark.parametrize("block,moves", [(4096, 10**6), (5, 300)])
def test_states_are_shared_by_random_letters(name, block, moves, monkeypatch):
    """p10_pieces: binary patches are random letters; states that held the tokens before made nearly one state a piece."""
    monkeypatch.setattr(tokenizer, "BLOCK", block)
    monkeypatch.setattr(tokenizer, "MAX_MOVES", moves)
    want, rnd = reference(name), random.Random(block)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = {"".join(rnd.choice(letters[-12:-2] if i % 3 else letters) for _ in range(rnd.randint(1, 12))) for i in range(6000)}
    texts |= {"a" * 300, "a" * 301, "\0", "\0\0", "é", "éü", "你", "你好", "\U0001f600" * 9, "the" * 40, "the" * 41, "=-" * 100}
    pieces = sorted(x.encode() for x in texts)
    machine = tokenizer.Transducer(tokenizer.load_ranks(os.path.join(encode.TOKENIZERS, name)))
    one_by_one = [machine.encode(x) for x in pieces]
    assert one_by_one == [want._encode_single_piece(x) for x in pieces]
    assert len(machine.keys) < len(pieces) / 2
    count, ids = machine.encode_sorted(pieces)
    assert count == [len(x) for x in one_by_one] and ids == [i for x in one_by_one for i in x]
    assert machine.encode_sorted([]) == ([], []) and machine.encode(b"") == []


def test_streaming_decode_keeps_characters(spark):
    ranks = tokenizer.load_ranks(os.path.join(encode.TOKENIZERS, RANKS[0]))
    ids = reference(RANKS[0]).encode_ordinary("你\U0001f600x")
    machine = tokenizer.Decoder(ranks)
    assert "".join(machine.stream([i] for i in ids)) == "你\U0001f600x"
    rows = [(1, ids[:1], 0), (2, ids, 0), (3, None, 0), (4, [], 0), (5, ids[-1:], 0)]
    got = {r.id: r.text for r in encode.decode(spark.createDataFrame(rows, "id int, ids array<int>, text int"), "ids", ["id"]).collect()}
    assert got == {1: "".join(machine.stream([ids[:1]])), 2: "你\U0001f600x", 3: None, 4: "", 5: "x"} and "\ufffd" in got[1]


def test_packing(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([0, None, 1, 7, 64, 65, 200, rnd.randint(1, 64)]), 1) for i in range(3000)] + [(0, 5, 1), (0, 5, 1)]
    df = spark.createDataFrame(rows, "id long, n long, container int")
    got = packing.pack(df, "id", "n", 64, 20_000).collect()
    sums, last = {}, {}
    for r in sorted((r for r in got if r.container), key=lambda r: (r.container, r.offset)):
        assert r.offset == last.get(r.container, 0)
        last[r.container] = r.offset + r.n_tokens
    assert max(last.values()) <= 64
    for r in got:
        sums[r.id] = sums.get(r.id, 0) + r.n_tokens
    want = {}
    for i, n, _ in rows:
        want[i] = want.get(i, 0) + (n or 0)
    assert sums == want
    whole = [n for _, n, _ in rows if n and n <= 64]
    assert sum(1 for r in got if r.container and r.n_tokens <= 64 and r.piece == 0) >= len(whole)
    assert sum(last.values()) / (64 * len(last)) > 0.97
    assert packing.pack(df.limit(0), "id", "n").count() == 0


def test_place_prefers_full_containers():
    container, offset = packing.place(__import__("numpy").array([10, 54, 64, 30, 34]), 64)
    assert container.tolist() == [0, 0, 1, 2, 2] and offset.tolist() == [0, 10, 0, 0, 30]


@pytest.mark.parametrize("limit,overlap", [(32, 0), (32, 8), (8, 4), (4, 0)])
def test_splitting(spark, texts, limit, overlap):
    diff = "commit " + "ab12" * 10 + "\nmsg\n" + "".join(f"diff --git a/f{i} b/f{i}\n@@ -1,2 +1,2 @@\n-old {i}\n+new 你好\U0001f600 {i}\n" for i in range(12))
    df = texts.unionByName(spark.createDataFrame([(99, diff, "")], texts.schema)).filter("length(text) < 20000 OR text IS NULL")
    got = splitting.split_texts(df, "id", "text", limit, overlap).collect()
    rows = {r.id: r.text for r in df.collect()}
    counted = {(r.k.id, r.k.piece): r.n_tokens for r in encode.count_tokens(spark.createDataFrame([((r.id, r.piece), r.text) for r in got], "k struct<id:int,piece:int>, text string"), "text", ["k"]).collect()}
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert set(by) == set(rows)
    for i, parts in by.items():
        parts.sort(key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(parts[0].n_pieces))
        if len(parts) == 1:
            assert parts[0].text == rows[i]
            continue
        assert all(p.n_tokens <= limit for p in parts)
        if limit >= 8:
            assert all(counted[i, p.piece] <= limit for p in parts)
        if overlap == 0 and limit >= 8:
            assert "".join(p.text for p in parts) == rows[i]
        for a, b in zip(parts, parts[1:]):
            assert max(0, overlap - 3) <= a.start_token + a.n_tokens - b.start_token <= overlap
    if (limit, overlap) == (32, 0):
        assert sum(p.text.startswith("diff --git") or p.text.startswith("\ndiff --git") for p in by[99]) >= 6


def test_splitting_needs_room(texts):
    with pytest.raises(ValueError):
        splitting.split_texts(texts, "id", "text", 8, 5)


def brute_spans(rows, k):
    words, where = {}, {}
    for name, row, seq in rows:
        s = (seq or "").upper().replace("-", "")
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if name is not None and set(w) <= set("ACGT"):
                words.setdefault(w, set()).add(name)
                where.setdefault(w, set()).add((row, i))
    shared = {w for w, n in words.items() if len(n) > 1}
    cover = {}
    for w in shared:
        for row, i in where[w]:
            cover.setdefault(row, set()).update(range(i, i + k))
    return {(a, b) for w in shared for a in words[w] for b in words[w] if a < b}, {r: len(c) for r, c in cover.items()}


@pytest.mark.parametrize("block", [1 << 20, 97])
def test_spans_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spans, "BLOCK", block)
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    parts = [word(n) for n in (40, 60, 90, 130)]
    rows = []
    for i in range(60):
        s = word(rnd.randint(0, 30)) + rnd.choice(parts)[rnd.randint(0, 20) :] + word(rnd.randint(0, 20)) + rnd.choice(parts)[: rnd.randint(20, 130)]
        if rnd.random() < 0.3:
            s = s[:30].lower() + "-" + s[30:60] + rnd.choice("N-") + s[60:]
        rows.append((rnd.choice([None, f"n{i}", f"n{i // 2}"]), i, s))
    rows += [("t1", 100, "ACAC" * 40), ("t2", 101, "ACAC" * 30 + "G" * 50), ("t3", 102, "G" * 45), ("t4", 103, None), ("t5", 104, ""), rows[0][:1] + (105, rows[0][2])]
    own = word(150)
    rows += [("t6", None, rows[1][2]), ("t7", 106, word(500) + "N" + own), ("t8", 107, word(10) + own.lower() + word(300))]
    df = spark.createDataFrame(rows, "name string, row long, seq string").withColumns({x: F.lit("clash") for x in ("path", "doc", "key", "seed", "at")})
    paths = spans.shared_paths(df, F.col("name"), F.col("row"), F.col("seq"), 40)
    pairs, cover = brute_spans(rows, 40)
    assert pairs and {tuple(r) for r in spans.span_pairs(paths).collect()} == pairs
    assert {(r.name, r.at, r.path) for r in paths.collect() if r.name in ("t7", "t8")} == {("t7", 501, own), ("t8", 10, own)}
    share = {r.row: r.n_shared for r in spans.shared_share(df, paths, F.col("name"), F.col("row"), F.col("seq")).collect()}
    assert {r: n for r, n in share.items() if n} == cover and len(share) == len(rows)
    assert spans.span_pairs(spans.shared_paths(df.limit(0), F.col("name"), F.col("row"), F.col("seq"), 40)).count() == 0
