import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
from mirrorplan.llm import packing as p

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def check(docs, rows):
    """Every id in exactly one piece, sequences gapless and within the window; returns the padding."""
    whole = Tokenizer.from_file(VOCABULARY)
    want = sorted((i or -1, zlib.crc32(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))) for i, t in docs)
    ids = {}
    for i, t in docs:
        ids.setdefault(i, []).append(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    for r in rows:
        assert any(r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length]) == r.ids_crc32 for x in ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v) and want
    for i, texts in ids.items():
        if len(texts) == 1:
            mine = sorted((r.start, r.length) for r in rows if r.doc_id == i)
            assert [a for a, _ in mine] == list(np.cumsum([0, *(n for _, n in mine)])[:-1])
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [a for a, _ in s] == list(np.cumsum([0, *(n for _, n in s)])[:-1]) and sum(n for _, n in s) <= p.WINDOW
    return len(seqs) * p.WINDOW - sum(r.length for r in rows)


def test_round_trip(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = entry.queries()["op4_packing"](spark, sf).collect()
    padding = check(docs, rows)
    assert padding < 0.01 * sum(r.length for r in rows)


def test_edges(spark, monkeypatch):
    docs = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "x <|endoftext|> y"), (None, "no id"), (5, "word " * 9000), (6, "ça va？ 　日本語 \x00\t\r\n " * 30), (7, "x" * 5000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as start", "2 as bin")
    check(docs, p.pack(df, VOCABULARY).collect())
    monkeypatch.setattr(p, "GREEDY_IDS", 50)
    check(docs, p.pack(df, VOCABULARY).collect())
    assert p.pack(df.limit(0), VOCABULARY).collect() == []


def test_encoders_agree():
    whole, fast = Tokenizer.from_file(VOCABULARY), p.encoder(VOCABULARY)
    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(9, 14), rnd.randrange(160, 0x2100), rnd.randrange(0x3000, 0xD7FF), rnd.randrange(0x1F300, 0x1F9FF)])) for _ in range(80))
        assert fast(text) == whole.encode(text, add_special_tokens=False).ids


def test_least_squares():
    rnd = np.random.default_rng(2)
    a = rnd.random((8, 20))
    x = p.nnls(a, a @ np.maximum(0, rnd.normal(size=20)))
    assert x.min() >= 0 and np.maximum(0, a.T @ (a @ np.maximum(0, rnd.normal(size=20)) * 0)).max() == 0
    b = rnd.random(8)
    x = p.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert slope.max() < 1e-6 and np.abs(slope[x > 1e-9]).max() < 1e-6  # the optimum's conditions
    assert len(p.combinations(64, 3)) == 374 and set(p.combinations(4, 2)) == {(4,), (3, 1), (2, 2)}
    chosen, left = p.plan(np.array([5, 0, 5, 2]))
    assert left.min() >= 0 and ((4,), 2) in chosen and ((3, 1), 5) in chosen and left.sum() == 0
