import hashlib
import random
import re

import numpy as np

import __spark_entry__ as entry
from mirrorplan.llm import substrings as s

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, size=20):
    """docs in order; rows with one id are not earlier than each other."""
    out, seen = [], {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        w = WORD.findall(t or "")
        gone, own = set(), set()
        for k in range(len(w) - size + 1):
            win = tuple(w[k : k + size])
            if win in own or any(j != i for j in seen.get(win, ())):
                gone |= set(range(k, k + size))
            own.add(win)
        for win in own:
            seen.setdefault(win, set()).add(i)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, entry.queries()["op3_substrings"](spark, sf).collect()), key=str)
    assert got == brute(docs)
    assert sum(r[2] for r in got) > 1000


def test_shared_passages(spark):
    rnd = random.Random(8)
    vocabulary = ["a", "b", "The", "é", "of", *(f"w{k}" for k in range(30))]
    pool = [[rnd.choice(vocabulary) for _ in range(n)] for n in (19, 20, 21, 25, 40, 41, 90, 200)]
    pool += [["x"] * 60, ["x", "y"] * 25]
    docs = []
    for i in range(80):
        w = []
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(pool)
            a = rnd.randrange(len(p))
            w += p[a : a + rnd.randrange(10, 80)] + [rnd.choice(vocabulary) for _ in range(rnd.randrange(4))]
        docs.append((i, rnd.choice([" ", "\n", "\t \x0b"]).join(w)))
    docs += [(100, None), (101, ""), (102, " \n"), (103, docs[5][1]), (None, " ".join(pool[6])), (104, " ".join(["x"] * 3000)), (105, docs[7][1]), (105, docs[7][1]), (105, "\x85 " + " ".join(pool[7]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as did", "2 as reaches")
    assert sorted(map(tuple, s.substring_report(df).collect()), key=str) == brute(docs)
    assert s.substring_report(df.limit(0)).collect() == []
    cut = s.remove_repeats(df)
    assert cut.columns == df.columns
    kept = sorted(((r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in cut.collect()), key=str)
    assert kept == sorted(((r[0], r[3]) for r in brute(docs)), key=str)


def thue_morse(n, flip):
    return "".join("ab"[bin(k).count("1") + flip & 1] for k in range(n))


def test_structured_words_are_told_apart(spark):
    """Words, and runs of words, whose every power sum modulo 2^64 is equal."""
    x, y = thue_morse(1024, 0), thue_morse(1024, 1)
    before, after = [f"p{k}" for k in range(19)], [f"q{k}" for k in range(19)]
    docs = [(k, " ".join([*before, w, *after])) for k, w in enumerate((x, y, x))]
    docs += [(10 + k, " ".join([*before[:9], w, w, *after[:9]])) for k, w in enumerate((x, y, y))]
    docs += [(20 + k, " ".join(thue_morse(32, k % 2))) for k in range(4)]
    got = sorted(map(tuple, s.substring_report(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()), key=str)
    assert got == brute(docs) and {r[0] for r in got if r[2]} == {2, 12, 22, 23}


def test_lanes_are_independent_and_runs_are_whole():
    rnd = random.Random(3)
    words = [str(rnd.random()).encode() for _ in range(400)]
    p = s._piece(words, np.zeros(400, np.int64))
    for lane in (0, 1):
        for n in (1, 5, 19, 20, 35):
            runs = s._runs(p.lanes[lane], n, lane)
            assert len(runs) == 400 - n + 1 == len(set(runs.tolist()))
            assert all(runs[k] == s._runs(p.lanes[lane][k : k + n], n, lane)[0] for k in (0, 7, 400 - n))
    assert not set(p.lanes[0].tolist()) & set(p.lanes[1].tolist())


def test_long_texts_go_in_pieces(spark, monkeypatch):
    rnd = random.Random(4)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    docs = [(1, " ".join(long[700:760])), (2, " ".join(long)), (3, " ".join(long[:500] + ["x"] + long[480:520])), (4, "y" * 900)]
    monkeypatch.setattr(s, "CHUNK_BYTES", 300)
    parts = {}
    for k, (_, text) in enumerate(docs):
        data, offs = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
        parts[k] = sum(max(0, len(p.row) - 19) for p in s._pieces(data, offs, 0, 1))
    assert parts == {k: max(0, len(t.split()) - 19) for k, (_, t) in enumerate(docs)}
    monkeypatch.undo()
    big = " ".join(f"v{rnd.randrange(10**7)}" for _ in range(6_000_000))  # over 50 MB
    assert len(big) > 50 << 20
    rows = [*docs, (5, big), (6, big[30 << 20 :])]
    got = {r.doc_id: r for r in s.substring_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [tuple(got[k]) for k in (1, 2, 3, 4)] == brute(docs)
    assert got[5].n_removed == 0 and got[6].n_removed >= got[6].n_words - 1
