import hashlib
import random

import __spark_entry__ as entry
from mirrorplan.llm import lines
from tests.llm.oracle import compare


def test_oracle(spark):
    assert compare(spark, entry, "op1_lines", "/root/testdata/sf0.01") == 1000


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs, min_chars):
    """docs: unique ids. Text after dedup of each."""
    flat = [(i, k, x) for i, t in sorted(docs, key=lambda d: d[0]) if t is not None for k, x in enumerate(t.split("\n"))]
    gone = set()
    for p, (i, k, x) in enumerate(flat):
        if x.strip(" \t\n\x0b\f\r"):
            for _, _, y in flat[:p]:
                if x == y or (min(len(x), len(y)) >= min_chars and near(x, y)):
                    gone.add((i, k))
                    break
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}


def edited(rnd, s):
    k = rnd.randrange(len(s) + 1)
    kind = rnd.randrange(3)
    c = rnd.choice("abé ")
    return s[:k] + c + s[k:] if kind == 0 or not s else s[: k - 1] + s[k:] if kind == 1 else s[: max(0, k - 1)] + c + s[k:]


def test_random_lines(spark, monkeypatch):
    rnd = random.Random(9)
    pool = ["".join(rnd.choice("ab é") for _ in range(n)) for n in (1, 2, 3, 4, 5, 5, 6, 17, 33, 64, 65, 300, 700)]
    pool += ["aaaaaaaa", "aaaaaaa", "aaaaaa", "é" * 40, ""]
    docs = []
    for i in range(60):
        own = []
        for _ in range(rnd.randrange(5)):
            s = rnd.choice(pool)
            for _ in range(rnd.randrange(3)):
                s = edited(rnd, s)
            own.append(s)
            pool.append(s)
        docs.append((i, "\n".join(own)))
    docs += [(100, None), (101, ""), (102, "\n\n \n")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'k' as line", "1 as n", "2 as place")
    for keys, least in ((lines.BROADCAST_KEYS, 4), (0, 4), (0, 1)):
        monkeypatch.setattr(lines, "BROADCAST_KEYS", keys)
        want = brute(docs, least)
        got = {r.doc_id: r for r in lines.dedup_report(df, least).collect()}
        for i, t in docs:
            assert got[i].kept_sha256 == hashlib.sha256((want[i] or "").encode()).hexdigest(), (i, t, want[i])
            assert got[i].n_lines == (0 if t is None else len(t.split("\n")))
        kept = lines.dedup_lines(df, least)
        assert kept.columns == df.columns
        full = {i: t for i, t in want.items() if dict(docs)[i] is None or not dict(docs)[i].strip() or t.strip()}
        assert {r.doc_id: r.text for r in kept.collect()} == full


def test_repeated_and_null_ids(spark):
    rows = [(5, "one line of text here"), (5, "one line of text here"), (6, "one line of text herE\nq"), (None, "null id comes first"), (1, "null id comes first"), (7, "x"), (7, "y\nx")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in lines.dedup_report(df).collect())
    assert got == [(0, 1, 0), (1, 1, 1), (5, 1, 0), (5, 1, 0), (6, 2, 1), (7, 1, 0), (7, 2, 1)] or got[-2:] == [(7, 1, 1), (7, 2, 0)]
    assert lines.dedup_report(df.limit(0)).collect() == []
