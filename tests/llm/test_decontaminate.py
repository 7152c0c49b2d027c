import hashlib
import re

import __spark_entry__ as entry
from mirrorplan.llm import decontaminate as d
from tests.llm.oracle import compare

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    wins = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            m = min(n, len(w))
            for k in range(len(w) - m + 1):
                wins.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    out = set()
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in wins:
                    hit |= set(range(k, k + m))
                    ids |= wins[tuple(w[k : k + m])]
        out.add((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_oracle(spark):
    assert compare(spark, entry, "op6_decontaminate", "/root/testdata/sf0.01") == 1000


def test_edges(spark, monkeypatch):
    item = "One two three four five six seven eight nine ten eleven"
    items = [(1, item), (2, "short ITEM"), (2, None), (None, "zz"), (3, "--"), (10, item + " twelve"), (4, "ünïcode wörd")]
    docs = [(1, f"a {item.upper()} b"), (1, f"a {item} b"), (2, None), (3, ""), (4, "a short, item! b"), (5, item), (None, "zz short item"),
            (6, "x ÜnÏcode"), (7, "ünïcode\nwörd ok"), (8, " ".join(item.split()[:9])), (9, f"one two three four {item} five six seven eight nine ten eleven end")]
    df = spark.createDataFrame([(*r, 1, "q") for r in docs], "doc_id bigint, text string, n_words int, _hits string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (d.BLOCK_BYTES, 60):  # in one block and in several
        monkeypatch.setattr(d, "BLOCK_BYTES", size)
        assert {tuple(r) for r in d.contamination(df, bench).collect()} == brute(docs, items)
        cut = d.decontaminate(df, bench).collect()
        assert {(r.doc_id, r.text) for r in cut} == {(1, "a  b"), (2, None), (3, ""), (4, "a ! b"), (None, "zz "), (6, "x ÜnÏcode"), (7, " ok"), (8, docs[9][1]), (9, " end")}
        kept = d.decontaminate(df, bench, remove="documents")
        assert {r.doc_id for r in kept.collect()} == {2, 3, 6, 8} and kept.columns == df.columns
    assert d.contamination(df.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in d.contamination(df, bench.limit(0)).collect())


def test_blocks_are_bounded(spark, monkeypatch):
    """Repeated rows count once, a long item goes in parts, no broadcast passes the bound, and the result is the same."""
    monkeypatch.setattr(d, "BLOCK_BYTES", 400)
    long = " ".join(f"w{k}" for k in range(300))
    items = [(1, long)] * 50 + [(2, "a short one")] * 50 + [(3, f"x {long[:200]}")]
    docs = [(k, " ".join(f"w{j}" for j in range(9 * k, 9 * k + k))) for k in range(30)] + [(99, "so a short one"), (98, long)]
    seen = []
    build = d.build_windows
    monkeypatch.setattr(d, "build_windows", lambda rows, n: seen.append(sum(len(t) for _, t in rows)) or build(rows, n))
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in d.contamination(df, bench).collect()} == brute(docs, items)
    assert len(seen) > 3 and max(seen) <= 400
