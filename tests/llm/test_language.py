import random
import zlib

import numpy as np

import __spark_entry__ as entry
from mirrorplan.llm import language as lang


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in entry.queries()["op2_language"](spark, sf).collect()}
    assert got.keys() == true.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 150 and np.mean([got[i].lang_pred == true[i] for i in held]) > 0.98


def plain_grams(text):
    signs = "".join(c if c.isalpha() else " " for c in text.lower())
    out = {}
    for w in signs.split():
        p = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                if p[i : i + n].strip():
                    out[p[i : i + n]] = out.get(p[i : i + n], 0) + 1
    return out


def test_counts_match_plain_ones():
    texts = ["Das ist, ein Tést. das!", "", "x", "12 -- 3", "ab cd ab\nab", "Ärger İx"]
    keys, n = lang._counted(lang.gram_keys(texts))
    for r, t in enumerate(texts):
        assert sorted(n[keys >> lang._BITS == r].tolist()) == sorted(c for g, c in plain_grams(t + " ").items())


def test_edges(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("the thing there and that", "en"), ("le chat est là que les", "fr")] * 10)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "12 ?", "en"), (103, "the that", None), (None, "les chats", "fr"), (0, "the thing there and that", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as gram", "2 as n")
    got = [(r.doc_id, r.lang_pred, r.score) for r in lang.predict(df, lang.train(df)).collect()]
    assert len(got) == len(rows)
    by = {i: (k, s) for i, k, s in got}
    assert all(by[i] == ("und", 0.0) for i in (100, 101, 102)) and by[103][0] == "en" and by[None][0] == "fr"
    none = lang.train(df.limit(0))
    assert {r.lang_pred for r in lang.predict(df, none).collect()} == {"und"}
    assert lang.predict(df.limit(0), none).collect() == []


def gram_hash(gram):
    """The tie breaker, written out for one gram: its signs 21 bits each, then a 64-bit finaliser."""
    x = 0
    for sign in gram:
        x = x << 21 | (0 if sign == " " else ord(sign))
    size, mask = len(gram), (1 << 64) - 1
    x = (x + (size << 63 & mask) + size) & mask
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & mask
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & mask
    return (x ^ x >> 31) >> 24


def plain_profile(counts, top):
    return sorted(counts, key=lambda g: (-counts[g], gram_hash(g)))[:top]


def plain_predictions(docs, top):
    sums = {}
    for i, text, k in docs:
        if text is not None and k is not None and zlib.crc32(str(i).encode()) % 5:
            for g, n in plain_grams(text).items():
                sums.setdefault(k, {}).setdefault(g, 0)
                sums[k][g] += n
    known = {k: {g: r for r, g in enumerate(plain_profile(c, top))} for k, c in sums.items()}
    out = {}
    for i, text, _ in docs:
        own = plain_profile(plain_grams(text or ""), top)
        far = sorted((sum(abs(ranks[g] - r) if g in ranks else top for r, g in enumerate(own)), k) for k, ranks in known.items())
        out[i] = (far[0][1], round(1 - far[0][0] / (len(own) * top), 12)) if own else ("und", 0.0)
    return out


def test_predictions_against_plain_profiles(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(9000 + k, "ab ba", lang_) for k, lang_ in enumerate(("zz", "yy", "zz", "yy", "yy", "zz", "yy", "zz"))]  # two equal profiles: a tie
    docs += [(9100, "ba ab", None), (9101, "Σας ΣΑΣ", None), (9102, "q", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.lang_pred, round(r.score, 12)) for r in lang.predict(df, lang.train(df)).collect()}
    assert got == plain_predictions(docs, lang.TOP)
    assert got[9100][0] == "yy"


def test_long_text_in_pieces(monkeypatch):
    rnd = random.Random(2)
    text = "".join(rnd.choice(["Σ", "ας", "e", "é ", " ", "\n", "x", "-", "İ"]) for _ in range(5000))
    whole = lang._counted(lang.gram_keys([text]))
    for size in (1, 7, 400):
        monkeypatch.setattr(lang, "_CHUNK", size)
        assert all((a == b).all() for a, b in zip(lang.gram_counts([text]), whole, strict=True))
    monkeypatch.undo()
    big = "ee " * 17_500_000  # over 50 MB; more of one gram than 24 bits hold
    keys, n = lang.gram_counts([big])
    assert sorted(n.tolist()) == sorted(17_500_000 * c for c in plain_grams(big[:3]).values())
    assert n.max() > 1 << 24
