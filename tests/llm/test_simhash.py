import itertools
import random
import re

import xxhash

from mirrorplan.llm import _text, simhash
from mirrorplan.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def plain_fp(text):
    w = WORD.findall(lower(text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = {}
    for i, t in rows:
        fps.setdefault(plain_fp(t), set()).add(i)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(fps)
    for a in keys:
        for b in keys:
            if (a ^ b).bit_count() <= 3:
                for x in fps[a] | fps[b]:
                    p, q = find(x), find(min(fps[a]))
                    root[max(p, q)] = min(p, q)
    return {(i, f"{plain_fp(t):016x}", find(i)) for i, t in rows}


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    base = max((t for _, t in rows), key=len)
    words = base.split()
    rows += [(1000 + k, " ".join(words[:k] + ["x"] + words[k + 1 :])) for k in range(0, 60, 3)]
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  b"), (2004, " x  y"), (2005, base * 5), (2006, base)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'z' as fp", "1 as component_id")
    got = {tuple(r) for r in simhash.near_duplicates(df).collect()}
    assert got == plain_components(rows)
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert kept == {c for _, _, c in got}


def test_links_join_what_pairs_join(spark):
    """Every edge is a pair of 3 bits or fewer, and the components are those of all such pairs; a dense ball has few edges."""
    rnd = random.Random(5)
    seeds = [rnd.getrandbits(64) for _ in range(6)]
    fps = set(seeds)
    for s in seeds:
        for bits in itertools.islice(itertools.combinations(rnd.sample(range(64), 12), 3), 60):
            fps.add(s ^ sum(1 << b for b in bits))
    for k in range(60):  # chains, whose ends are far apart, and lone ones
        x = rnd.getrandbits(64)
        for _ in range(k % 4 + 1):
            fps.add(x)
            x ^= sum(1 << b for b in rnd.sample(range(64), 3))
    x, bits = rnd.getrandbits(64), rnd.sample(range(64), 11)
    fps |= {x ^ sum(1 << b for k, b in enumerate(bits) if c >> k & 1) for c in range(1 << 11)}  # a dense ball
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = {(r.a, r.b) for r in simhash.anchor_links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()}
    pairs = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}

    def groups(some):
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in some:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
        return {x: find(x) for x in signed}

    assert edges <= pairs and groups(edges) == groups(pairs)
    assert len(edges) <= 32 * len(fps) < len(pairs)


def test_long_texts_go_in_pieces(monkeypatch):
    rnd = random.Random(8)
    texts = [" ".join(f"W{rnd.randrange(50)}" for _ in range(k)) for k in (0, 1, 2, 3, 4, 5, 9, 200)] + ["x" * 90, " \t", "a  b"]
    whole = [(simhash.fingerprint(t.encode()), simhash._jaccard.token_set(t.encode()).tolist()) for t in texts]
    for size in (1, 7, 30):
        for module in (simhash, simhash._jaccard):
            monkeypatch.setattr(module, "split_pieces", lambda t, n=size: _text.split_pieces(t, n))
        assert [(simhash.fingerprint(t.encode()), simhash._jaccard.token_set(t.encode()).tolist()) for t in texts] == whole
    monkeypatch.undo()
    assert [f for f, _ in whole] == [plain_fp(t) for t in texts]
    big = b" ".join([b"some words of a long text"] * 2_100_000)  # over 50 MB
    assert len(big) > 50 << 20 and simhash.fingerprint(big) == simhash.fingerprint(big[: 26 * 1000 - 1])


def test_edges_of_input(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(empty).collect() == []
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "x y z"), (3, "a b c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, None), (1, 1), (1, 1), (2, 1), (3, 1), (3, 1)]
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(df).collect()) == [0, 1]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 50)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}


def test_visits_are_not_broadcast(spark):
    """32 visits of each fingerprint, which Spark sizes as if there were one."""
    meets = simhash._meets(spark.range(300).selectExpr("xxhash64(id) as fp").union(spark.range(300).selectExpr("xxhash64(id) ^ 5 as fp")))
    assert meets.where("bit_count(a ^ b) <= 3").count() >= 300
    meets.collect()
    assert "Broadcast" not in meets._jdf.queryExecution().executedPlan().toString()
