import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from mirrorplan.llm import _jaccard, simhash
from mirrorplan.llm._state import discard, materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets:
        for j, t in sets:
            if s == t or 5 * len(s & t) >= 4 * len(s | t):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {(i, find(i)) for i, _ in rows}


def table():
    rnd = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([5, 12, 90, 250, 400]))] + (passage if rnd.random() < 0.5 else [])
        rows.append(base)
        for share in (0.003, 0.01, 0.02, 0.03, 0.05):
            rows.append([rnd.choice(vocabulary) if rnd.random() < share else w for w in base])
        rows.append([*base, *base[:20]])
    hub = [rnd.choice(vocabulary) for _ in range(300)]  # each copy is near the hub, few are near each other
    for _ in range(40):
        cut = set(rnd.sample(range(300), 6))
        rows.append([f"x{rnd.random()}" if k in cut else w for k, w in enumerate(hub)])
    rows.append(hub)
    texts = [(k, " ".join(w)) for k, w in enumerate(rows)]
    rnd.shuffle(texts)
    return texts + [(5000, None), (5001, ""), (5002, " \t"), (5003, "A b"), (5004, "a  B "), (5005, "a b c")]


@pytest.mark.parametrize("block", [2000, 7])
def test_every_pair_is_found(spark, monkeypatch, block):
    monkeypatch.setattr(_jaccard, "_BLOCK", block)
    rows = table()
    got = {tuple(r) for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == plain_components(rows)


def test_stage_removes_near_copies(spark):
    rows = table()
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id bigint, text string, lang string")
    kept = cp.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    want = {c for _, c in plain_components(rows)}
    assert {r.doc_id for r in kept.collect()} == want and len(want) < 0.6 * len(rows)


def test_edges_of_input(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_copies(empty).collect() == []
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "x y z"), (3, "a b c"), (4, "x y z"), (5, "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in simhash.near_copies(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 1), (5, 5)]
    assert sorted(r.doc_id or 0 for r in simhash.keep_similar(df).collect()) == [0, 1, 5]


def test_unlike_long_texts_are_parted_by_their_maps(spark):
    """Half of a long text in common meets the bounds of the short words; only pairs near the similarity are left to be counted."""
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    texts = [words(0, 3000), words(1000, 4000), words(300, 3300), words(5000, 6100), words(5090, 6100), words(4500, 5900), words(8000, 8400), words(8020, 8400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    nodes = _jaccard.nodes_of(_jaccard.marks(docs)).cache()
    ids = {r["key"]: r["node"] for r in nodes.collect()}
    pairs = nodes.alias("x").crossJoin(nodes.alias("y")).where("x.key < y.key").selectExpr("x.key as a", "y.key as b")
    short = pairs.join(nodes.alias("x"), F.col("x.key") == F.col("a")).join(nodes.alias("y"), F.col("y.key") == F.col("b")).where(_jaccard._bounds("x", "y"))
    named = lambda df: {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in df.collect()}
    close = {(0, 2), (3, 4), (6, 7)}  # 1100 and 1010 words have maps of 2048 and 1024 places
    assert (0, 1) in named(short) and named(_jaccard.may_reach(pairs, nodes)) == close == named(_jaccard.verified(pairs, docs, nodes))
    nodes.unpersist()


def test_steps_leave_no_shuffle_files(spark):
    """What is written between steps is all that is left of them."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: sum("/shuffle_" in str(manager.getAllFiles().apply(k)) for k in range(manager.getAllFiles().size()))
    before = shuffles()
    made = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):  # files go a little later
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and made.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    discard(made)
