import math
import random

import numpy as np

import __spark_entry__ as entry
from mirrorplan.llm import topk
from tests.llm.oracle import compare


def brute(rows, k=5):
    vs = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            vs[i] = min(vs.get(i, q), q)
    out = set()
    for i, v in vs.items():
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in vs.items() if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def test_oracle(spark):
    assert compare(spark, entry, "op5_topk", "/root/testdata/sf0.01") == 50


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_COMPONENTS", 18)
    monkeypatch.setattr(topk, "CANDIDATE_COMPONENTS", 240)
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(400, 520)]  # ties
    rows += [(600, None), (650, [None] * 6), (651, [math.nan] + [1.0] * 5), (652, [math.inf] * 6), (None, [1.0] * 6), (700, []), (701, [9.0, 1.0]), (800, [1.0] * 9)]
    rows += [(5, [0.9] * 6), (5, [0.9] * 6), (50, [-0.2] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as score", "2 as v")
    assert {tuple(r) for r in topk.search(df).collect()} == brute(rows)
    few = rows[:3]
    assert {tuple(r) for r in topk.search(spark.createDataFrame(few, "vec_id bigint, embedding array<double>")).collect()} == brute(few)
    assert topk.search(df.limit(0)).collect() == []
    big = [(i, [1e4 * (i - 3), 1e3, -1e4 * i]) for i in range(120)]
    assert {tuple(r) for r in topk.search(spark.createDataFrame(big, "vec_id bigint, embedding array<double>")).collect()} == brute(big)


def test_threshold_prunes_and_keeps_what_counts():
    """Few survive a cutoff that few reach; none that reaches it is lost, in each type of number."""
    rnd = np.random.default_rng(5)
    for scale in (1, 300, 10**6):
        c = np.floor(rnd.normal(size=(900, 32)) * 40).astype(np.int64) * scale
        q = np.concatenate([c[:20], c[:20] + 3 * scale])
        exact, kind = q @ c.T, topk._kind(q, c)
        assert kind is {1: np.float32, 300: np.float64, 10**6: np.int64}[scale]
        cut = np.sort(exact, axis=1)[:, -3]
        total, alive = topk.survivors(q.astype(kind), c.astype(kind), cut)
        assert alive[exact >= cut[:, None]].all() and alive.mean() < 0.3
        for mask in (alive, exact >= cut[:, None]):
            rows, cols, score = topk.resolve(q.astype(kind), c.astype(kind), total, mask)
            assert (score == exact[rows, cols]).all() and len(rows) == mask.sum()
        rows, cols, score = topk.heads(q.astype(kind), c.astype(kind), np.zeros(exact.shape, bool))
        assert (score == exact[rows, cols]).all() and len(rows) == 40 * topk.HEADS


def test_copies_of_queries_are_not_broadcast(spark):
    """Queries are few, their copies are not: a row for each block of candidates, which Spark does not see."""
    rows = [(k, [float(k % 7), float(k % 5)]) for k in range(400)]
    vectors = topk.quantise(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    found = topk._meet(vectors.where("vec_id % 50 = 0"), 1, topk._blocks(vectors, "c", 16), 16, 5)
    assert found.count() > 0
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
