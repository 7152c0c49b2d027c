import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from mirrorplan.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows, components=16):
    """Exact covariance in fractions, NumPy's own eigenvectors. {vec_id: rows of results}, and how far each may be off in sign."""
    rows = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    v = np.array([[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3)) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    out = []
    for i, x in rows:
        away = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
        out.append((i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), away @ q[:, :k] / np.sqrt(e[:k])))
    return out, e[:k] / v.trace()


def check(found, rows, components=16):
    want, explained = plain(rows, components)
    got = sorted((tuple(r) for r in found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()), key=lambda r: (r[0], r[1]))
    k = len(explained)
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(i, c + 1, n, dev) for i, n, dev, _ in sorted(want, key=lambda w: w[0]) for c in range(k)]
    w = np.array([r[4] for r in got]).reshape(-1, k)
    truth = np.array([x for _, _, _, x in sorted(want, key=lambda w: w[0])])
    signs = np.sign((w * truth).sum(0))
    assert np.abs(w * signs - truth).max() < 1e-8
    assert np.abs(np.array([r[5] for r in got]).reshape(-1, k) - explained).max() < 1e-12
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-9


def test_query(spark):
    at = "/root/testdata/sf0.01"
    rows = [tuple(r.values()) for r in pq.read_table(f"{at}/embeddings.parquet").select(["vec_id", "embedding"]).to_pylist()]
    check(entry.queries()["op12_whitening"](spark, at), rows)


def test_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, list(map(float, rng.normal(3, [5, 2, 2, 0.5, 0.1], 5)))) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(90)]  # copies are whitened, and counted once
    bad = [(2000, None), (2001, [None] * 5), (2002, [math.nan, *[0.0] * 4]), (2003, [math.inf, *[0.0] * 4])]
    df = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "1 as x", "2 as n", "'a' as component")
    check(whitening.report(df, 3), rows, 3)
    wide = {r["vec_id"]: r["whitened"] for r in whitening.whiten(df, components=3).collect()}
    tall = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.report(df, 3).collect()}
    assert len(wide) == 390 and all(abs(wide[i][c - 1] - w) < 1e-9 for (i, c), w in tall.items())
    # fewer dimensions than components; a direction without spread
    check(whitening.report(spark.createDataFrame([(i, [*v[:2], 7.0]) for i, v in rows], SCHEMA)), [(i, [*v[:2], 7.0]) for i, v in rows])
    # short vectors, as if zeros followed
    check(whitening.report(spark.createDataFrame([*rows, (5000, [1.5])], SCHEMA)), [*rows, (5000, [1.5, 0, 0, 0, 0])])
    for same in ([], [(1, [])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])], [(1, None)]):
        assert whitening.report(spark.createDataFrame(same, SCHEMA)).collect() == []
    # entries whose squares are no longs
    far = [(i, [1e300 * (-1) ** i, float(i), float(i * i % 7)]) for i in range(6)]
    got = whitening.report(spark.createDataFrame(far, SCHEMA)).collect()
    assert len(got) >= 6 and all(r["deviation"] is None and math.isfinite(r["whitened"]) for r in got)


@pytest.mark.parametrize("kind", ["spread", "equal", "pairs", "tiny", "big", "one", "two"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(2)
    n = {"one": 1, "two": 2, "big": 300}.get(kind, 40)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    e = {"equal": np.full(n, 3.0), "pairs": np.repeat(np.arange(1.0, 21), 2), "tiny": 10.0 ** -np.arange(n)}.get(kind, np.sort(rng.uniform(1, 9, n)) ** 3)
    v = q * e @ q.T
    v = (v + v.T) / 2
    k = min(16, n)
    values, vectors = whitening.leading(v, k)
    want = np.linalg.eigvalsh(v)[::-1][: len(values)]
    assert np.abs(values - want).max() < 1e-13 * n * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * n * want[0]
    assert len(values) == (k if kind != "tiny" else int((want > 1e-12 * want[0]).sum()))


def test_sums_past_longs(spark):
    """Products that no long holds stay exact."""
    rows = [(1, [1 << 40, 3]), (2, [-(1 << 40), 5]), (3, [(1 << 40) - 1, 9])]
    df = spark.createDataFrame(rows, "vec_id bigint, x array<bigint>")
    n, sums, products = whitening._summed(df, 2, [1, 2])
    ys = [(x - 1, y - 2) for _, (x, y) in rows]
    assert n == 3 and sums == [sum(y[i] for y in ys) for i in (0, 1)]
    assert [[int(p) for p in r] for r in products] == [[sum(y[i] * y[j] for y in ys) for j in (0, 1)] for i in (0, 1)]
