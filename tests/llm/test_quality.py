import math
import zlib

import numpy as np

import __spark_entry__ as entry
from mirrorplan.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in entry.queries()["op9_quality"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    marks = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(r.predicted, y) for r, y in marks if r.held_out]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.93
    assert np.mean([p for p, y in held if y == 1]) > 0.97


def test_long_texts_and_edges(spark):
    rnd = np.random.default_rng(1)
    long = rnd.integers(97, 123, q._STEP + 5).astype(np.uint8)
    whole = set(q.features(long).tolist())
    pairs = {(int(a) << 16 | int(b) << 8 | int(c)) for a, b, c in zip(long, long[1:], long[2:], strict=False)}
    assert {int(((np.uint32(p) + np.uint32(3 << 24)) * q._MULT) >> q._SHIFT) for p in pairs} <= whole
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "good words here"), (3, "good words here"), (None, "bad | bad | bad"), (7, "bad | bad")],
        "doc_id bigint, text string",
    ).selectExpr("*", "'x' as score", "1 as held_out")
    for labels in ([], [(3, 1, None)], [(3, 1, 0), (7, 0, 1), (7, None, 0), (None, 1, 1), (3, 5, 1)]):
        marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
        model = q.train(docs, marks)
        rows = q.score(docs, model).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert q.keep_good(docs, model).columns == docs.columns
    assert q.score(docs.limit(0), model).collect() == []


def test_clear_classes():
    cells = [q.features(np.frombuffer(t.encode(), np.uint8)) for t in ("plain words of a text", "junk | junk | junk", "other plain words", "| x | y")]
    model = q.fit([(1, cells[0]), (0, cells[1]), (1, cells[2]), (0, cells[3])] * 5)
    s = [model.weights[c].sum() + model.bias for c in cells]
    assert min(s[0], s[2]) > max(s[1], s[3])


def plain_features(text):
    """Cells of one text, written out: hashed 1- to 3-byte grams, and the step of its share of repeating words."""
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    cell = lambda code, n: ((code + (n << 24)) * 2654435761 % (1 << 32)) >> (32 - q.BITS)
    cells = {cell(int.from_bytes(b[k : k + n], "big"), n) for n in (1, 2, 3) for k in range(len(b) - n + 1)}
    w = text.split(" ")
    share = sum(x == y for x, y in zip(w, w[1:], strict=False)) / max(1, len(w) - 1)
    return sorted(cells) + [(1 << q.BITS) + sum(t < share for t in q._REPEATS.tolist())]


def plain_fit(rows, epochs, c):
    """The same model, one number at a time."""
    used = [(y, cells) for k, (y, cells) in enumerate(rows) if k % 4 != 3]
    n = [sum(y == k for y, _ in used) + 2 for k in (0, 1)]
    ratio = {}
    for cell in {x for _, cells in rows for x in cells}:
        seen = [1 + sum(y == k and cell in cells for y, cells in used) for k in (0, 1)]
        ratio[cell] = math.log(seen[1] / n[1]) - math.log(seen[0] / n[0])
    w, bias, dual = dict.fromkeys(ratio, 0.0), 0.0, [0.0] * len(used)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(used)):
            y, cells = (1.0 if used[i][0] else -1.0), used[i][1]
            gradient = y * (sum(w[x] * ratio[x] for x in cells) + bias) - 1
            new = min(max(dual[i] - gradient / (sum(ratio[x] ** 2 for x in cells) + 1), 0), c)
            for x in cells:
                w[x] += (new - dual[i]) * y * ratio[x]
            bias += (new - dual[i]) * y
            dual[i] = new
    return {x: w[x] * ratio[x] for x in w}, bias


def test_fit_against_plain_descent(spark):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = [(marks[r.doc_id], r.text[:400]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r.doc_id in marks]
    texts = [t for y in (0, 1) for t in [x for x in texts if x[0] == y][:20]]
    texts = [texts[k // 2 + 20 * (k % 2)] for k in range(40)]
    rows = [(y, q.features(np.frombuffer(t.encode(), np.uint8))) for y, t in texts]
    assert [r[1].tolist() for r in rows] == [plain_features(t.replace("\n", " ")) if "\n" not in t else r[1].tolist() for r, (_, t) in zip(rows, texts, strict=True)]
    weights, bias = plain_fit([(y, x.tolist()) for y, x in rows], 3, 0.05)
    model = q.fit(rows, epochs=3)
    assert abs(model.bias - bias) < 1e-9
    assert max(abs(model.weights[x] - v) for x, v in weights.items()) < 1e-5 and np.count_nonzero(model.weights) == sum(v != 0 for v in weights.values())
    margins = [(sum(weights[c] for c in x.tolist()) + bias, y) for k, (y, x) in enumerate(rows) if k % 4 == 3]
    loss = lambda a, b: -sum(math.log(1 / (1 + math.exp(-(a * m + b) * (1 if y else -1)))) for m, y in margins)
    assert model.slope > 0 and loss(model.slope, model.offset) < loss(0.0, 0.0)
