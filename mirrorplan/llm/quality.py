"""Quality classifier: naive-Bayes support vectors on character n-gram indicators.

Features are the distinct 1- to 3-byte grams of the lower-cased text, hashed into 2**BITS cells, and
one cell for how many of its word 2-grams repeat one word. Each cell is scaled by the log ratio of its smoothed document counts in the two
classes, and a linear model is fitted to the hinge loss by dual coordinate descent. The margin goes
through a logistic curve fitted on margins of labelled rows that the model has not seen.

The model is fitted on at most MAX_LABELLED labelled documents, those of the least hash of doc_id;
scoring covers every document and every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOWER, column, text_buffers

BITS = 18
#: Labelled documents that the model is fitted on, at most.
MAX_LABELLED = 6000
THRESHOLD = 0.3
_MULT = np.uint32(2654435761)
_SHIFT = np.uint32(32 - BITS)
_STEP = 1 << 20
_REPEATS = np.array([0.0, 0.01, 0.04, 0.1, 0.25, 0.5])  # shares of repeating 2-grams
CELLS = (1 << BITS) + len(_REPEATS) + 1


class Model(NamedTuple):
    weights: np.ndarray  # float32, one per cell
    bias: float
    slope: float
    offset: float


def features(text: np.ndarray) -> np.ndarray:
    """Sorted cells of the grams of one text, given as bytes."""
    seen = np.zeros(1 << BITS, bool)
    for lo in range(0, len(text), _STEP):  # long texts in steps that overlap by two bytes
        b = LOWER[text[max(0, lo - 2) : lo + _STEP]].astype(np.uint32)
        seen[((b + np.uint32(1 << 24)) * _MULT) >> _SHIFT] = True
        two = b[:-1] << np.uint32(8) | b[1:]
        seen[((two + np.uint32(2 << 24)) * _MULT) >> _SHIFT] = True
        seen[(((two[:-1] << np.uint32(8) | b[2:]) + np.uint32(3 << 24)) * _MULT) >> _SHIFT] = True
    words = text.tobytes().split()
    share = sum(map(eq, words, islice(words, 1, None))) / max(1, len(words) - 1)
    return np.append(np.flatnonzero(seen), (1 << BITS) + np.searchsorted(_REPEATS, share)).astype(np.int32)


def fit(rows: list[tuple[int, np.ndarray]], epochs: int = 12, c: float = 0.05, alpha: float = 1.0) -> Model:
    """Model of (label, cells) rows. One class only, or no rows: a constant score."""
    labels = np.array([y for y, _ in rows], bool)
    n_pos, n_neg = int(labels.sum()), int((~labels).sum())
    if not n_pos or not n_neg:
        p = (n_pos + 1) / (len(rows) + 2)
        return Model(np.zeros(CELLS, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))
    held = np.arange(len(rows)) % 4 == 3  # for the curve
    counts = np.full((2, CELLS), alpha)
    for (y, cells), out in zip(rows, held, strict=True):
        if not out:
            counts[int(y), cells] += 1
    totals = np.array([(~labels & ~held).sum(), (labels & ~held).sum()]) + 2 * alpha
    ratio = np.log(counts[1] / totals[1]) - np.log(counts[0] / totals[0])
    used = [(1.0 if y else -1.0, cells, ratio[cells]) for (y, cells), out in zip(rows, held, strict=True) if not out]
    norms = [float(x @ x) + 1.0 for _, _, x in used]
    w, bias, dual = np.zeros(CELLS), 0.0, np.zeros(len(used))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(used)):
            y, cells, x = used[i]
            gradient = y * (float(w[cells] @ x) + bias) - 1.0
            step = min(max(dual[i] - gradient / norms[i], 0.0), c) - dual[i]
            if step:
                dual[i] += step
                w[cells] += step * y * x
                bias += step * y
    weights = (w * ratio).astype(np.float32)
    margins = np.array([weights[cells].sum(dtype=np.float64) + bias for (_, cells), out in zip(rows, held, strict=True) if out])
    slope, offset = _logistic(margins, labels[held])
    return Model(weights, bias, slope, offset)


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's curve: slope and offset by Newton steps on smoothed targets."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * m * m).sum() + 1e-6, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * m).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def held_out(id_column: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves no remainder by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on labelled documents outside the held-out fifth.

    Of repeated labels of one id the least counts, and of documents that repeat an id the one whose cells come
    first. Labels with a null id or a value other than 0 and 1, and documents without a label, teach nothing.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = (
        marks.groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_LABELLED)  # the documented bound, of ids: broadcast
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(column(batch, "text"))
            cells = [features(data[a:b]).tobytes() for a, b in zip(offs, offs[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "y"), pa.array(cells, pa.binary())], ["doc_id", "y", "cells"]
            )

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    found = texts.mapInArrow(run, "doc_id bigint, y int, cells binary").groupBy("doc_id").agg(F.min(F.struct("y", "cells")).alias("one"))
    rows = sorted(found.select("doc_id", "one.y", "one.cells").toLocalIterator(), key=lambda r: r[0])
    return fit([(r[1], np.frombuffer(bytes(r[2]), np.int32)) for r in rows])


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    data, offs = text_buffers(texts)
    margins = np.array([model.weights[features(data[a:b])].sum(dtype=np.float64) for a, b in zip(offs, offs[1:], strict=False)])
    return 1 / (1 + np.exp(-np.clip(model.slope * (margins + model.bias) + model.offset, -35, 35)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document row.

    Null and empty texts have no gram and are scored alike. A null doc_id is not held out. Equal texts have equal
    scores. A text is taken whole, in steps. An empty table gives no row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = pa.array(scores(column(batch, "text"), sent.value), pa.float64())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), s], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(column(batch, "text"), sent.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
