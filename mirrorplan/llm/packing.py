"""Packing documents into sequences by non-negative least squares on the length histogram.

A document's ids (with one end id) are cut into full windows, one main piece of a multiple of UNIT
ids, and a rest of fewer than UNIT. All ways to fill a window with at most DEPTH main pieces are
enumerated; non-negative least squares gives how often to use each so that the histogram of main
pieces is used up; the counts are rounded within what there is. Every piece has a rank in its length
class, and its sequence and offset follow from the rank alone. What rounding leaves, and the rests,
are packed greedily, longest first into the fullest sequence that holds them, in chunks of bounded size.

Only the histogram (WINDOW / UNIT numbers) comes to the driver. Ranks are sums of counts of about
sqrt(rows) chunks, so neither a chunk nor a length class has to stand in one task.
"""

from __future__ import annotations

import base64
import functools
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._state import materialise
from ._text import column

WINDOW = 2048
UNIT = 32
DEPTH = 3
END_ID = 1
#: Ids in one chunk of the greedy step, about.
GREEDY_IDS = 1 << 20
_STRIDE = 1 << 20  # sequence numbers kept for each greedy chunk


@functools.cache
def encoder(vocabulary: str):
    """Function text -> ids for a tokenizer file; a rank file of the same name is read for its speed.

    Texts that hold a special token's string go through the tokenizer itself, which knows those.
    """
    whole = Tokenizer.from_file(vocabulary)
    plain = lambda text: whole.encode(text, add_special_tokens=False).ids
    table = vocabulary.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(table):
        return plain
    with open(table, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    return lambda text: plain(text) if any(s in text for s in special) else fast(text)


def pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, start, length, ids_crc32, doc_tokens, bin); bin 0 holds the rests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                main = len(ids) // UNIT * UNIT
                cuts = [*range(0, main, WINDOW), main, len(ids)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a < b:
                        rows.append((doc, a, b - a, zlib.crc32(ids[a:b]), len(ids), (b - a) // UNIT if a < main else 0))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin"]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bin bigint"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def combinations(total: int, depth: int) -> list[tuple[int, ...]]:
    """All falling tuples of at most `depth` positive numbers with this sum."""
    found: list[tuple[int, ...]] = []

    def extend(left: int, top: int, parts: tuple[int, ...]) -> None:
        if left == 0:
            found.append(parts)
        elif len(parts) < depth:
            for p in range(min(left, top), (left - 1) // (depth - len(parts)), -1):
                extend(left - p, p, (*parts, p))

    extend(total, total, ())
    return found


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 of least ||a x - b||, by the active-set method."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, np.abs(b).sum())
    for _ in range(10 * a.shape[1]):
        gain = np.where(active, -np.inf, a.T @ (b - a @ x))
        if gain.max() <= tolerance:
            break
        active[gain.argmax()] = True
        while True:
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (s <= 0)
            if not low.any():
                break
            x += np.min(x[low] / np.maximum(x[low] - s[low], 1e-300)) * (s - x)
            active &= x > 1e-12
            x[~active] = 0
        x = s
    return x


def plan(histogram: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Combinations with their repeat counts, and what they leave of the histogram (index 0: length 1)."""
    ways = combinations(len(histogram), DEPTH)
    a = np.zeros((len(histogram), len(ways)))
    for j, parts in enumerate(ways):
        for p in parts:
            a[p - 1, j] += 1
    x = nnls(a, histogram.astype(float))
    left, chosen = histogram.astype(np.int64).copy(), []
    for j in sorted(np.flatnonzero(x > 0.3), key=lambda j: -x[j]):
        need = a[:, j].astype(np.int64)
        times = int(min([math.ceil(x[j] - 1e-9), *(left[need > 0] // need[need > 0])]))
        if times > 0:
            left -= times * need
            chosen.append((ways[j], times))
    return chosen, left


def greedy(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the pieces, and the sequence and offset of each in that order: best fit, longest first."""
    order = np.argsort(-lengths, kind="stable")
    rooms: list[list[int]] = [[] for _ in range(window + 1)]
    some = np.zeros(window + 1, bool)
    seq, off, used = np.empty(len(order), np.int64), np.empty(len(order), np.int64), 0
    for k, n in enumerate(lengths[order].tolist()):
        room = n + int(some[n:].argmax())
        if some[room]:
            s = rooms[room].pop()
            some[room] = bool(rooms[room])
        else:
            s, room, used = used, window, used + 1
        seq[k], off[k] = s, window - room
        rooms[room - n].append(s)
        some[room - n] = True
    return order, seq, off


def pack(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has the end id alone. Each row of docs is packed, also those that repeat a
    doc_id or have none. An empty table gives no row. sequence_id is unique, not gapless.
    """
    all_pieces = materialise(pieces(docs, vocabulary), "pieces")
    per_bin = {r["bin"]: (r["n"], r["ids"]) for r in all_pieces.groupBy("bin").agg(F.count("*").alias("n"), F.sum("length").alias("ids")).collect()}
    n_rows = sum(n for n, _ in per_bin.values())
    histogram = np.array([per_bin.get(b, (0, 0))[0] for b in range(1, WINDOW // UNIT + 1)], np.int64)
    chosen, left = plan(histogram)

    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    dealt = all_pieces.withColumn("part", F.expr(f"pmod(xxhash64({', '.join(key)}), {math.isqrt(n_rows) + 1})"))
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("bin", "part").agg(F.count("*").alias("n")).select("bin", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("bin", "part").orderBy(*key))
    ranked = dealt.withColumn("at", within).join(bases, ["bin", "part"]).select(*key, "bin", (F.col("base") + F.col("at") - 1).alias("rank"))

    ranges, taken, first = [], dict.fromkeys(range(WINDOW // UNIT + 1), 0), 0
    for parts, times in chosen:
        offsets = np.concatenate([[0], np.cumsum(parts)])[:-1] * UNIT
        for p in sorted(set(parts)):
            slots = [int(o) for o, q in zip(offsets, parts, strict=True) if q == p]
            ranges.append((p, taken[p], taken[p] + times * len(slots), first, times, slots))
            taken[p] += times * len(slots)
        first += times
    table = docs.sparkSession.createDataFrame(ranges, "bin bigint, low bigint, high bigint, first bigint, times bigint, slots array<bigint>")
    fits = (ranked["bin"] == table["bin"]) & (ranked["rank"] >= table["low"]) & (ranked["rank"] < table["high"])
    # the table has a row for each length of each chosen combination: DEPTH * WINDOW / UNIT at most
    placed = ranked.join(F.broadcast(table), fits, "left").drop(table["bin"])
    turn = F.col("rank") - F.col("low")
    by_plan = placed.where("low is not null").select(
        *key, (F.col("first") + turn % F.col("times")).alias("sequence_id"), F.expr("get(slots, cast((rank - low) div times as int))").alias("offset")
    )

    ids = int((left * np.arange(1, len(left) + 1)).sum()) * UNIT + (per_bin.get(0, (0, 0))[1] or 0)
    chunk = F.expr(f"pmod(rank, {max(1, ids // GREEDY_IDS)})")

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([(k, "ascending") for k in key])
        order, seq, off = greedy(group["length"].to_numpy())
        start = first + group["chunk"][0].as_py() * _STRIDE
        return group.take(pa.array(order)).select(key).append_column("sequence_id", pa.array(seq + start)).append_column("offset", pa.array(off))

    schema = ", ".join(f"{c} bigint" for c in (*key, "sequence_id", "offset"))
    rest = placed.where("low is null").select(*key, chunk.alias("chunk")).groupBy("chunk").applyInArrow(fill, schema)
    return by_plan.union(rest)
