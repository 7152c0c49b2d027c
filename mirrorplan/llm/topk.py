"""Exact top-k inner-product search by the three-phase uniform threshold method.

Components are cut into SLICES parts, each with its own list of partial scores. (1) From every block of
candidates come the HEADS best of the first list, with their exact sums; the k-th best sum of a query is
a safe cutoff, since k entries reach it. (2) The cutoff goes to all blocks. An entry that reaches it must
reach its even share in some slice, and what the last slice can add is bounded by the norms of its two
ends; so all slices but the last are multiplied, and entries that fail either test are out. (3) The last
slice is multiplied for the survivors, and the k best per block and query meet in one window.

Vectors are quantised once and written. Queries and candidates are dealt to blocks of bounded size; each
block of queries meets each block of candidates over an equi-join on the block's number, so no side is
broadcast and no group grows. A block of candidates is 16 times as large as one of queries, which keeps
the copies of queries few beside the products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._state import materialise

#: Components in a block: 1024 queries or 16384 candidates of 64 components.
QUERY_COMPONENTS, CANDIDATE_COMPONENTS = 1 << 16, 1 << 20
SLICES = 4
HEADS = 32
_TILE = 2048  # candidates that meet a block of queries at once
_LOW = np.iinfo(np.int64).min


def quantise(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, v): floor(256 * x) of each component.

    Rows with a null id, a null vector, or a null or non-finite component take no part; of rows that
    repeat a vec_id the least vector counts.
    """
    fine = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and abs(double(x)) < double('infinity'))"
    return (
        embeddings.where(fine)
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), F.expr("transform(embedding, x -> floor(256 * double(x)))").alias("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )


def _blocks(rows: DataFrame, block: str, n: int) -> DataFrame:
    """One row per block of about so many vectors."""
    fields = [c for c in rows.columns]
    return (
        rows.withColumn(block, F.expr(f"pmod(xxhash64(vec_id), {n})"))
        .groupBy(block)
        .agg(F.collect_list(F.struct(*fields)).alias(block + "_rows"))
    )


def _matrix(rows: pa.StructArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Ids, int64 vectors (missing trailing components are 0), and cutoffs if there are any."""
    ids = rows.field("vec_id").to_numpy(zero_copy_only=False)
    v = rows.field("v")
    sizes = v.value_lengths().to_numpy(zero_copy_only=False)
    m = np.zeros((len(ids), width), np.int64)
    m[np.arange(width)[None, :] < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    cut = None
    if rows.type.get_field_index("cutoff") >= 0:
        cut = rows.field("cutoff").fill_null(_LOW).to_numpy(zero_copy_only=False)
    return ids, m, cut


def _kind(q: np.ndarray, c: np.ndarray) -> type:
    """The smallest type in which all sums of products are exact."""
    top = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(c).max(initial=0))) * max(1, q.shape[1])
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64


def _slices(width: int) -> list[slice]:
    edges = np.linspace(0, width, SLICES + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def heads(q: np.ndarray, c: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: rows, columns and exact sums of the best HEADS of each query in the first slice; `own` pairs are none."""
    first = _slices(q.shape[1])[0]
    part = np.where(own, -np.inf, (q[:, first] @ c[:, first].T).astype(np.float64))
    size = min(HEADS, len(c))
    cols = np.argpartition(part, len(c) - size, axis=1)[:, len(c) - size :]
    rows = np.repeat(np.arange(len(q)), size)
    cols = cols.ravel()
    good = ~own[rows, cols]
    rows, cols = rows[good], cols[good]
    return rows, cols, np.einsum("ij,ij->i", q[rows], c[cols]).astype(np.int64)


def survivors(q: np.ndarray, c: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2: sums of all slices but the last, and which entries can still reach the cutoff of their query."""
    *most, last = _slices(q.shape[1])
    share = np.floor_divide(cut, SLICES)[:, None]
    total, reached = np.zeros((len(q), len(c)), q.dtype), np.zeros((len(q), len(c)), bool)
    for s in most:
        part = q[:, s] @ c[:, s].T
        total += part
        reached |= part >= share
    norms = [np.sqrt((x[:, last].astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12) for x in (q, c)]
    best = np.floor(norms[0][:, None] * norms[1][None, :]) + 1  # the last slice adds no more
    slack = (np.abs(total.astype(np.float64)) + best) * 2.0**-50  # of sums beyond 53 bits
    return total, (total + best + slack >= cut[:, None]) & (reached | (best + slack >= share))


def resolve(q: np.ndarray, c: np.ndarray, total: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 3: rows, columns and exact sums of the survivors."""
    last = _slices(q.shape[1])[-1]
    rows, cols = np.nonzero(alive)
    if 20 * len(rows) > alive.size:  # so many that one product of whole matrices is faster than picking rows
        added = (q[:, last] @ c[:, last].T)[rows, cols]
    else:
        added = np.einsum("ij,ij->i", q[rows, last], c[cols, last])
    return rows, cols, total[rows, cols].astype(np.int64) + added.astype(np.int64)


def _best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each row, the smaller id first among equals."""
    order = np.lexsort((ids, -score, row))
    starts = np.flatnonzero(np.diff(row[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[rank < k]


def _pair(q_rows: pa.StructArray, c_rows: pa.StructArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and exact scores; at most k entries per query. Without cutoffs it is phase 1."""
    width = max([1, *(int(r.field("v").value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for r in (q_rows, c_rows))])
    q_ids, q, cut = _matrix(q_rows, width)
    c_ids, c, _ = _matrix(c_rows, width)
    kind = _kind(q, c)
    q, c, found = q.astype(kind), c.astype(kind), []
    for a in range(0, len(c_ids), _TILE):
        tile, ids = c[a : a + _TILE], c_ids[a : a + _TILE]
        own = q_ids[:, None] == ids[None, :]
        if cut is None:
            rows, cols, score = heads(q, tile, own)
        else:
            total, alive = survivors(q, tile, cut)
            rows, cols, score = resolve(q, tile, total, alive & ~own)
            good = score >= cut[rows]
            rows, cols, score = rows[good], cols[good], score[good]
        found.append((rows, ids[cols], score))
    rows, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
    best = _best(rows, ids, score, k)
    return q_ids[rows[best]], ids[best], score[best]


def _meet(queries: DataFrame, n_q: int, blocks: DataFrame, n_c: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qs, cs = (batch.column(batch.schema.get_field_index(x)) for x in ("q_rows", "c_rows"))
            for i in range(batch.num_rows):
                found = _pair(*(pa.array(x.slice(i, 1).flatten()) for x in (qs, cs)), k)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["query_id", "vec_id", "score"])

    q = _blocks(queries, "q", n_q).withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_c - 1).cast("bigint"))))
    # Spark sizes q as if it were not exploded, and would broadcast as many copies of the queries as there are blocks
    return q.join(blocks.hint("merge"), "c").select("q_rows", "c_rows").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def search(embeddings: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): the k best other rows of each query.

    Ties go to the smaller vec_id; a query with fewer than k candidates gets all of them. Vectors of
    unlike lengths are compared as if the shorter ended in zeros. Rows with a null id, a null vector or a
    null or non-finite component take no part; of rows that repeat a vec_id the least vector counts. An
    empty table gives no row.
    """
    vectors = materialise(quantise(embeddings), "vectors")
    queries = vectors.where(is_query)
    size = lambda rows: F.sum(F.when(rows, F.greatest(F.size("v"), F.lit(1))))
    counts = vectors.agg(size(F.lit(True)).alias("n"), size(F.expr(is_query)).alias("q")).first()
    n_q, n_c = (max(1, math.ceil((counts[x] or 0) / y)) for x, y in (("q", QUERY_COMPONENTS), ("n", CANDIDATE_COMPONENTS)))
    blocks = _blocks(vectors, "c", n_c)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    lists = _meet(queries, n_q, blocks, n_c, k)
    cutoffs = lists.withColumn("rank", place).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))
    bounded = queries.join(cutoffs, "vec_id", "left").select("vec_id", "v", "cutoff")
    found = _meet(bounded, n_q, blocks, n_c, k)
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
