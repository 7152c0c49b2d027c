"""Substring dedup: exact repeats of WINDOW words or more, by seed and extend.

Words are runs of characters other than x20 and x09-x0D. A word goes if some window of WINDOW
consecutive words that covers it also starts earlier: in a document with a smaller doc_id, or earlier
in the same one. Windows are judged on the input.

Seeds are winnowed anchors: of the SEED-word grams of each window the one with the least hash. Equal
windows have equal anchors. Extending an anchor both ways over all the windows that chose it gives its
*reach*, which is what repeats when a long passage does. So the work goes from long to short:
(1) anchors that occur once are dropped; (2) of each reach the document with the smallest doc_id is
its first, and in all others the whole reach is a repeat; (3) where an anchor has several reaches, the
first document of each gives the single windows of the reach, and of each window the document with
the smallest doc_id is first again. Runs of repeated windows are the maximal repeats. All groups are
reduced to minima and joined back; no pair of documents is ever formed, so a passage that a third of
all documents share costs one row for each.

Texts are compared by hashes. A word has the 128 bits of XXH3, as two lanes of 64; runs of words are
hashed by a tree of pairs, each pair scrambled by a bijection, so that no lane is a sum over places.
Reaches and windows meet across documents by both lanes; within one document a listed reach or window
is found again by one lane. Anchors only group, and have one lane: a false meeting there costs work, not rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._state import discard, materialise
from ._text import CHUNK_BYTES, byte_table, chunks, column, mix, split_pieces, split_words, text_buffers

WINDOW = 20
SEED = 5
_SPACE = byte_table("space")
_PLACE_BITS = np.uint64(22)  # of a word in a piece: pieces hold two bytes a word and CHUNK_BYTES of text
_FIRST = -(1 << 63)  # a null doc_id stands before all others
_LANES = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25))


class Piece(NamedTuple):
    """Some consecutive words: the row of each and its two hashes."""

    row: np.ndarray
    lanes: tuple[np.ndarray, np.ndarray]


def _piece(words: Iterable[bytes], row: np.ndarray) -> Piece:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    return Piece(row, (both[:, 0].copy(), both[:, 1].copy()))


def _pieces(data: np.ndarray, offs: np.ndarray, i: int, j: int) -> Iterator[Piece]:
    """Rows i..j, which chunks() gave: one piece, or several of one long row, whose windows each lie in one piece."""
    if offs[j] - offs[i] <= CHUNK_BYTES:
        words = [data[offs[r] : offs[r + 1]].tobytes().split() for r in range(i, j)]
        yield _piece(chain.from_iterable(words), np.repeat(np.arange(i, j), [len(w) for w in words]))
        return
    left = (np.zeros(0, np.uint64),) * 2
    for words in split_pieces(data[offs[i] : offs[j]].tobytes(), CHUNK_BYTES):
        new = _piece(words, np.zeros(0, np.int64)).lanes
        lanes = tuple(np.concatenate(both) for both in zip(left, new, strict=True))
        yield Piece(np.full(len(lanes[0]), i), lanes)
        left = tuple(lane[max(0, len(lane) - WINDOW + 1) :] for lane in lanes)


def _pair(x: np.ndarray, y: np.ndarray, lane: int) -> np.ndarray:
    return mix(x * _LANES[lane] + y)


def _runs(words: np.ndarray, n: int, lane: int) -> np.ndarray:
    """Hash of every run of n words, from those of runs of 1, 2, 4, ... words."""
    size, level, done, out = 1, words, 0, None
    while True:
        if n & size:
            m = len(words) - done - size + 1
            out = level if out is None else _pair(out[:m], level[done : done + m], lane)
            done += size
        if done == n:
            return out
        level = _pair(level[:-size], level[size:], lane)
        size *= 2


class Reaches(NamedTuple):
    """Runs of windows with one anchor, and all windows."""

    anchor: np.ndarray
    one: np.ndarray  # the reach in each lane
    two: np.ndarray
    first: np.ndarray  # window of the piece
    last: np.ndarray
    windows: tuple[np.ndarray, np.ndarray]


def _reaches(p: Piece, with_second: bool = True) -> Reaches:
    n = len(p.row) - WINDOW + 1
    if n <= 0:
        none, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return Reaches(none, none, none, at, at, (none, none))
    grams = _runs(p.lanes[0], SEED, 0)
    least = grams >> _PLACE_BITS << _PLACE_BITS | np.arange(len(grams), dtype=np.uint64)
    size, want = 1, WINDOW - SEED + 1
    while size < want:  # minima over runs of doubling length; the leftmost of equals
        step = min(size, want - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    chosen = (least[:n] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    whole = np.flatnonzero(p.row[:n] == p.row[WINDOW - 1 :])
    picked = chosen[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (whole[1:] != whole[:-1] + 1)
    first = whole[new]
    last = whole[np.append(np.flatnonzero(new)[1:] - 1, len(whole) - 1)] if len(whole) else whole
    windows = tuple(_runs(p.lanes[k], WINDOW, k) if k == 0 or with_second else np.zeros(0, np.uint64) for k in (0, 1))
    # a reach is its first and its last window, which overlap or touch, and their distance
    spans = [_pair(_pair(w[first], w[last], k), (last - first).astype(np.uint64), k) if len(w) else w for k, w in enumerate(windows)]
    return Reaches(grams[picked[new]], *spans, first, last, windows)


def _tagged(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    return values ^ mix(row.astype(np.uint64) + np.uint64(1))


def _listed(col: pa.Array, i: int, j: int) -> np.ndarray:
    """Hashes in the lists of rows i..j, each tagged with its row."""
    part = col.slice(i, j - i)
    sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return _tagged(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.repeat(np.arange(i, j), sizes))


def _each(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All windows of the runs."""
    size = last - first + 1
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(first) else first


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _seeds(texts: DataFrame, columns: str) -> DataFrame:
    """(did, text) -> the named of anchor, r1, r2, did for every reach."""
    names = columns.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (data, offs), ids = text_buffers(column(batch, "text")), column(batch, "did").to_numpy(zero_copy_only=False)
            for i, j in chunks(offs):
                for p in _pieces(data, offs, i, j):
                    found = _reaches(p, "r2" in names)
                    of = {"anchor": found.anchor, "r1": found.one, "r2": found.two, "did": ids[p.row[found.first]]}
                    yield pa.RecordBatch.from_arrays([_signed(of[n]) for n in names], names)

    return texts.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _windows(texts: DataFrame) -> DataFrame:
    """(did, text, open) -> the single windows (w1, w2, did) of the reaches listed in open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (data, offs), ids = text_buffers(column(batch, "text")), column(batch, "did").to_numpy(zero_copy_only=False)
            for i, j in chunks(offs):
                wanted = _listed(column(batch, "open"), i, j)
                for p in _pieces(data, offs, i, j):
                    found = _reaches(p)
                    chosen = np.isin(_tagged(found.one, p.row[found.first]), wanted)
                    at = _each(found.first[chosen], found.last[chosen])
                    one, two = (w[at] for w in found.windows)
                    yield pa.RecordBatch.from_arrays([_signed(one), _signed(two), pa.array(ids[p.row[at]])], ["w1", "w2", "did"])

    return texts.mapInArrow(run, "w1 bigint, w2 bigint, did bigint")


def _not_first(rows: DataFrame, *key: str) -> DataFrame:
    """rows with the smallest did of their key, for keys that several rows have."""
    firsts = rows.groupBy(*key).agg(F.min("did").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(firsts, [*key])


def _repeats(docs: DataFrame) -> DataFrame:
    """(did, reaches, windows): hashes of what is to go from each document, besides its own repeats."""
    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_FIRST)).alias("did"), "text")
    # each step is written, so that both sides of every join come straight from a shuffle on that join's
    # own keys, and Spark can split a very common anchor
    anchors = _seeds(texts, "anchor")
    again = materialise(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    shared = materialise(_seeds(texts, "anchor r1 r2 did").join(again, "anchor", "left_semi"), "shared")
    discard(again)
    reaches = materialise(shared.groupBy("anchor", "r1", "r2").agg(F.min("did").alias("leader")), "reaches")
    several = reaches.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor", F.lit(True).alias("several"))
    several = materialise(several, "several")
    kinds = materialise(reaches.join(several, "anchor", "left"), "kinds")
    judged = shared.join(kinds, ["anchor", "r1", "r2"]).where("did > leader or several")
    per_doc = judged.groupBy("did").agg(
        F.collect_set(F.when(F.col("did") > F.col("leader"), F.col("r1"))).alias("reaches"),
        F.collect_set(F.when(F.col("did") == F.col("leader"), F.col("r1"))).alias("open"),
    )
    per_doc = materialise(per_doc, "judged")
    for done in (shared, reaches, several, kinds):
        discard(done)
    opened = texts.join(per_doc.where("size(open) > 0").select("did", "open"), "did")
    windows = materialise(_windows(opened).distinct(), "windows")
    late = _not_first(windows, "w1", "w2").where("did > leader").groupBy("did").agg(F.collect_set("w1").alias("windows"))
    return per_doc.where("size(reaches) > 0").select("did", "reaches").join(late, "did", "full_outer")


def _joined(docs: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    did, reaches, windows = names
    found = _repeats(docs.select("doc_id", "text")).withColumnsRenamed({"did": did, "reaches": reaches, "windows": windows})
    return docs.withColumn(did, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_FIRST))).join(found, did, "left").drop(did)


def _gone_windows(pieces: Iterator[Piece], reaches: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of every window, and whether it goes; reaches and windows are tagged with their rows."""
    rows, tags, hits = [], [], []
    for p in pieces:
        found = _reaches(p, False)
        at = _each(found.first, found.last)
        own = _tagged(found.windows[0][at], p.row[at])
        whole = np.isin(_tagged(found.one, p.row[found.first]), reaches)
        rows.append(p.row[at])
        tags.append(own)
        hits.append(np.isin(own, windows) | np.repeat(whole, found.last - found.first + 1))
    row, own, gone = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, tags, hits))
    order = np.argsort(own, kind="stable")  # the same window again in one document
    gone[order[1:]] |= own[order[1:]] == own[order[:-1]]
    return row, gone


def _each_text(batch: pa.RecordBatch, reaches: str, windows: str) -> Iterator[tuple[int, bytes, np.ndarray | None]]:
    """Row, text, and which of its words go (None for none) of every row."""
    data, offs = text_buffers(column(batch, "text"))
    for i, j in chunks(offs):
        row, gone = _gone_windows(_pieces(data, offs, i, j), _listed(column(batch, reaches), i, j), _listed(column(batch, windows), i, j))
        bounds = np.searchsorted(row, np.arange(i, j + 1))
        for r, lo, hi in zip(range(i, j), bounds[:-1], bounds[1:], strict=True):
            at = np.flatnonzero(gone[lo:hi])
            if len(at):
                edge = np.zeros(hi - lo + WINDOW, np.int32)
                edge[at] += 1
                edge[at + WINDOW] -= 1
            yield r, data[offs[r] : offs[r + 1]].tobytes(), np.cumsum(edge[:-1]) > 0 if len(at) else None


def _kept(text: bytes, gone: np.ndarray | None) -> tuple[int, int, str]:
    """Number of words, of those that go, and the digest of the others."""
    digest, n, first = hashlib.sha256(), 0, True
    for words in split_pieces(text):
        kept = words if gone is None else list(compress(words, ~gone[n : n + len(words)]))
        n += len(words)
        if kept:
            digest.update((b"" if first else b" ") + b" ".join(kept))
            first = False
    return n, 0 if gone is None else int(gone.sum()), digest.hexdigest()


def substring_report(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256), one row per row of docs.

    A null text has no words. A null doc_id stands before all others. Of rows that repeat a doc_id none
    is earlier than another; each is judged against smaller ids and itself. A text of any length is taken
    in pieces. An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(_kept(text, gone) for _, text, gone in _each_text(batch, "reaches", "windows")), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    rows = _joined(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ("did", "reaches", "windows"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut from text, what stands between other words left alone; all columns stay.

    Null texts, null and repeated ids are taken as in substring_report.
    """
    names, columns = ("_sub_did", "_sub_reaches", "_sub_windows"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            for r, text, gone in _each_text(batch, *names[1:]):
                if gone is not None:
                    raw = np.frombuffer(text, np.uint8)
                    starts, ends, _ = split_words(raw, np.array([0, len(raw)]), _SPACE)
                    runs = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                    keep = np.ones(len(text), bool)
                    for x, y in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1), strict=True):
                        keep[starts[x] : ends[y - 1]] = False
                    texts[r] = raw[keep].tobytes().decode()
            cols = [pa.array(texts, f.type) if f.name == "text" else c for c, f in zip(batch.columns, batch.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names).select(columns)

    return _joined(docs, names).mapInArrow(run, docs.schema)
