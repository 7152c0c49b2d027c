"""Benchmark decontamination: a broadcast hash set of test n-grams against every training window.

Words are runs of characters other than ASCII non-alphanumerics, A-Z lower-cased. The windows of
all benchmark items (n words; a shorter item is one window) go to the executors as a sorted hash
table of at most BLOCK_BYTES of item text; a larger benchmark is taken in several such blocks, one
after another, and a long item in parts that share n - 1 words, so no broadcast grows with it (n words alone
may pass the bound, where words are that long). Every window of every document is looked up, and each
hit is verified byte for byte against the item's words.

Null or wordless texts hit nothing; items with a null id or no word take no part; rows that repeat
an item_id count as one item; every document row is judged alone, so repeated rows do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._state import materialise
from ._text import LOWER, byte_table, chunks, column, gram_hashes, hash_words, split_words, text_buffers

#: Benchmark text in one broadcast block.
BLOCK_BYTES = 8 << 20
_WORD = byte_table("alnum")


class TestWindows(NamedTuple):
    """Windows of one block of items. Per length: sorted hashes, and where their occurrences begin."""

    ids: list[str]
    words: bytes  # the items' words, each followed by a space
    begin: np.ndarray  # byte of each word in `words`
    item: np.ndarray  # item of each word
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # hashes, bounds, first words
    filters: dict[int, np.ndarray]  # a bit table that rules most windows out


def build_windows(items: list[tuple[str, bytes]], n: int) -> TestWindows:
    data = LOWER[np.frombuffer(b"".join(t for _, t in items), np.uint8)]
    offs = np.concatenate([[0], np.cumsum([len(t) for _, t in items])]).astype(np.int64)
    starts, ends, row = split_words(data, offs, _WORD)
    hashes = hash_words(data, starts, ends)
    raw = data.tobytes()
    joined = b"".join(raw[a:b] + b" " for a, b in zip(starts, ends, strict=True))
    begin = np.concatenate([[0], np.cumsum(ends - starts + 1)]).astype(np.int64)
    n_words = np.bincount(row, minlength=len(items))
    by_length, filters = {}, {}
    for size in sorted({min(int(k), n) for k in n_words if k}):
        h = gram_hashes(hashes, size)
        at = np.arange(len(h))
        whole = row[at] == row[at + size - 1]
        at = at[whole & ((n_words[row[at]] == size) | (size == n))]
        at = at[np.argsort(h[at], kind="stable")]
        keys, bounds = np.unique(h[at], return_index=True)
        by_length[size] = keys, np.append(bounds, len(at)), at
        bits = np.zeros(1 << max(16, min(27, math.ceil(math.log2(len(keys) + 1)) + 4)), bool)
        bits[keys & np.uint64(len(bits) - 1)] = True
        filters[size] = bits
    return TestWindows([i for i, _ in items], joined, begin, row, by_length, filters)


def find_hits(data: np.ndarray, offs: np.ndarray, tests: TestWindows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set[str]]]:
    """Starts, ends, rows of the words; which words are covered; the items found in each row."""
    data = LOWER[data]
    starts, ends, row = split_words(data, offs, _WORD)
    hashes = hash_words(data, starts, ends)
    edge = np.zeros(len(starts) + 1, np.int32)
    found: dict[int, set[str]] = {}
    known: dict[tuple[int, bytes], list[str]] = {}
    for size, (keys, bounds, at) in tests.by_length.items():
        h = gram_hashes(hashes, size)
        bits = tests.filters[size]
        maybe = np.flatnonzero(bits[h & np.uint64(len(bits) - 1)])
        maybe = maybe[row[maybe] == row[maybe + size - 1]]
        k = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
        hit = keys[k] == h[maybe]
        for i, key in zip(maybe[hit].tolist(), k[hit].tolist(), strict=True):
            span = b"".join(data[starts[j] : ends[j]].tobytes() + b" " for j in range(i, i + size))
            if (ids := known.get((key, span))) is None:
                firsts = at[bounds[key] : bounds[key + 1]]
                ids = [
                    tests.ids[tests.item[w]] for w in firsts.tolist() if tests.words[tests.begin[w] : tests.begin[w + size]] == span
                ]
                known[key, span] = ids
            if ids:
                edge[i] += 1
                edge[i + size] -= 1
                found.setdefault(int(row[i]), set()).update(ids)
    return starts, ends, row, np.cumsum(edge[:-1]) > 0, found


def _runs(covered: np.ndarray) -> np.ndarray:
    """Flattened [begin, end) runs of true values."""
    padded = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(padded == 1), np.flatnonzero(padded == -1)], 1).ravel()


def _scan_block(docs: DataFrame, tests, hits: str, items: str, words: str) -> DataFrame:
    """docs with the block's covered word runs and items added to what former blocks found."""
    had = hits in docs.columns
    added = T.StructType.fromDDL(f"`{hits}` array<bigint>, `{items}` array<string>, `{words}` bigint")
    schema = docs.schema if had else T.StructType(docs.schema.fields + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(column(batch, "text"))
            n_rows, runs, ids, counts = batch.num_rows, [], [], []
            old_runs = column(batch, hits).to_pylist() if had else [[]] * n_rows
            old_ids = column(batch, items).to_pylist() if had else [[]] * n_rows
            for a, b in chunks(offs):
                starts, _, row, covered, found = find_hits(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], tests.value)
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                for r in range(b - a):
                    lo, hi = bounds[r], bounds[r + 1]
                    mine = covered[lo:hi].copy()
                    for x, y in zip(old_runs[a + r][::2], old_runs[a + r][1::2], strict=True):
                        mine[x:y] = True
                    runs.append(_runs(mine) if r in found or old_runs[a + r] else ())
                    ids.append(sorted(found.get(r, set()).union(old_ids[a + r])))
                    counts.append(int(hi - lo))
            cols = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name not in (hits, items, words)]
            names = [f.name for f in batch.schema if f.name not in (hits, items, words)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(runs, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string())), pa.array(counts, pa.int64())],
                [*names, hits, items, words],
            )

    return docs.mapInArrow(run, schema)


def _parts(items: DataFrame, n: int) -> DataFrame:
    """(item_id, text) with long texts cut into parts that overlap by n - 1 words: the same windows."""
    size = BLOCK_BYTES // 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = column(batch, "item_id"), column(batch, "text").cast(pa.large_binary())
            for k in range(batch.num_rows):
                text = np.frombuffer(texts[k].as_py(), np.uint8)
                starts, ends, _ = split_words(LOWER[text], np.array([0, len(text)]), _WORD)
                cuts, a = [], 0
                while a < len(starts):
                    b = min(len(starts), max(a + n, int(np.searchsorted(ends, starts[a] + size, "right"))))
                    cuts.append(text[starts[a] : ends[b - 1]].tobytes().decode())
                    a = b - n + 1 if b < len(starts) else b
                yield pa.RecordBatch.from_arrays([pa.array([ids[k].as_py()] * len(cuts), pa.string()), pa.array(cuts, pa.string())], ["item_id", "text"])

    long = items.where(F.octet_length("text") > size).mapInArrow(run, "item_id string, text string")
    return items.where(F.octet_length("text") <= size).union(long).distinct()


def _blocks(benchmark: DataFrame, n: int) -> Iterator:
    """The benchmark's windows as broadcasts of bounded size, one at a time; whether more follow."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    items = materialise(_parts(items.distinct(), n), "items")
    block = lambda blocks: F.expr(f"pmod(xxhash64(item_id, text), {blocks})")
    blocks = 0
    while True:  # until no block is larger than the bound, or than one part
        blocks = max(1, 2 * blocks)
        of_block = items.groupBy(block(blocks).alias("b")).agg(F.sum(F.octet_length("text")).alias("n"), F.max(F.octet_length("text")).alias("one"))
        row = of_block.agg(F.max("n").alias("n"), F.max("one").alias("one"), F.sum("n").alias("all")).first()
        if (row["n"] or 0) <= max(BLOCK_BYTES, row["one"] or 0):
            break
        blocks = max(blocks, row["all"] // (2 * BLOCK_BYTES))
    for b in range(blocks):
        tests = build_windows([(r[0], r[1].encode()) for r in items.where(block(blocks) == b).collect()], n)
        yield benchmark.sparkSession.sparkContext.broadcast(tests), blocks > 1


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, names: tuple[str, str, str] = ("hits", "item_ids", "n_words")) -> DataFrame:
    """docs with three more columns: covered word runs [begin, end, ...], sorted item ids, word count."""
    for tests, more in _blocks(benchmark, n):
        docs = _scan_block(docs, tests, *names)
        if more:
            docs = materialise(docs, "decontaminate")
            tests.unpersist()
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per document row."""
    seen = scan(docs.select("doc_id", "text"), benchmark, n)
    n_hit = F.expr("aggregate(sequence(1, greatest(size(hits), 2), 2), 0L, (s, i) -> s + coalesce(get(hits, i) - get(hits, i - 1), 0L))")
    return seen.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _cut_block(docs: DataFrame, tests) -> DataFrame:
    """docs with every covered run cut, again until the text holds no window; texts left wordless go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index("text")
            data, offs = text_buffers(batch.column(where))
            new: dict[int, str | None] = {}
            for a, b in chunks(offs):
                part, at = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                starts, ends, row, covered, found = find_hits(part, at, tests.value)
                for r in found:
                    text, lo, hi = part[at[r] : at[r + 1]], *np.searchsorted(row, [r, r + 1])
                    s, e, c = starts[lo:hi] - at[r], ends[lo:hi] - at[r], covered[lo:hi]
                    while c.any():
                        runs = _runs(c)
                        keep = np.ones(len(text), bool)
                        for x, y in zip(runs[::2], runs[1::2], strict=True):
                            keep[s[x] : e[y - 1]] = False
                        text = text[keep]
                        s, e, _, c, _ = find_hits(text, np.array([0, len(text)]), tests.value)
                    new[a + r] = text.tobytes().decode() if len(s) else None
            if new:
                texts = batch.column(where).to_pylist()
                for r, t in new.items():
                    texts[r] = t
                cols = list(batch.columns)
                cols[where] = pa.array(texts, batch.schema.field(where).type)
                batch = pa.RecordBatch.from_arrays(cols, batch.schema.names)
                stay = np.ones(batch.num_rows, bool)
                stay[[r for r, t in new.items() if t is None]] = False
                batch = batch.filter(pa.array(stay))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def _cut_runs(seen: DataFrame, schema: T.StructType, hits: str) -> DataFrame:
    """The rows of scan() with all their covered runs cut at once; texts left wordless go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = column(batch, "text").to_pylist(), column(batch, hits).to_pylist()
            stay = np.ones(batch.num_rows, bool)
            for r, found in enumerate(runs):
                if found:
                    text = np.frombuffer(texts[r].encode(), np.uint8)
                    starts, ends, _ = split_words(LOWER[text], np.array([0, len(text)]), _WORD)
                    keep = np.ones(len(text), bool)
                    for x, y in zip(found[::2], found[1::2], strict=True):
                        keep[starts[x] : ends[y - 1]] = False
                    texts[r] = text[keep].tobytes().decode()
                    stay[r] = bool(_WORD[LOWER[text[keep]]].any())
            columns = [pa.array(texts, f.type) if f.name == "text" else column(batch, f.name) for f in batch.schema if f.name in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(stay))

    return seen.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "spans") -> DataFrame:
    """docs without contamination; all columns stay.

    remove='documents' drops every document with a hit. remove='spans' cuts each covered run of words
    from the text, with what stands between them, again until the text holds no window; a document
    that had words and keeps none is dropped. Documents without a hit stay as they are. A benchmark of
    several blocks gives the same result: what all blocks cover is gathered before anything is cut.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    names = tuple(_free(docs, x) for x in ("_hits", "_items", "_words"))
    if remove == "documents":
        return scan(docs, benchmark, n, names).where(F.size(names[0]) == 0).drop(*names)
    for tests, several in _blocks(benchmark, n):
        if not several:
            return _cut_block(docs, tests)
        break
    while True:
        seen = scan(docs, benchmark, n, names)
        if seen.where(F.size(names[0]) > 0).isEmpty():
            return docs
        docs = materialise(_cut_runs(seen, docs.schema, names[0]), "decontaminate")


def _free(docs: DataFrame, name: str) -> str:
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name
