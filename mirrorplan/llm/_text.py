"""Vectorised word work on Arrow batches, shared by the text operators.

Everything here runs inside Spark tasks on one Arrow batch at a time. Texts are UTF-8
bytes laid end to end; words are runs of bytes for which a 256-entry table is true.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step takes, but for a single longer text.
CHUNK_BYTES = 2 << 20
_BLOCK = 1 << 18

_B = np.uint64(0x9E3779B97F4A7C55)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))


def byte_table(pattern: str) -> np.ndarray:
    """True for the bytes of one word.

    'space': all but x20 and x09-x0D. 'alnum': 0-9, a-z and all bytes over x7F.
    """
    t = np.zeros(256, bool)
    if pattern == "space":
        t[:] = True
        t[[0x20, *range(0x09, 0x0E)]] = False
    elif pattern == "alnum":
        t[0x30:0x3A] = t[0x61:0x7B] = True
        t[0x80:] = True
    else:
        raise ValueError(pattern)
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most `limit` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def split_pieces(text: bytes, limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text that ASCII white space parts, from about `limit` bytes at a time."""
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, at + limit)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _BLOCK)
        for key, base in (("up", _B), ("down", _B_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and row of every word; no word spans two rows."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    mask = table[data]
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from prefix sums of a polynomial over its bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        hi = ends[j - 1]
        up, down = _powers(int(hi - lo))
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def gram_hashes(words: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of every run of n words; len(words) - n + 1 values, row borders not regarded."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    c = np.uint64((0xA24BAED4963EE407 + 2 * seed * 0x9FB21C651E98DF25) % (1 << 64) | 1)
    total = words[:m].copy()
    for k in range(1, n):
        total *= c
        total += words[k : k + m]
    return mix(total + np.uint64(n * 0x632BE59BD9B4E019 % (1 << 64)))
