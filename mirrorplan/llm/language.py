"""Language identification by rank-order profiles.

A text's profile is the list of its TOP most frequent letter n-grams (1 to 3 letters of the
lower-cased text, a word's begin and end counting as one sign), by count and then by the gram's
hash. A language's profile comes from the summed counts of all its training texts. The distance to
a language is the sum, over the text's grams, of how far each stands out of place there (TOP if it
is missing); the language with the least distance wins, a tie going to the first by name.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import chunks, column, mix
from .quality import held_out

TOP = 300
UNKNOWN = "und"
_BITS = 40  # of a gram's hash; the row of a chunk stands above
_CHUNK = 1 << 20
_BLANK = re.compile(r"\s")


class Profiles(NamedTuple):
    languages: list[str]
    grams: np.ndarray  # sorted hashes of all profiles
    ranks: np.ndarray  # gram x language, TOP if missing


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_keys(texts: list[str]) -> np.ndarray:
    """Sorted (row << _BITS | gram hash) of every n-gram of the texts."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(t + "\0" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64)
    ends = np.cumsum([len(t) + 1 for t in low])
    letter = _letters()[points]
    at = np.flatnonzero(letter | np.concatenate([[False], letter[:-1]]))  # letters, and the first sign after each word
    row = np.searchsorted(ends, at, "right").astype(np.int64) << _BITS
    c = np.where(letter[at], points[at], 0).astype(np.uint64)
    if not len(c):
        return np.zeros(0, np.int64)
    p1 = np.concatenate([[np.uint64(0)], c[:-1]])
    p2 = np.concatenate([[np.uint64(0)] * 2, c[:-2]])[: len(c)]
    b = np.uint64(21)
    two = p1 << b | c
    three = p2 << (b + b) | two
    out = []
    for code, ok, size in ((c, c > 0, 1), (two, (p1 > 0) | (c > 0), 2), (three, p1 > 0, 3)):
        h = mix(code[ok] + np.uint64(size << 63 & 0xFFFFFFFFFFFFFFFF) + np.uint64(size)) >> np.uint64(64 - _BITS)
        out.append(h.astype(np.int64) | row[ok])
    keys = np.concatenate(out)
    keys.sort()
    return keys


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (row << _BITS | gram hash) and its count; a text longer than a chunk is counted in pieces cut at white space."""
    if len(texts) != 1 or len(texts[0]) <= _CHUNK:
        return _counted(gram_keys(texts))
    text, at, parts = texts[0], 0, []
    while at < len(text):
        cut = _BLANK.search(text, at + _CHUNK)
        end = cut.start() if cut else len(text)
        parts.append(_counted(gram_keys([text[at:end]])))
        if len(parts) >= 16:
            parts = [_merged(parts)]
        at = end
    return _merged(parts)


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return chunks(offs, _CHUNK)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, text) -> (lang, gram, n) summed over all rows; null languages and texts give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        for batch in batches:
            langs, texts = column(batch, "lang").to_pylist(), column(batch, "text").to_pylist()
            for lang in set(langs):
                own = [t for k, t in zip(langs, texts, strict=True) if k == lang]
                for a, b in _pieces(own):
                    kept.setdefault(lang, []).append(gram_counts([" ".join(own[a:b])]))
                    if len(kept[lang]) >= 16:
                        kept[lang] = [_merged(kept[lang])]
        for lang, parts in kept.items():
            grams, n = _merged(parts)
            for a in range(0, len(grams), 50_000):
                g = pa.array(grams[a : a + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), g, pa.array(n[a : a + 50_000])], ["lang", "gram", "n"])

    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, top: int = TOP) -> Profiles:
    """Profiles of the languages of documents outside the held-out fifth: top grams of each, on the driver."""
    counts = count_grams(docs.where(~held_out()))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "gram", "rank").collect()
    languages = sorted({r[0] for r in rows})
    grams = np.unique(np.array([r[1] for r in rows], np.int64))
    ranks = np.full((len(grams), max(1, len(languages))), top, np.int32)
    for lang, gram, place in rows:
        ranks[np.searchsorted(grams, gram), languages.index(lang)] = place - 1
    return Profiles(languages, grams, ranks)


def distances(texts: list[str], profiles: Profiles, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Text x language out-of-place distances, and the number of grams of each text's profile."""
    keys, n = gram_counts(texts)
    row = keys >> _BITS  # below 2^21, and a count below 2^40
    order = np.argsort(row << 40 | ((1 << 40) - 1 - n), kind="stable")
    row = row[order]
    begin = np.searchsorted(row, np.arange(len(texts)))
    place = np.arange(len(row)) - begin[row]
    keep = place < top
    row, place, gram = row[keep], place[keep], keys[order][keep] & ((1 << _BITS) - 1)
    k = np.minimum(np.searchsorted(profiles.grams, gram), max(0, len(profiles.grams) - 1))
    out = np.empty((len(texts), len(profiles.languages)))
    for j in range(len(profiles.languages)):
        theirs = np.where(profiles.grams[k] == gram, profiles.ranks[k, j], top)
        out[:, j] = np.bincount(row, np.where(theirs == top, top, np.abs(theirs - place)), len(texts))
    return out, np.bincount(row, minlength=len(texts))


def predict(docs: DataFrame, profiles: Profiles, top: int = TOP) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per document row.

    score is 1 less the least distance's share of the largest possible one. A null text, or one
    without a letter, gives 'und' and 0; so does every text if nothing was learned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            langs, scores = [], []
            for a, b in _pieces(texts):
                known = sent.value.languages
                if not known:
                    langs += [UNKNOWN] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                far, size = distances(texts[a:b], sent.value, top)
                best = far.argmin(1)
                langs += [known[j] if m else UNKNOWN for j, m in zip(best, size, strict=True)]
                scores += np.where(size, 1 - far.min(1) / np.maximum(1, size * top), 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
