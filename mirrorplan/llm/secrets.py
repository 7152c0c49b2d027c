"""Secrets in texts: fixed patterns, and strings near a sensitive word that do not compress.

Patterns: `assign` (a sensitive name, : or =, and a value of 8 signs or more), `access` (AKIA and 12 capitals or digits
or more) and `hex` (32 lower-case hexadecimal digits or more). `novel` are further strings of 16 signs or more with a
sensitive word in the 64 signs before them or in themselves: each is compressed by zstandard between its surroundings
(256 signs either side, its own copies taken out), and they without it; the bytes it adds for each of its signs, or
those it adds to what stands before it alone if fewer, are its novelty. The compressor knows the corpus' words: its
dictionary, with the code lengths of letters, is made of the 6000 words with the most letters in all texts (words of
letters and underscores only, so that repeated keys do not get in). Words, names and paths of
the corpus cost half a byte a sign or less there, strange ones up to about 0.7, random keys about a byte.

Positions are code points, ends exclusive. Null text is empty. Rows are judged one by one, so rows that repeat a doc_id or
a text get alike results; an empty table gives no rows. Texts are scanned whole, one at a time, and counted in pieces.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import column

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_~-][A-Za-z0-9+/_.~-]{14,}[A-Za-z0-9+/_~-]={0,2}")
SENSITIVE = re.compile(r"pass(?:word|wd|phrase|code)|secret|token|(?:api|access|private|auth|signing)[_ -]?key|credential|bearer|authorization|login", re.ASCII | re.IGNORECASE)
NEAR, AROUND = 64, 256
NOVELTY = 0.72
DICTIONARY_WORDS, DICTIONARY_BYTES, SAMPLES = 6000, 32768, 750
_LEVEL = 3
_WORD = re.compile(r"[^\W\d]{4,24}")
_EDGE = re.compile(r"\W")
_PIECE = 1 << 20
_HELD = 1 << 16  # distinct words that a task counts before it hands them on


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(text):
        cut = _EDGE.search(text, at + _PIECE)
        end = cut.start() if cut else len(text)
        yield at, end
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word of 4 to 24 letters or underscores occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for cell in batch.column(0):
                text = cell.as_py() or ""
                for at, end in _pieces(text):
                    counts.update(_WORD.findall(text, at, end))
                    if len(counts) > _HELD:
                        yield told()
        yield told()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn_dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> bytes:
    """A zstandard dictionary of the corpus' weightiest words (at most `words` of them reach the driver); no words, no bytes."""
    best = word_counts(docs).orderBy((F.col("n") * F.length("word")).desc(), "word").limit(words)
    found = [r["word"].encode() for r in best.collect()]
    samples = [s for s in (b" ".join(found[i::SAMPLES]) for i in range(SAMPLES)) if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=_LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few words for one with code lengths
        return b" ".join(reversed(found))


class Novelty:
    """Marginal compressed bytes of a string between its surroundings."""

    def __init__(self, dictionary: bytes):
        known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.size = zstandard.ZstdCompressor(level=_LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **known)

    def __call__(self, text: str, start: int, end: int) -> float:
        said = text[start:end]
        before, after = text[max(0, start - AROUND) : start].replace(said, "").encode(), text[end : end + AROUND].replace(said, "").encode()
        said = said.encode()
        cost = lambda x: len(self.size.compress(x))
        return min(cost(before + said + after) - cost(before + after), cost(before + said) - cost(before)) / len(said)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, least: float) -> list[tuple[int, int, int, float]]:
    """Incompressible strings near a sensitive word that overlap no base span."""
    found, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(base) and base[k][0] < end:
            reach, k = max(reach, base[k][2]), k + 1
        if reach > start or not SENSITIVE.search(text, max(0, start - NEAR), end):
            continue
        new = novelty(text, start, end)
        if new >= least:
            found.append((start, 3, end, new))
    return found


SPANS = "array<struct<kind:string,start:bigint,end:bigint,novelty:double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))


def _spans(text: str, novelty: Novelty, least: float) -> list[tuple]:
    base = base_spans(text)
    return sorted([(*b, None) for b in base] + novel_spans(text, base, novelty, least), key=lambda s: s[:3])


def find(docs: DataFrame, dictionary: bytes, least: float = NOVELTY) -> DataFrame:
    """doc_id, spans: kind, start and end of each span by start, then kind; novelty of the novel ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "novelty": n} for s, k, e, n in _spans(cell.as_py() or "", novelty, least)] for cell in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(rows, _SPAN)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact(docs: DataFrame, dictionary: bytes, mark: str = "[secret]", least: float = NOVELTY) -> DataFrame:
    """docs with `mark` in place of each span of their texts; spans that overlap become one. Null texts stay null."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            texts = []
            for cell in column(batch, "text"):
                text = cell.as_py()
                out, at = [], 0
                for start, _, end, _ in _spans(text or "", novelty, least):
                    if start >= at:
                        out += [text[at:start], mark]
                    at = max(at, end)
                texts.append(text if text is None or not out else "".join([*out, text[at:]]))
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return docs.mapInArrow(scan, docs.schema)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the fixed patterns' spans), spans (all of them, as text). The dictionary is learned from docs if none is given."""
    rows = find(docs, learn_dictionary(docs) if dictionary is None else dictionary)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_listed(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )
