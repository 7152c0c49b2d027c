"""SimHash near-duplicates, joined over the anchor points of a covering code.

A 64-bit fingerprint is cut into two 31-bit parts (two bits stay aside). Fingerprints that
differ in at most 3 bits differ in at most 1 bit of one part. The codewords of the perfect
[31, 26] Hamming code cover each part with radius 1: a fingerprint has one *home* anchor within
1 bit, and visits every anchor within 1 + 1 bits, 16 at most. Two parts within 1 bit of each
other meet at the home anchor of either, so comparing visitors with residents finds every pair.
Only distinct fingerprints take part, so copies cost nothing. Visitors are first linked to one
resident of their anchor; pairs are formed only between the components that then still meet there,
so a dense group costs one row for each of its members and anchors.

near_duplicates() is that alone, on three-word shingles and 3 bits. near_copies() asks for a Jaccard
similarity of 0.8 of five-word shingles. Fingerprints of such pairs lie about 10 of 64 bits apart at
the threshold, where no covering of a bounded number of anchors holds all pairs; so what the anchors
find is verified by its shingles, and an exact join on rare shingles (_jaccard) adds what they miss.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _jaccard
from ._state import discard, materialise
from ._text import column, split_pieces
from .components import connected_components

MAX_DISTANCE = 3
_PIECE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text: a bit is 1 if it is set in over half the shingles' XXH64."""
    counts, n, left = np.zeros(64, np.int64), 0, []
    for words in split_pieces((text or b"").lower()):  # bytes: A-Z and ASCII white space only
        words = left + words
        size = max(0, len(words) - shingle + 1)
        left = words[size:]
        counts += _bit_counts(words, shingle, size, seed)
        n += size
    if not n and left:
        n, counts = 1, _bit_counts(left, len(left), 1, seed)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _bit_counts(words: list[bytes], shingle: int, n: int, seed: int) -> np.ndarray:
    """How many of the first n shingles' hashes have each bit."""
    counts = np.zeros(64, np.int64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: max(0, n - 1)]]
    parts = (joined[a : b - 1] for a, b in zip(starts, ends[shingle - 1 :], strict=False))
    digest = xxhash.xxh64_intdigest
    while n:
        size = min(n, _PIECE)
        h = np.fromiter((digest(p, seed) for p in islice(parts, size)), np.uint64, size)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n -= size
    return counts


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp bigint), one row per input row; a null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _at_anchors(fps: DataFrame) -> DataFrame:
    """fp -> one row per part: its bits x, its syndrome s under the code, and its home anchor."""
    parts = F.explode(
        F.array(
            F.struct(F.lit(0).alias("side"), F.expr("fp & 2147483647L").alias("x")),
            F.struct(F.lit(1).alias("side"), F.expr("shiftrightunsigned(fp, 33)").alias("x")),
        )
    ).alias("p")
    rows = fps.select("fp", parts).select("fp", "p.side", "p.x")
    checks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    syndrome = " + ".join(f"(bit_count(x & {m}L) % 2) * {1 << k}" for k, m in enumerate(checks))
    rows = rows.withColumn("s", F.expr(f"cast({syndrome} as int)"))
    return rows.withColumn("home", F.expr("if(s = 0, x, x ^ shiftleft(1L, s - 1))"))


def _homes(fps: DataFrame) -> DataFrame:
    return _at_anchors(fps).select(F.expr("home * 2 + side").alias("anchor"), F.col("fp").alias("b"))


def _meets(fps: DataFrame) -> DataFrame:
    """(anchor, a, b) of the visitors a of anchors where another fingerprint lives; b is the smallest resident."""
    around = (
        "concat(array(home), transform(filter(sequence(1, 31), i -> i < (i ^ s)),"
        " i -> x ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1)))"
    )
    visits = _at_anchors(fps).select("side", F.col("fp").alias("a"), F.explode(F.expr(around)).alias("at")).select(
        F.expr("at * 2 + side").alias("anchor"), "a"
    )
    leads = _homes(fps).groupBy("anchor").agg(F.min("b").alias("b"), F.count("*").alias("n"))
    # Spark sizes visits as if they were not exploded, and would broadcast 32 rows of each fingerprint
    return visits.join(leads.hint("merge"), "anchor").where("a <> b or n > 1").select("anchor", "a", "b")


def _stars(meets: DataFrame, max_distance: int) -> DataFrame:
    near = meets.where(f"a <> b and bit_count(a ^ b) <= {int(max_distance)}")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def anchor_links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Distinct fingerprints fp -> edges (a, b) of at most max_distance (3 at most) bits, and enough of them:
    fingerprints that any chain of such edges joins are joined by these.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("the parts cover distances up to 3")
    meets = materialise(_meets(fps), "meets")
    stars = materialise(_stars(meets, max_distance), "links")

    # what still meets at an anchor out of two components
    comps = _jaccard.components(stars)
    visitors = _jaccard.with_component(meets.select("anchor", "a"), comps, "a", "ca")
    residents = _jaccard.with_component(_homes(fps).join(meets.select("anchor").distinct(), "anchor", "left_semi"), comps, "b", "cb")
    visitors, residents = materialise(visitors, "visitors"), materialise(residents, "residents")
    both = visitors.select("anchor", F.col("ca").alias("c")).union(residents.select("anchor", F.col("cb").alias("c")))
    mixed = both.groupBy("anchor").agg(F.min("c").alias("c"), F.max("c").alias("d")).where("c <> d").select("anchor")
    v, r = visitors.join(mixed, "anchor", "left_semi").alias("v"), residents.join(mixed, "anchor", "left_semi").alias("r")
    rest = v.join(r, F.expr(f"v.anchor = r.anchor and ca <> cb and bit_count(a ^ b) <= {int(max_distance)}"))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialise(stars.union(rest), "links")
    for done in (meets, stars, comps, visitors, residents):
        discard(done)
    return links


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint hex, component_id): the smallest doc_id reachable over links.

    One row per input row. A null or empty text has fingerprint zero and is linked like any other.
    Rows that repeat a doc_id are each fingerprinted; a null doc_id takes no part and gets a null
    component_id. An empty table gives an empty result. Only doc_id and text are read.
    """
    fps = materialise(fingerprints(docs, shingle), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null")
    edges = anchor_links(nodes.select("fp"), max_distance).join(nodes.withColumnsRenamed({"fp": "a", "node": "u"}), "a").join(
        nodes.withColumnsRenamed({"fp": "b", "node": "v"}), "b"
    )
    # a row that repeats a doc_id under another text ties its fingerprints together
    same = fps.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b and doc_id is not null")
    known = fps.join(same.select("doc_id"), "doc_id").join(nodes, "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    comps = connected_components(edges.select("u", "v").union(known))
    of_fp = nodes.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(of_fp, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """docs, with the row of the smallest doc_id of each group; all columns stay.

    Of rows that share that doc_id the least by text stays. Rows with a null doc_id stay.
    """
    return keep_smallest(docs, near_duplicates(docs.select("doc_id", "text"), shingle, max_distance))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, component_id): the smallest doc_id reachable over pairs of similarity 0.8 or more.

    One row per input row with a doc_id. Words are runs without ASCII white space, A-Z in lower case. Null and
    blank texts are copies of each other. Rows that repeat a doc_id belong together. An empty table gives no row.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    found = materialise(_jaccard.marks(docs), "marks")
    nodes = materialise(_jaccard.nodes_of(found), "sets")
    ids = materialise(found.select("doc_id", "key"), "keys")
    discard(found)
    same = ids.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").select("doc_id", "a")
    ties = ids.join(same, "doc_id").where("a <> key").select("a", F.col("key").alias("b")).distinct()

    leads = nodes.groupBy("fp").agg(F.min("key").alias("lead"))
    alike = nodes.join(leads, "fp").where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    of = lambda fp, key: leads.withColumnsRenamed({"fp": fp, "lead": key})
    meets = _meets(leads.select("fp"))
    apart = _stars(meets, MAX_DISTANCE).withColumnsRenamed({"a": "f", "b": "g"}).join(of("f", "a"), "f").join(of("g", "b"), "g")
    links = _jaccard.links_of(nodes, alike.union(apart.select("a", "b")), ties, docs)
    comps = _jaccard.components(links)
    discard(links)
    of_key = _jaccard.with_component(nodes.select("key", "node"), comps)
    least = of_key.groupBy("component").agg(F.min("node").alias("component_id"))
    return ids.join(of_key.join(least, "component").select("key", "component_id"), "key").select("doc_id", "component_id")


def keep_similar(docs: DataFrame) -> DataFrame:
    """docs, with the row of the smallest doc_id of each group of near copies; all columns stay.

    Of rows that share that doc_id the least by text stays. Rows with a null doc_id stay.
    """
    return keep_smallest(docs, near_copies(docs))


def keep_smallest(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is not the component_id of its group; one row of each doc_id, the least by text."""
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_simhash_gone")).distinct()
    first = docs.join(gone, F.col("doc_id") == F.col("_simhash_gone"), "left_anti")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return first.withColumn("_simhash_row", at).where("_simhash_row = 1 or doc_id is null").drop("_simhash_row")
