"""Jaccard similarity of word shingles, for the near-copy form of SimHash: tokens, verification, exact remainder.

Tokens are 64-bit hashes of word shingles, put in one order for all documents. Sets of n tokens that reach
the similarity share one of their first n - ceil(0.8 n) + 1 tokens, so those are joined. The order is free: tokens
that are common in a sample come last, which keeps groups small and loses nothing. Pairs are thinned by bounds that
never drop a true pair (sizes; how much of both sets follows their first common token; parity bitmaps, whose bits
differ in at most as many places as the sets) and then counted token by token. Pairs within one component are not compared, so a large group costs little once linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._state import discard, materialise
from ._text import column, gram_hashes, mix, split_pieces
from .components import connected_components

SHINGLE = 5
#: The least similarity, as a fraction.
NUM, DEN = 4, 5
_WORDS = 8  # 64-bit words of a parity bitmap
_SAMPLE, _COMMON = 20_000, 50_000
_BLOCK = 2000
_PIECE = 1 << 16


def token_set(text: bytes | None) -> np.ndarray:
    """The distinct tokens of a text, ascending; a text of fewer words is one shingle, one of none has no token."""
    pieces = split_pieces((text or b"").lower())  # bytes: A-Z and ASCII white space only
    h = np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)) for w in pieces)])
    return np.unique(gram_hashes(h, min(SHINGLE, len(h)))) if len(h) else h


def _key(tokens: np.ndarray) -> int:
    """64 bits that stand for the set."""
    return int(mix(np.array([mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64))[0])


def _parity(tokens: np.ndarray, words: int = _WORDS) -> np.ndarray:
    """Which of 64 * words places an odd number of tokens falls on. A longer map folds into one of half its length by xor."""
    size = 64 * words
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _long_parity(tokens: np.ndarray) -> np.ndarray:
    """A parity map of one to two places a token, for sets that crowd the _WORDS words of the others; none for the rest."""
    words = 1 << len(tokens).bit_length() >> 6
    return _parity(tokens, words) if words > _WORDS else np.zeros(0, np.int64)


def fingerprint(tokens: np.ndarray) -> int:
    """SimHash of the set: a bit is 1 if it is set in over half the tokens."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(tokens), _PIECE):
        part = tokens[at : at + _PIECE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(tokens)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (token_set(t.as_py()) for t in column(batch, "text").cast(pa.large_binary()))


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, key, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_texts(batch))
            keys = np.fromiter((_key(s) for s in sets), np.uint64, len(sets))
            tokens = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(keys.view(np.int64)), tokens], ["doc_id", "key", "tokens"])

    return docs.mapInArrow(run, "doc_id bigint, key bigint, tokens array<bigint>")


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, key, fp, n, parity words p0.., prefix, long parity map), one row per row."""
    common, counts = _common(docs)
    names = [f"p{k}" for k in range(_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, fps, sizes, bits, firsts, maps = [], [], [], [], [], []
            for s in _texts(batch):
                n, rank = len(s), np.zeros(len(s), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    rank = np.where(common[at] == s, counts[at], 0)
                keys.append(_key(s))
                fps.append(fingerprint(s))
                sizes.append(n)
                bits.append(_parity(s))
                maps.append(_long_parity(s))
                firsts.append(s[np.argsort(rank, kind="stable")[: n + (-n * NUM) // DEN + 1 if n else 0]].view(np.int64))
            table = np.array(bits, np.int64).reshape(-1, _WORDS)
            columns = [column(batch, "doc_id"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, fps)), pa.array(sizes, pa.int32())]
            columns += [pa.array(np.ascontiguousarray(table[:, k])) for k in range(_WORDS)]
            columns += [pa.array(x, pa.list_(pa.int64())) for x in (firsts, maps)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "fp", "n", *names, "prefix", "map"])

    return docs.mapInArrow(run, f"doc_id bigint, key bigint, fp bigint, n int, {', '.join(f'{p} bigint' for p in names)}, prefix array<bigint>, map array<bigint>")


def nodes_of(found: DataFrame) -> DataFrame:
    """The distinct sets of marks(): key, the smallest doc_id (node), fp, n, the parity words, the prefix and the map."""
    same = ["fp", "n", *[f"p{k}" for k in range(_WORDS)], "prefix", "map"]
    return found.groupBy("key").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in same])


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest tokens of about 20000 documents and their counts; they only decide the order of tokens."""
    step = max(1, docs.count() // _SAMPLE)
    tokens = _sets(docs.where(F.expr(f"pmod(xxhash64(doc_id), {step}) = 0"))).select(F.explode("tokens").alias("t"))
    top = tokens.groupBy("t").count().where("count > 2").orderBy(F.desc("count"), "t").limit(_COMMON).toArrow()
    t = top["t"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(t)
    return t[order], top["count"].to_numpy().astype(np.int64)[order]


def _rest(a: str, b: str) -> str:
    """What every pair of the similarity meets at its first common token: enough of both sets is left from there on."""
    return f"{NUM + DEN} * ({a}.n - {a}.at) >= {NUM} * ({a}.n + {b}.n) and {NUM + DEN} * ({b}.n - {b}.at) >= {NUM} * ({a}.n + {b}.n)"


def _bounds(a: str, b: str) -> str:
    """What every pair of the similarity meets."""
    apart = " + ".join(f"bit_count({a}.p{k} ^ {b}.p{k})" for k in range(_WORDS))
    return (
        f"{DEN} * least({a}.n, {b}.n) >= {NUM} * greatest({a}.n, {b}.n)"
        f" and {NUM + DEN} * ({apart}) <= {DEN - NUM} * ({a}.n + {b}.n)"
    )


def may_reach(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys, a < b, that meet the bounds, once each; long sets by their maps too.

    Whole sets are sent for each pair that is left, so most of the others have to go here: long sets crowd the short words,
    and the pairs of unlike long texts grow with the square of the texts.
    """
    small = nodes.select("key", "n", *[f"p{k}" for k in range(_WORDS)])
    x, y = small.alias("x"), small.alias("y")
    pairs = pairs.join(x, F.col("x.key") == F.col("a")).join(y, F.col("y.key") == F.col("b")).where(_bounds("x", "y"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("x.n") + F.col("y.n")).alias("both")).distinct()
    pairs = materialise(pairs, "close")
    maps = nodes.where("size(map) > 0").select("key", "map")
    rows = pairs.join(maps.withColumnsRenamed({"key": "a", "map": "s"}), "a", "left").join(maps.withColumnsRenamed({"key": "b", "map": "t"}), "b", "left")
    # sizes within the bounds differ by less than 2, so one fold is enough
    fold = "if(size({s}) > size({t}), zip_with(slice({s}, 1, size({t})), slice({s}, size({t}) + 1, size({t})), (p, q) -> p ^ q), {s})"
    s, t = fold.replace("{s}", "s").replace("{t}", "t"), fold.replace("{s}", "t").replace("{t}", "s")
    apart = f"aggregate(zip_with({s}, {t}, (p, q) -> bit_count(p ^ q)), 0, (u, v) -> u + v)"
    found = materialise(rows.where(f"s is null or t is null or {NUM + DEN} * ({apart}) <= {DEN - NUM} * both").select("a", "b"), "pairs")
    discard(pairs)
    return found


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets reach the similarity, counted token by token."""
    pairs = may_reach(pairs, nodes)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    ids = ends.join(nodes, "key").select(F.col("node").alias("doc_id"), F.col("key").alias("want"))
    texts = docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    # a repeated doc_id may bring other texts along: its sets are kept by key
    sets = materialise(_sets(texts).join(ids.select(F.col("want").alias("key")), "key", "left_semi").select("key", "tokens"), "tokens")
    one = sets.groupBy("key").agg(F.first("tokens").alias("tokens"))
    both = pairs.join(one.withColumnsRenamed({"key": "a", "tokens": "s"}), "a").join(one.withColumnsRenamed({"key": "b", "tokens": "t"}), "b")
    found = both.where(f"{NUM + DEN} * size(array_intersect(s, t)) >= {NUM} * (size(s) + size(t))").select("a", "b")
    found = materialise(found, "verified")
    discard(pairs)
    discard(sets)
    return found


def components(links: DataFrame) -> DataFrame:
    """(a, b) keys -> (node, component), written."""
    found = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    out = materialise(found, "components")
    discard(found)
    return out


def with_component(rows: DataFrame, comps: DataFrame, key: str = "key", name: str = "component") -> DataFrame:
    """rows and the component of their key, which is the key itself where it has no link."""
    of = comps.withColumnsRenamed({"node": key, "component": name})
    return rows.join(of, key, "left").withColumn(name, F.coalesce(name, key))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    pairs = with_component(with_component(pairs, comps, "a", "_ca"), comps, "b", "_cb")
    return pairs.where("_ca <> _cb").drop("_ca", "_cb")


def links_of(nodes: DataFrame, near: DataFrame, ties: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys of the similarity, and enough of them to join all keys that such pairs join.

    near: pairs that may have it, ties: pairs that belong together whatever their sets.
    """
    firsts = nodes.select("key", F.posexplode("prefix").alias("at", "token"))
    groups = firsts.groupBy("token").agg(F.count("*").alias("size"), F.min("key").alias("lead")).where("size > 1")
    groups = materialise(groups, "groups")  # its shuffle goes before the next begins
    live = materialise(firsts.join(groups.hint("merge"), "token"), "shared")  # firsts are more than Spark takes them for: a row for each token
    discard(groups)

    # first what is near, and every member of a group with the group's leader
    stars = live.where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b")).union(near).distinct()
    stars = materialise(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "stars")
    links, comps = _linked(ties, stars, docs, nodes)

    # then every pair of a group that is in two components
    rows = with_component(live.select("token", "key", "at", "size"), comps)
    mixed = rows.groupBy("token").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("token")
    rows = rows.join(mixed, "token").join(nodes.drop("node", "fp", "prefix", "map"), "key")
    blocks = f"cast(ceil(size / {_BLOCK}) as int)"
    x = rows.withColumn("block", F.explode(F.expr(f"sequence(0, {blocks} - 1)"))).alias("x")
    y = rows.withColumn("block", F.expr(f"cast(pmod(xxhash64(key), {blocks}) as int)")).alias("y")
    apart = "x.token = y.token and x.block = y.block and x.key < y.key and x.component <> y.component"
    close = x.join(y, F.expr(f"{apart} and {_rest('x', 'y')} and {_bounds('x', 'y')}"))
    apart = " + ".join(f"bit_count(x.p{k} ^ y.p{k})" for k in range(_WORDS))
    pairs = close.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.expr(f"({apart}) / (x.n + y.n)").alias("far")).distinct()
    pairs = pairs.join(stars, ["a", "b"], "left_anti")
    at = F.row_number().over(Window.partitionBy("a").orderBy("far", "b"))
    pairs = materialise(pairs.withColumn("batch", F.floor(F.log(8.0, at)).cast("int")), "candidates")
    discard(live)
    discard(stars)
    last = pairs.agg(F.max("batch")).first()[0]
    for k in range(0 if last is None else last + 1):  # nearest first, eight times as many in each batch
        todo = _apart(pairs.where(f"batch = {k}").select("a", "b"), comps)
        before = links, comps
        links, comps = _linked(links, todo, docs, nodes)
        for done in before:
            discard(done)
    discard(pairs)
    discard(comps)
    return links


def _linked(links: DataFrame, pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links and those of the pairs that are verified, and the components of all of them."""
    found = verified(pairs, docs, nodes)
    links = materialise(links.union(found), "links")
    discard(found)
    return links, components(links)
