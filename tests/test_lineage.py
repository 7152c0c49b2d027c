import json
import random

from pyspark.sql import functions as F

from mirrorplan.operators import lineage
from mirrorplan.sources import ingest, state
from mirrorplan.streaming import feeds


def ends(parents):
    """Root and status of every id by walking up."""
    out = {}
    for start in parents:
        at, seen = start, []
        while at in parents and at not in seen and parents[at] is not None:
            seen.append(at)
            at = parents[at]
        out[start] = (at, "resolved") if at in parents and parents[at] is None else (at, "external") if at not in parents else (min(seen[seen.index(at) :]), "cycle")
    return out


def clips(spark, rows, at):
    """(account, clip, parent) as decoded clips."""
    raw = [(a, json.dumps({"id": c, "title": c, "metadata": {"edited_clip_id": p or ""}})) for a, c, p in rows]
    df = spark.createDataFrame(raw, "account_id string, payload string").withColumn("landed_at", F.timestamp_seconds(F.lit(at)))
    return ingest.decode_clips(df)


def test_batches_equal_a_full_fold(spark, tmp_path):
    rnd = random.Random(11)
    ids = [f"{k:02}" for k in range(26)]
    edges, roots, nodes = {}, {}, set()
    for number in range(5):
        batch = {}
        for _ in range(60 if number == 0 else rnd.choice([3, 9])):
            c = rnd.choice(ids)
            batch[(rnd.choice("xy"), c)] = rnd.choice([None, "out1", *ids, *ids[:3]])
        batch = {k: None if v == k[1] else v for k, v in batch.items()}
        rows = [(a, c, p) for (a, c), p in batch.items()]
        feeds.fold_batch(clips(spark, rows + rows[:1], number), str(tmp_path), number)
        for key, p in batch.items():
            edges.setdefault(key, set())
            nodes.add(key)
            if p:
                edges[key].add(p)
        for a in "xy":
            lookup = {c: batch[(a, c)] if (a, c) in batch else max(edges[(a, c)], default=None) for b, c in nodes if b == a}
            for c, new in ends(lookup).items():
                if roots.get((a, c), ("", ""))[1] != "resolved" or new[1] == "resolved":
                    roots[(a, c)] = new
            tree = {r.clip_id: (r.parent_id, r.root_id, r.status) for r in feeds.read_lineage(spark, str(tmp_path))["tree"].where(F.col("account_id") == a).collect()}
            assert tree == {c: (lookup[c], *end) for c, end in ends(lookup).items()}, number
        got = feeds.read_lineage(spark, str(tmp_path))
        assert {(r.account_id, r.clip_id): (r.root_id, r.status) for r in got["roots"].collect()} == roots, number
        assert {(r.account_id, r.clip_id) for r in got["nodes"].collect()} == nodes
    before = state.current(spark, str(tmp_path))
    assert feeds.fold_batch(clips(spark, [("x", "new", None)], 9), str(tmp_path), 4) == before  # a batch that is run again


def test_a_small_batch_touches_little(spark, tmp_path):
    """One clip in a hundred, of two accounts of 300, with a new parent: rows of the tables that are read and written."""
    path, accounts, size = str(tmp_path), 300, 40
    rows = [(f"a{a}", f"{a}-{c:02}", f"{a}-{c - 1:02}" if c % 10 else None) for a in range(accounts) for c in range(size)]
    first = feeds.fold_batch(clips(spark, rows, 0), path, 0)
    small = [(f"a{a}", f"{a}-{c:02}", f"{a}-00" if c else None) for a in (7, 99) for c in range(size)] + [("a7", f"7-n{k}", "7-01") for k in range(40)]
    touched = state.buckets_of(spark.createDataFrame([("a7",), ("a99",)], "account_id string"))
    second = feeds.fold_batch(clips(spark, small, 1), path, 1)
    assert len(small) == len(rows) // 100
    for name, schema in feeds.LINEAGE.items():
        whole, read = (state.table(spark, path, first, name, schema, b).count() for b in (None, touched))
        new = [f for f in second.tables[name].values() if f not in first.tables[name].values()]
        written = spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in new)).count()
        assert read < whole / 10 and written < whole / 10 + len(small), (name, whole, read, written)
    got = {r.clip_id: r.root_id for r in feeds.read_lineage(spark, path)["roots"].where("account_id = 'a7'").collect()}
    assert len(got) == size + 40 and set(got.values()) == {"7-00"}


def test_deep_chain_reads_less_each_round(spark, monkeypatch):
    """100,000 clips in one chain, others that end at once, a long cycle: rows of each round's tables."""
    sizes = []
    keep = lineage.written

    def watched(df, name):
        out = keep(df, name)
        sizes.append((out.count(), out.columns))
        return out

    monkeypatch.setattr(lineage, "written", watched)
    n = 100_000
    chain = spark.range(n).selectExpr("'c' AS account_id", "CAST(id AS string) AS clip_id", "CASE WHEN id > 0 THEN CAST(id - 1 AS string) END AS parent_id")
    flat = spark.range(n).selectExpr("'f' AS account_id", "CAST(id AS string) AS clip_id", "CASE WHEN id % 2 = 1 THEN CAST(id - 1 AS string) WHEN id % 4 = 0 THEN 'none' END AS parent_id")
    ring = spark.range(1000).selectExpr("'r' AS account_id", "CONCAT('r', id) AS clip_id", "CONCAT('r', (id + 1) % 1000) AS parent_id")
    found = lineage.resolve_roots(chain.unionByName(flat).unionByName(ring))
    got = {tuple(r[:3]): r[3] for r in found.groupBy("account_id", "root_id", "status").count().collect()}
    assert got[("c", "0", "resolved")] == n and got[("r", "r0", "cycle")] == 1000
    assert sum(c for k, c in got.items() if k[0] == "f" and k[2] == "external") == n // 2 and len(got) == n // 4 + 3
    rounds = [s for s, _ in sizes[1:-1]]
    assert sizes[0][0] == 2 * n + 1000 and rounds[0] == n - 1 + n // 2 + 1000  # clips that end at once are not read again
    assert rounds[-1] <= 1000 and all(a >= b for a, b in zip(rounds, rounds[1:], strict=False)) and len(rounds) <= 36


def test_roots_from_settled_ones(spark):
    lookup = spark.createDataFrame([("a", "1", "s"), ("a", "2", "1"), ("a", "3", "gone"), ("b", "1", "s")], "account_id string, clip_id string, parent_id string")
    settled = spark.createDataFrame([("a", "s", "R", "resolved"), ("a", "unused", "R", "resolved"), ("b", "s", "m", "cycle")], "account_id string, clip_id string, root_id string, status string")
    assert {tuple(r) for r in lineage.resolve_roots(lookup, settled).collect()} == {("a", "1", "R", "resolved"), ("a", "2", "R", "resolved"), ("a", "3", "gone", "external"), ("b", "1", "m", "cycle")}
    assert lineage.resolve_roots(lookup.limit(0)).collect() == []
