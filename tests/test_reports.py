import random

import duckdb
from pyspark.sql import functions as F

from mirrorplan.functions import clips as fn
from mirrorplan.operators import reports, select

from .measure import shuffled_rows


def test_tenths_round_by_exact_value(spark):
    rnd = random.Random(1)
    values = [k / 20 + n for k in range(40) for n in (0, 1, 7, 1000, 2**40)] + [rnd.uniform(0, 1e6) for _ in range(500)] + [0.1 * k for k in range(300)] + [-0.25, -1.75, -0.04, 9.95, 99.95, 0.9499999999999999, 1e15 + 0.5]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fn.tenths("v").alias("t")).collect()
    assert [r["t"] for r in got] == [f"{r['v']:.1f}" for r in got]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double").select(fn.tenths("v").alias("t")).collect()
    assert [r["t"] for r in odd] == ["NaN", "inf", "-inf", None]


def test_stamps_of_far_years(spark):
    """Years before 0 and after 9999 as DuckDB writes them; keys of 9,000,000 orders reach the year 26610."""
    seconds = [0, 86399, 253402300799, 253402300800, 9_000_000 * 86399, 54_000_000 * 86399, -1, -62135596800, -62135596801, -62167219200, -62167219201, -100000000000, -50000000000]
    want = duckdb.connect().execute("SELECT s, strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%SZ') FROM (SELECT unnest(?) AS s)", [seconds]).fetchall()
    got = spark.createDataFrame([(x,) for x in seconds], "s bigint").select("s", fn.rfc3339("s").alias("stamp")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_roots_are_compared_as_folders(spark):
    nests = [("/m/Music", "/m/music/x"), ("/m/a/../music/y", "/m/music"), ("./music", "music"), ("music//", "music/./b"), ("/\u00e9toile", "/e\u0301toile"), ("/", "/a"), ("/../a", "/a"), (".", "a/b"), ("", "/x"), ("../a", "../A/b"), ("a/..", "b"), ("../..", "../../c")]
    apart = [("/music", "/musicfoo"), ("/Music", "/Videos"), ("../a", "a"), ("/a", "a"), ("a/../../b", "b")]
    roots = sorted({r for pair in nests + apart for r in pair})
    parts = {r["root"]: r["p"] for r in spark.createDataFrame([(r,) for r in roots], "root string").select("root", select.root_parts("root").alias("p")).collect()}
    for a, b in nests + apart:
        n = min(len(parts[a]), len(parts[b]))
        assert (parts[a][:n] == parts[b][:n]) == ((a, b) in nests), (a, b, parts[a], parts[b])
    df = spark.createDataFrame(list(enumerate(("/a", "/A/b", "/c", "/a", "/a/b/c/d"))), "account_id bigint, root string")
    assert {tuple(r) for r in select.overlapping_roots(df).collect()} == {(0, 1), (0, 3), (0, 4), (1, 3), (1, 4), (3, 4)}


def test_pairs_of_roots_are_not_shuffled(spark):
    rows = [(k, ("/", "/all", "/all/x", "/ALL/x/y", "/b")[min(k % 17, 4)]) for k in range(600)] + [(k, "/all/x") for k in range(0, 600, 50)] + [(1000, None)]
    parts = lambda r: [p for p in r.lower().split("/") if p]
    inside = lambda a, b: parts(b)[: len(parts(a))] == parts(a)
    want = sorted({(min(x, y), max(x, y)) for x, a in rows if a for y, b in rows if b and x != y and inside(a, b)})
    df = spark.createDataFrame(rows, "account_id bigint, root string")
    assert sorted(tuple(r) for r in select.overlapping_roots(df, chunk=16).collect()) == want
    many = spark.range(3000).select("id", F.lit("/all").alias("root")).toDF("account_id", "root")
    before = shuffled_rows(spark)
    assert select.overlapping_roots(many).count() == 3000 * 2999 // 2
    assert shuffled_rows(spark) - before < 50_000


def test_conflicts_of_one_shared_folder_are_a_row_each(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("account_id"), F.lit("/all").alias("root")).unionByName(spark.createDataFrame([("x", "/all/x"), ("y", "/other")], "account_id string, root string"))
    got = {r["account_id"]: r for r in select.root_conflicts(df).collect()}
    assert len(got) == 5001 and got["0"]["example"] == "1" and got["7"]["example"] == "0"
    assert (got["7"]["n_same"], got["7"]["n_above"], got["7"]["n_below"]) == (4999, 0, 1) and (got["x"]["n_same"], got["x"]["n_above"], got["x"]["example"]) == (0, 5000, "0")
    assert select.root_conflicts(df.limit(0)).collect() == []


def test_recency(spark):
    assert fn.parse_recency(" 7D ") == 604_800 and fn.parse_recency("2w") == 1_209_600 and fn.parse_recency("last-run") == "last-run"
    for bad in ("", "7", "d", "-1d", "7m"):
        try:
            fn.parse_recency(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_blocks_show_few_and_count_all(spark):
    rows = [("a", f"p{k:03}") for k in range(45)] + [("b", "x")]
    text = {r["account_id"]: r["text"] for r in reports.orphan_report(spark.createDataFrame(rows, "account_id string, path string"), 2).collect()}
    assert text["a"].split("\n")[0].startswith("note: 45 untracked") and text["a"].split("\n")[1:4] == ["  p000", "  p001", "  ... and 43 more"] and "more" not in text["b"]
    prompt = reports.delete_prompt(spark.createDataFrame(rows, "account_id string, path string"), 0).collect()
    assert {r["text"].count("\n") for r in prompt} == {3}


def test_paths_are_released_one_by_one(spark):
    """Against a run that goes through the events in order; two slots that leave one path in the same run among them."""
    rnd = random.Random(3)
    names = [f"p{k}" for k in range(6)]
    events = [("a", k, rnd.choice(names), rnd.random() < 0.4, rnd.choice(names) if rnd.random() < 0.1 else f"new{k}") for k in range(60)] + [("b", 0, "x", False, "y"), ("b", 1, "x", False, "z")]
    counts = {("a", p): rnd.randrange(0, 14) for p in names[:5]} | {("b", "x"): 2}
    left, written, want = dict(counts), set(), set()
    for a, k, p, move, to in events:
        free = (a, p) not in written
        if move and left.get((a, p), 0) <= 1 and free:
            want.add((a, k, p, True, "rename", False))
            left[(a, p)] = max(0, left.get((a, p), 0) - 1)
        else:
            left[(a, p)] = max(0, left.get((a, p), 0) - 1)
            want.add((a, k, p, move, "refetch" if move else "write", left[(a, p)] == 0 and free))
        written.add((a, to))
    df = spark.createDataFrame(events, "account_id string, seq int, path string, move boolean, target string")
    held = spark.createDataFrame([(*k, n) for k, n in counts.items()], "account_id string, path string, n bigint")
    got = reports.release_paths(df.drop("target"), held, df.select("account_id", "seq", F.col("target").alias("path")))
    assert {tuple(r) for r in got.collect()} == want
    assert {r[1]: r[5] for r in want if r[0] == "b"} == {0: False, 1: True}


def test_given_up_paths_of_a_plan(spark):
    plan = [("a", 1, "c", "write_artifact", "lrc", "", "new.lrc", None), ("a", 2, "c", "move_stem", "stem", "s", "n.mp3", "o.mp3"), ("a", 3, "d", "write_artifact", "lrc", "", "same.lrc", None), ("a", 4, "e", "write_artifact", "lrc", "", "first.lrc", None), ("a", 5, "c", "delete_artifact", "lrc", "", "old.lrc", None)]
    ordered = spark.createDataFrame(plan, "account_id string, seq int, clip_id string, action string, slot_kind string, slot_key string, path string, from_path string")
    slots = spark.createDataFrame([("a", "c", "lrc", "", "old.lrc"), ("a", "c", "stem", "s", "o.mp3"), ("a", "d", "lrc", "", "same.lrc")], "account_id string, clip_id string, kind string, key string, path string")
    assert {tuple(r) for r in reports.given_up(ordered, slots).collect()} == {("a", 1, "old.lrc", False), ("a", 2, "o.mp3", True)}
