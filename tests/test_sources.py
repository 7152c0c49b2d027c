import hashlib
import json

import pytest
from pyspark.sql import functions as F

from mirrorplan.catalog import states
from mirrorplan.operators.reports import orphan_files
from mirrorplan.sources import files, ingest, state
from mirrorplan.streaming import feeds


def raw(spark, *bodies):
    rows = [("1", k, b if isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "account_id string, page int, payload string")


def test_clip_shapes(spark):
    bodies = [
        {"id": "a", "title": 5, "status": None, "play_count": -3, "media_urls": "none", "clip_roots": {"clips": [{"id": "r", "user_handle": "h"}], "clip_attribution_type": "Remix"}},
        {"clip": {"id": "b", "metadata": {"history": ["h1", {"id": "h2", "infill": True, "continue_at": 2.5}], "stem_type_id": 91.5}}},
        {"clips": [{"id": "c", "metadata": {"stem_type_id": 91.0, "duration": "long"}}, {"id": ""}, {"title": "no id"}]},
        "not json",
        {"detail": "gone"},
        {"id": "d", "image_url": "https://old/x", "audio_url": "https://audiopipe/x", "batch_index": 3},
    ]
    got = {r.clip_id: r for r in ingest.decode_clips(raw(spark, *bodies), hosts={"https://old": "https://new"}).collect()}
    assert set(got) == set("abcd")
    assert (got["a"].title, got["a"].status, got["a"].play_count, got["a"].media_urls) == ("Untitled", "unknown", 0, [])
    assert got["a"].clip_roots[0].handle == "h" and got["a"].clip_attribution_type == "Remix"
    assert [(h.id, h.infill, h.continue_at) for h in got["b"].history] == [("h1", False, None), ("h2", True, 2.5)]
    assert got["b"].stem_type_id is None and got["c"].stem_type_id == 91 and got["c"].duration == 0
    assert got["d"].image_url == "https://new/x" and got["d"].audio_url.endswith("/d.mp3") and got["d"].batch_index == 3


def test_landed_pages_take_little_disk(spark, tmp_path):
    pages = states.feed_pages(spark, "/root/testdata/sf0.001")
    at = states.landed(spark, pages, str(tmp_path / "landing"))
    landed = spark.read.schema("account_id string, page int, payload string").json(at)
    want = sorted(map(tuple, pages.selectExpr("cast(account_id as string)", "cast(page as int)", "payload").collect()))
    assert sorted(map(tuple, landed.collect())) == want
    assert 4 * sum(f.stat().st_size for f in (tmp_path / "landing").iterdir()) < sum(len(p or "") for _, _, p in want)


def test_stems_and_lyrics(spark):
    page = {"pages": 2, "stems": [{"id": "s1", "title": "Song (Vocals)", "audio_url": "u1"}, {"id": "s2", "title": "x", "audio_url": "u1"}, {"id": "", "audio_url": "u3"}]}
    rows = raw(spark, page, [{"id": "s4", "title": "Song (a (b)", "audio_url": "u4"}]).selectExpr("account_id", "'c' as clip_id", "page", "payload")
    stems, status = ingest.decode_stems(rows)
    assert sorted((r.stem_id, r.label, r.url) for r in stems.collect()) == [("s1", "Vocals", "u1"), ("s4", "b", "u4")]
    assert [(r.complete, r.n_stems) for r in status.collect()] == [(True, 2)]
    assert [r.complete for r in ingest.decode_stems(rows.where("page = 0"))[1].collect()] == [False]
    body = {"aligned_words": [{"word": "la", "success": True, "start_s": 1, "p_align": 0.5}], "aligned_lyrics": [{"text": "la la", "start_s": 1.5, "words": [{"text": "la", "start_s": 2}]}, {"text": "[Chorus]"}]}
    lines, words = ingest.decode_aligned_lyrics(raw(spark, body, "{", {"aligned_words": 3}))
    assert [(r.line_no, r.text, r.start_s, len(r.words)) for r in lines.orderBy("line_no").collect()] == [(0, "la la", 1.5, 1), (1, "[Chorus]", 0.0, 0)]
    assert [(r.word, r.success, r.start_s) for r in words.collect()] == [("la", True, 1.0)]


def test_versions_of_state(spark, tmp_path):
    path, schema = f"{tmp_path}/manifest", "clip_id string, n int"
    assert state.read_state(spark, path, schema).count() == 0
    for k in (1, 2):
        df = state.read_state(spark, path, schema).union(spark.createDataFrame([(f"c{k}", k)], schema))
        assert state.write_state(df, path) == k
    assert sorted(map(tuple, state.read_state(spark, path, schema).collect())) == [("c1", 1), ("c2", 2)]
    current = next(p for p in (tmp_path / "manifest").iterdir() if p.name.startswith("v2"))
    for f in current.rglob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017
        state.read_state(spark, path, schema).collect()
    state.write_lineage({"nodes": spark.range(2), "edges": spark.range(3)}, f"{tmp_path}/lineage")
    assert {k: v.count() for k, v in state.read_lineage(spark, f"{tmp_path}/lineage", {"nodes": "id bigint", "edges": "id bigint", "roots": "id bigint"}).items()} == {"nodes": 2, "edges": 3, "roots": 0}
    last = state.stamp_runs(spark.createDataFrame([("1", 5), ("2", 6)], "account_id string, last_run bigint"), spark.createDataFrame([("2",), ("3",)], "account_id string"), 9)
    assert sorted(map(tuple, last.collect())) == [("1", 5), ("2", 9), ("3", 9)]
    rows = spark.createDataFrame([(str(k), k) for k in range(60)], "account_id string, n int")
    state.write_lineage({"nodes": rows}, f"{tmp_path}/buckets")
    some = state.read_lineage(spark, f"{tmp_path}/buckets", {"nodes": rows.schema}, ["7", "41", "none"])["nodes"]
    assert sorted(map(tuple, some.collect())) == [("41", 41), ("7", 7)] and some.columns == rows.columns
    assert state.read_lineage(spark, f"{tmp_path}/buckets", {"nodes": rows.schema})["nodes"].count() == 60
    packed = spark.createDataFrame([("verified:s:c",), ("verified-art:s:",), ("plain",)], "h string")
    assert [tuple(r) for r in packed.select(*(v.alias(k) for k, v in state.unpack_verified("h").items())).collect()] == [("s", "c"), ("s", ""), ("plain", None)]


def test_inventory_of_a_folder(spark, tmp_path):
    for name, data in {"a/x.MP3": b"123", "a/y.flac": b"1", "a/empty.mp3": b"", "b.jpg": b"pic", "c/z.txt": b"text"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = state.scan_inventory(spark, str(tmp_path), "1")
    rows = {r.path: (r.size, r.content_hash is None) for r in found.collect()}
    assert rows == {"a/x.MP3": (3, True), "a/y.flac": (1, True), "a/empty.mp3": (0, True), "b.jpg": (3, False), "c/z.txt": (4, False)}
    recorded = spark.createDataFrame([("1", "b.jpg"), ("1", "lost.mp3")], "account_id string, path string")
    assert {(r.path, r.exists, r.size) for r in state.probe(recorded, found).collect()} == {("b.jpg", True, 3), ("lost.mp3", False, 0)}
    m = spark.createDataFrame([("1", "A/X.mp3")], "account_id string, path string")
    assert sorted(r.path for r in orphan_files(found, m, m.limit(0)).collect()) == ["a/empty.mp3", "a/y.flac"]


def test_unreadable_is_not_missing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/good.txt").write_bytes(b"text")
    (tmp_path / "in/bad.txt").write_bytes(b"kept from us")
    (tmp_path / "in/.bad.txt.crc").write_bytes(b"crc\0\0\0\2\0\0\0\0\0\0")  # a checksum that does not fit: the read fails
    found = state.scan_inventory(spark, str(tmp_path / "in"), "1")
    recorded = spark.createDataFrame([("1", p) for p in ("good.txt", "bad.txt", "lost.txt")], "account_id string, path string")
    got = {r.path: (r.exists, r.unreadable, r.content_hash is None) for r in state.probe(recorded, found).collect()}
    assert got == {"good.txt": (True, False, False), "bad.txt": (True, True, True), "lost.txt": (False, False, True)}


def test_large_empty_and_odd_files(spark, tmp_path):
    """3 GB of which nothing is on disk, empty files, names that Spark passes over or takes for patterns; by rows and by ranges."""
    root = tmp_path / "a [1] {b}%20*"
    names = {"x y/\u00e9 #1?.txt": b"odd", "_first.txt": b"under", "_d/e/f.jpg": b"deep", "none.txt": b"", "_none.lrc": b"", ".hidden": b"no", "plain.txt": b"p" * 70_000}
    for name, data in names.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "gone.txt").symlink_to(root / "nowhere")
    with open(root / "big.bin", "wb") as f:
        f.truncate(3 << 30)
    want, big = {n: hashlib.sha256(d).hexdigest() for n, d in names.items() if n != ".hidden"}, hashlib.sha256()
    for _ in range(3 << 4):
        big.update(bytes(1 << 26))
    found = state.scan_inventory(spark, str(root), "1").collect()
    assert {r.path: r.content_hash for r in found} == want | {"big.bin": big.hexdigest()}
    assert {r.path: r["size"] for r in found} == {n: len(names[n]) for n in want} | {"big.bin": 3 << 30} and not any(r.unreadable for r in found)
    (root / "big.bin").unlink()
    uri = files.folder_uri(spark, str(root))
    for whole in (0, 10, 1 << 20):
        got = files.content_hashes(spark, uri, files.list_files(spark, uri), whole, 7).collect()
        assert {r.path: r.content_hash for r in got} == want
    gone = spark.createDataFrame([("lost.txt", 1), ("lost.bin", 1 << 40)], "path string, size bigint")
    assert {tuple(r) for r in files.content_hashes(spark, uri, gone).collect()} == {("lost.txt", None), ("lost.bin", None)}
    (tmp_path / "empty").mkdir()
    assert state.scan_inventory(spark, str(tmp_path / "empty"), "1").collect() == []
    for bad in (str(tmp_path / "none"), str(root / "plain.txt")):
        with pytest.raises(FileNotFoundError):
            state.scan_inventory(spark, bad, "1")


def test_streams(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()

    def land(name, at, *clips):
        (landing / name).write_text(json.dumps({"account_id": "1", "landed_at": at, "payload": json.dumps({"clips": list(clips)})}) + "\n")

    clip = lambda i, parent="": {"id": i, "title": f"t{i}", "status": "complete", "metadata": {"edited_clip_id": parent}}
    land("p1.json", "2026-01-01T00:00:00Z", clip("a"), clip("b", "a"))
    fold = lambda: feeds.stream_lineage(feeds.stream_feed(spark, str(landing)), f"{tmp_path}/state", f"{tmp_path}/c1").awaitTermination()
    fold()
    land("p2.json", "2026-01-01T01:00:00Z", clip("c", "b"), clip("a"))
    fold()
    fold()
    roots = {(r.clip_id, r.root_id, r.status) for r in feeds.read_lineage(spark, f"{tmp_path}/state")["roots"].collect()}
    assert roots == {("a", "a", "resolved"), ("b", "a", "resolved"), ("c", "a", "resolved")}
    nodes = {r.clip_id: (r.first_seen_at, r.last_seen_at) for r in feeds.read_lineage(spark, f"{tmp_path}/state")["nodes"].collect()}
    assert nodes == {"a": ("batch-0", "batch-1"), "b": ("batch-0", "batch-0"), "c": ("batch-1", "batch-1")}
    seen = feeds.stream_first_seen(feeds.stream_feed(spark, str(landing))).select("account_id", "clip_id", "landed_at")
    feeds.append_stream(seen, f"{tmp_path}/seen", f"{tmp_path}/c2").awaitTermination()
    assert sorted(r.clip_id for r in spark.read.parquet(f"{tmp_path}/seen").collect()) == ["a", "b", "c"]


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """Interleaved reads and writes: the one who publishes second is told, and nothing of its tables is seen."""
    path, schema = f"{tmp_path}/s", "n int"
    rows = lambda *ns: spark.createDataFrame([(n,) for n in ns], schema)
    one = state.write_state(rows(1), path, base=0)
    mine, theirs = state.current(spark, path), state.current(spark, path)
    assert state.write_state(state.read_state(spark, path, schema).union(rows(2)), path, base=theirs.number) == one + 1
    with pytest.raises(state.StaleState):
        state.write_state(rows(3), path, base=mine.number)
    with pytest.raises(state.StaleState):  # even if the check before was passed
        state.commit(spark, path, mine, {"table": rows(3)})
    assert sorted(r.n for r in state.read_state(spark, path, schema).collect()) == [1, 2]
    assert state.write_state(rows(4), path) == one + 2  # who read nothing follows what is there
    # a crash between two tables of a set leaves the old set
    at, tables = f"{tmp_path}/set", {"nodes": "n int", "edges": "n int"}
    state.write_lineage({"nodes": rows(1), "edges": rows(1)}, at)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        state.write_lineage({"nodes": rows(2), "edges": rows(2).selectExpr("CAST(n div 0 AS int) AS n")}, at)
    assert {k: [r.n for r in v.collect()] for k, v in state.read_lineage(spark, at, tables).items()} == {"nodes": [1], "edges": [1]}
    # and one before the pointer
    with monkeypatch.context() as m:
        m.setattr(state, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            state.write_lineage({"nodes": rows(2), "edges": rows(2)}, at)
    assert state.current(spark, at).number == 1
    (tmp_path / "set/versions/7").write_text("{")
    with pytest.raises(ValueError):
        state.current(spark, at)


def test_some_buckets_replaced(spark, tmp_path):
    rows = lambda ks, n: spark.createDataFrame([(str(k), n) for k in ks], "account_id string, n int")
    path = str(tmp_path)
    first = state.write_lineage({"t": rows(range(100), 0), "u": rows(range(3), 0)}, path)
    touched = state.buckets_of(rows([3, 5], 0))
    there = state.table(spark, path, first, "t", "account_id string, n int", touched)
    second = state.commit(spark, path, first, {"t": there.where("account_id <> '5'").selectExpr("account_id", "n + 1 AS n")}, ["t"], touched)
    got = {r.account_id: r.n for r in state.table(spark, path, second, "t", "account_id string, n int").collect()}
    same = {r.account_id for r in there.collect()}
    assert got == {str(k): int(str(k) in same) for k in range(100) if k != 5} and second.tables["u"] == first.tables["u"]
    assert sum(a != b for a, b in zip(sorted(first.tables["t"].items()), sorted(second.tables["t"].items()), strict=False)) <= len(touched) + 1


def test_walks_in_any_order(spark, tmp_path):
    """After each batch every walk is as the pages that chain by then make it; damaged pages hold it open."""
    path = str(tmp_path / "ledger")
    more = lambda *ids: json.dumps({"clips": [{"id": i, "status": "complete"} for i in ids], "has_more": True, "next_cursor": "c"})
    end = lambda status="complete": json.dumps({"clips": [{"id": "z", "status": status}], "has_more": False})
    batches = [
        [("1", None, 2, end()), ("1", None, 0, more("a")), ("2", "w", 0, end("queued")), ("3", "v", 0, "{"), ("3", "v", 1, end())],
        [("1", None, 1, '{"clips": ['), ("1", None, 1, "[]"), ("3", "v", 0, more("q")), ("4", None, 0, None)],
        [("1", None, 1, more("b")), ("2", "w", 0, end("queued"))],
        [("5", None, 1, end())],
    ]
    want = [
        {("1", ""): (False, False, 2, 0, None), ("2", "w"): (True, True, 1, 0, 0), ("3", "v"): (False, False, 1, 1, None)},
        {("1", ""): (False, False, 2, 1, None), ("2", "w"): (True, True, 1, 0, 0), ("3", "v"): (True, False, 2, 0, 1), ("4", ""): (False, False, 0, 1, None)},
        {("1", ""): (True, False, 3, 0, 2), ("2", "w"): (True, True, 1, 0, 0), ("3", "v"): (True, False, 2, 0, 1), ("4", ""): (False, False, 0, 1, None)},
        {("1", ""): (True, False, 3, 0, 2), ("2", "w"): (True, True, 1, 0, 0), ("3", "v"): (True, False, 2, 0, 1), ("4", ""): (False, False, 0, 1, None), ("5", ""): (False, False, 1, 0, None)},
    ]
    for number, rows in enumerate(batches):
        df = spark.createDataFrame([(a, w, p, None, x) for a, w, p, x in rows], feeds.PAGES).withColumn("landed_at", F.timestamp_seconds(F.lit(number)))
        for _ in range(2 if number == 1 else 1):  # the second batch is run twice
            feeds.fold_pages(df, path, number)
        assert {(r.account_id, r.walk): tuple(r)[2:] for r in feeds.read_ledger(spark, path)["walks"].collect()} == want[number], number
    rejects = feeds.read_ledger(spark, path)["rejects"]
    assert sorted((r.account_id, r.page, r.reason) for r in rejects.collect()) == [("1", 1, "no object"), ("1", 1, "not JSON"), ("3", 0, "not JSON"), ("4", 0, "not JSON")]


def test_batches_of_lineage_carry_only_what_is_folded(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    page = {"account_id": "a", "page": 0, "landed_at": "2024-01-01T00:00:00Z", "payload": json.dumps({"clips": [{"id": "x"}]})}
    (tmp_path / "in" / "one.json").write_text(json.dumps(page))
    seen = []
    monkeypatch.setattr(feeds, "fold_batch", lambda batch, path, number: seen.append(batch.columns))
    feeds.stream_lineage(feeds.stream_feed(spark, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "checkpoint")).awaitTermination()
    assert seen and "lyrics" not in seen[0] and set(seen[0]) == set(feeds.FOLDED)
