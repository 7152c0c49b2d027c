"""The planner against a plain model, and its invariants, on random small tables."""

import os
import random
import unicodedata

import pytest

import __spark_entry__ as entry
from mirrorplan import catalog, tables
from mirrorplan.plans import reconcile as r

from .measure import moved_bytes

DESIRED = "account_id string, clip_id string, ord int, path string, format string, meta_hash string, art_hash string, embedded_lyrics_hash string, embedded_timed_lyrics_hash string, lyrics_reencode_safe boolean, modes array<string>, trashed boolean, private boolean, stems_authoritative boolean"
SLOTS = "account_id string, clip_id string, ord int, kind string, key string, path string, source_url string, hash string, content string, stem_id string, format string"
MANIFEST = "account_id string, clip_id string, path string, format string, meta_hash string, art_source_hash string, art_content_hash string, embedded_lyrics_hash string, embedded_timed_lyrics_hash string, size bigint, preserve boolean"
M_SLOTS = "account_id string, clip_id string, kind string, key string, path string, source_hash string, content_hash string"
INVENTORY = "account_id string, path string, exists boolean, size bigint, content_hash string, unreadable boolean"
PATHS = ["a/one.mp3", "a/One.mp3", "b/café.mp3", unicodedata.normalize("NFD", "b/café.mp3"), "c/x.mp3", "d/y.mp3"]
fold = lambda p: "".join(c.lower() for c in unicodedata.normalize("NFC", p))


def world(seed, n_accounts):
    rnd = random.Random(seed)
    out = {k: [] for k in ("desired", "slots", "manifest", "m_slots", "inventory", "statuses")}
    for a in map(str, range(n_accounts)):
        for k in range(rnd.randrange(9)):
            c, p = f"c{rnd.randrange(8)}", rnd.choice(PATHS)
            modes = rnd.sample(["mirror", "copy"], rnd.choice([1, 1, 2]))
            out["desired"].append((a, c, k, p, rnd.choice(["mp3", "mp3", "flac"]), rnd.choice("mn"), rnd.choice(["", "x"]), "", "", rnd.random() < 0.8, modes, rnd.random() < 0.4, rnd.random() < 0.15, rnd.random() < 0.7))
            for kind in ("cover_jpg", "details_txt", "lyrics_txt"):
                if rnd.random() < 0.4:
                    out["slots"].append((a, c, k, kind, "", p[:-4] + "." + kind, "" if kind != "cover_jpg" else "u", rnd.choice("hi"), "t" if kind == "details_txt" else None, "", ""))
            if rnd.random() < 0.4:
                out["slots"].append((a, c, k, "stem", rnd.choice("st"), p[:-4] + ".stems/s.mp3", "u", rnd.choice("hi"), None, "", "mp3"))
        for c in rnd.sample([f"c{i}" for i in range(8)], rnd.randrange(8)):
            p = rnd.choice([*PATHS, ""])
            out["manifest"].append((a, c, p, "mp3", rnd.choice("mn"), rnd.choice(["", "x"]), None, "", "", 100, rnd.random() < 0.2))
            for kind, key in (("cover_jpg", ""), ("cover_webp", ""), ("details_txt", ""), ("stem", "s"), ("stem", "q")):
                if rnd.random() < 0.35:
                    out["m_slots"].append((a, c, kind, key, (p[:-4] or "z" + c) + (".stems/s.mp3" if kind == "stem" else "." + kind), rnd.choice("hi"), rnd.choice([None, "k"])))
        for p in {x[2] for x in out["manifest"] if x[0] == a} | {x[4] for x in out["m_slots"] if x[0] == a}:
            if p and rnd.random() < 0.8:
                out["inventory"].append((a, p, rnd.random() < 0.9, rnd.choice([0, 100, 100, 100]), None, rnd.random() < 0.1))
        for _ in range(rnd.choice([0, 1, 1, 1, 2])):
            out["statuses"].append((a, rnd.choice(["mirror", "mirror", "copy"]), rnd.random() < 0.85))
    return out


def frames(spark, w):
    make = spark.createDataFrame
    accounts = make([(a,) for a in sorted({x[0] for k in w.values() for x in k} | {"0"})], "account_id string")
    tables = [make(w[k], s) for k, s in (("desired", DESIRED), ("slots", SLOTS), ("manifest", MANIFEST), ("m_slots", M_SLOTS), ("inventory", INVENTORY))]
    return [*tables, accounts, make(w["statuses"], "account_id string, mode string, fully_enumerated boolean")]


def plain_audio(w, a):
    """Audio actions of one account before any suppression: (clip, action, path)."""
    status = [x for x in w["statuses"] if x[0] == a]
    may = bool(status) and all(x[2] for x in status) and any(x[1] == "mirror" for x in status)
    m = {x[1]: x for x in w["manifest"] if x[0] == a}
    f = {x[1]: x for x in w["inventory"] if x[0] == a}
    merged = {}
    for d in (x for x in w["desired"] if x[0] == a):
        merged.setdefault(d[1], []).append(d)
    out = []
    for c, ds in merged.items():
        rep = min(ds, key=lambda d: (d[3], d[5], d[6], ["mp3", "flac"].index(d[4]), d[2]))
        private, trashed, copied = any(d[12] for d in ds), all(d[11] for d in ds), any("copy" in d[10] for d in ds)
        e = m.get(c)
        o = f.get(e[2]) if e else None
        if trashed and not private and not copied:
            out.append((c, "delete", e[2]) if may and e and e[2] and not e[10] else (c, "skip", None))
        elif not e or not o or not o[2] or o[3] == 0:
            out.append((c, "download", rep[3]))
        elif o[5]:
            out.append((c, "unverifiable", e[2]))
        elif rep[4] != e[3]:
            out.append((c, "reformat", rep[3]) if rep[9] else (c, "skip", None))
        else:
            retag = rep[5] != e[4] or rep[6] != e[5]
            if fold(rep[3]) != fold(e[2]):
                out.append((c, "rename", rep[3]))
                if retag:
                    out.append((c, "retag", rep[3]))
            else:
                out.append((c, "retag", e[2]) if retag else (c, "skip", None))
    for c, e in m.items():
        if c not in merged:
            out.append((c, "delete", e[2]) if may and e[2] and not e[10] else (c, "skip", None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_worlds(spark, seed):
    w = world(seed, 60)
    d, ds, m, ms, inv, accounts, st = frames(spark, w)
    inputs = r.plan_inputs(r.aggregate_desired(d), m, inv, r.deletion_allowed(accounts, st))
    audio = {}
    for x in r.plan_audio(inputs).unionByName(r.absent_actions(inputs)).collect():
        audio.setdefault(x.account_id, []).append((x.clip_id, x.action, x.path))
    names = [x.account_id for x in accounts.collect()]
    for a in names:
        assert sorted(audio.get(a, []), key=str) == plain_audio(w, a), a
    plan = [x.asDict() for x in r.order_plan(r.reconcile(d, ds, m, ms, inv, accounts, st)).collect()]
    again = r.order_plan(r.reconcile(d.orderBy("path"), ds.orderBy("hash"), m.orderBy("path"), ms, inv, accounts, st)).collect()
    assert sorted(map(str, plan)) == sorted(str(x.asDict()) for x in again)  # independent of the input's order
    for a in names:
        rows = [x for x in plan if x["account_id"] == a]
        assert sorted(x["seq"] for x in rows) == list(range(1, len(rows) + 1))
        known = {x[1]: x for x in w["manifest"] if x[0] == a}
        desired = {}
        for x in (x for x in w["desired"] if x[0] == a):
            desired.setdefault(x[1], []).append(x)
        status = [x for x in w["statuses"] if x[0] == a]
        may = bool(status) and all(x[2] for x in status) and any(x[1] == "mirror" for x in status)
        deletes = [x for x in rows if x["action"] in r.DELETES]
        audio_deletes = [x["clip_id"] for x in deletes if x["action"] == "delete"]
        assert may or not deletes
        assert len(audio_deletes) == len(set(audio_deletes)) and all(x["path"] for x in deletes)
        targets = {fold(x["path"]) for x in rows if x["action"] in (*r.WRITES, *r.MOVES)}
        for x in deletes:
            assert x["clip_id"] in known and not known[x["clip_id"]][10] and fold(x["path"]) not in targets
        for c in audio_deletes:
            assert all(x[11] and not x[12] and "copy" not in x[10] for x in desired.get(c, []))
        for c, e in known.items():  # an unprotected orphan goes on a clean run
            if may and c not in desired and e[2] and not e[10] and fold(e[2]) not in targets:
                assert c in audio_deletes


def test_runs_reach_a_fixed_point(spark):
    """Audio, sidecars, album art and playlists; a renamed playlist drops its old file, an album that is gone its art."""
    w = world(5, 1)
    paths = [f"lib/{k}.mp3" for k in range(6)]
    w["desired"] = [("0", f"c{k}", k, p, "mp3", "m", "x", "", "", True, ["mirror"], False, False, True) for k, p in enumerate(paths)]
    w["slots"] = [("0", f"c{k}", k, "cover_jpg", "", f"lib/{k}.jpg", "u", "h", None, "", "") for k in range(6)]
    w["statuses"] = [("0", "mirror", True)]
    d, ds, m, ms, inv, accounts, st = frames(spark, w)
    make = spark.createDataFrame
    art, lists = "account_id string, root_id string, kind string, path string, source_hash string, content_hash string", "account_id string, playlist_id string, name string, path string, hash string"
    album_want = make([("0", f"c{k}", "folder_jpg", f"lib/{k}/folder.jpg", "u", "h") for k in (0, 3)], "account_id string, root_id string, kind string, path string, source_url string, hash string")
    list_want = make([("0", f"p{k}", f"List {k}", f"List {k}.m3u8", "#", f"h{k}") for k in (1, 2)], "account_id string, playlist_id string, name string, path string, content string, hash string")
    albums = make([("0", "c0", "folder_jpg", "lib/0/folder.jpg", "old", None), ("0", "c9", "folder_jpg", "lib/9/folder.jpg", "h", "k")], art)
    playlists = make([("0", "p1", "Was", "Was.m3u8", "h1"), ("0", "p7", "Gone", "Gone.m3u8", "h7")], lists)
    inv = inv.union(make([("0", x, True, 9, None, False) for x in ("lib/0/folder.jpg", "lib/9/folder.jpg", "Was.m3u8", "Gone.m3u8")], INVENTORY))
    authority = make([("0", True, True)], "account_id string, library_authoritative boolean, playlists_enumerated boolean")
    actions, seen = None, []
    for _ in range(3):
        plan = r.order_plan(r.reconcile(d, ds, m, ms, inv, accounts, st, (album_want, albums), (list_want, playlists), authority))
        rows = [x.asDict() for x in plan.collect()]
        actions = {x["action"] for x in rows}
        seen.append({(x["clip_id"], x["action"], x["path"]) for x in rows if x["section"] > 1})
        out = make([("0", x["seq"], True, 100, x["hash"] if x["slot_kind"] == "playlist" else "k") for x in rows], "account_id string, seq int, ok boolean, size bigint, content_hash string")
        new = r.roll_forward(m, ms, d, make([tuple(x.values()) for x in rows], plan.schema), out, albums, playlists, list_want)
        m, ms, albums, playlists = (make(x.collect(), x.schema) for x in new)
        there = [("0", x.path, True, 100, None, False) for t in (m, ms, albums, playlists) for x in t.collect()]
        inv = make(there, INVENTORY)
    assert actions == {"skip"}
    assert {x.clip_id for x in m.collect()} == {f"c{k}" for k in range(6)}
    assert seen[0] == {
        ("c0", "write_artifact", "lib/0/folder.jpg"), ("c3", "write_artifact", "lib/3/folder.jpg"), ("c9", "delete_artifact", "lib/9/folder.jpg"), ("p1", "write_artifact", "List 1.m3u8"),
        ("p1", "delete_artifact", "Was.m3u8"), ("p2", "write_artifact", "List 2.m3u8"), ("p7", "delete_artifact", "Gone.m3u8"),
    }
    assert not seen[1] and not seen[2]
    assert {(x.root_id, x.source_hash) for x in albums.collect()} == {("c0", "h"), ("c3", "h")}
    assert {(x.playlist_id, x.name, x.path) for x in playlists.collect()} == {("p1", "List 1", "List 1.m3u8"), ("p2", "List 2", "List 2.m3u8")}


def test_failed_actions_do_not_advance_state(spark):
    d, ds, m, ms, inv, accounts, st = frames(spark, world(3, 20))
    plan = r.order_plan(r.reconcile(d, ds, m, ms, inv, accounts, st))
    failed = plan.selectExpr("account_id", "seq", "false as ok", "1L as size", "'k' as content_hash")
    m2, ms2 = r.roll_forward(m, ms, d, plan, failed)
    key = ["account_id", "clip_id", "path", "meta_hash", "size"]
    assert sorted(map(str, m2.select(key).collect())) == sorted(map(str, m.select(key).collect()))
    assert ms2.count() == ms.join(m, ["account_id", "clip_id"], "left_semi").count()


def test_keys_are_made_once_and_steps_are_dropped(spark, monkeypatch):
    """Landed keys are taken as they are; without them three tables are keyed; only two tables are left in the shared folder."""
    d, ds, m, ms, inv, accounts, st = frames(spark, world(4, 30))
    made, left, keyed = r.written, [], []
    monkeypatch.setattr(r, "written", lambda df, name: left.append((name, made(df, name))) or left[-1][1])
    key = r.canonical_path_key
    monkeypatch.setattr(r, "canonical_path_key", lambda x: keyed.append(x) or key(x))
    plan = sorted(map(str, r.reconcile(d, ds, m, ms, inv, accounts, st).collect()))
    assert len(keyed) == 4 and [n for n, df in left if os.path.exists(df.inputFiles()[0].removeprefix("file:"))] == ["plan", "holders"]
    keyed.clear()
    landed = [r.with_pathkey(x) for x in (d, ds, m, ms)]
    keyed.clear()
    assert sorted(map(str, r.reconcile(*landed, inv, accounts, st).collect())) == plan and not keyed
    empty = [x.limit(0) for x in (d, ds, m, ms, inv)]
    assert r.reconcile(*empty, accounts, st).collect() == []


def test_slots_in_passes_are_the_same_plan(spark, monkeypatch):
    d, ds, m, ms, inv, accounts, st = frames(spark, world(9, 30))
    rows = lambda df: sorted(map(str, df.select(*r.PLAN).collect()))
    want = rows(r.reconcile(d, ds, m, ms, inv, accounts, st))
    made, left = r.written, []
    monkeypatch.setattr(r, "written", lambda df, name: left.append(name) or made(df, name))
    monkeypatch.setattr(r, "CLIPS_AT_ONCE", 8)
    got = r.reconcile(d, ds, m, ms, inv, accounts, st)
    assert rows(got) == want and left.count("plan") > 2


def test_an_ordered_plan_drops_its_rows(spark):
    """Of the plan's own tables only the numbered ranges are left."""
    root = tables.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    ordered = catalog.plan.whole_plan(spark, "/root/testdata/sf0.001")
    assert sorted(x.split("-")[0] for x in set(os.listdir(root)) - before) == ["clips", "ranges"]
    assert ordered.count() == ordered.select("account_id", "seq").distinct().count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 25 and all(x.total > 0 for x in rows)


def test_paths_met_by_one_clip_alone_skip_the_two_steps(spark):
    rnd = random.Random(7)
    for _ in range(3):
        clips = [f"c{k}" for k in range(40)]
        path = lambda: rnd.choice(["", "P/\u00e9", "P/E\u0301", *(f"d/{k}" for k in range(60))])
        recorded = [("a", c, path()) for c in clips for _ in range(2)]
        rows = []
        for n, c in enumerate(clips * 2):
            action = rnd.choice(["download", "rename", "delete", "skip", "write_artifact", "retag", "move_stem", "delete_artifact"])
            row = dict.fromkeys(r.PLAN) | {"account_id": "a", "section": 0, "clip_id": c, "step": n, "slot_kind": "", "slot_key": "", "action": action}
            rows.append(tuple((row | {"path": None if action == "skip" else path(), "from_path": path() if action in ("rename", "move_stem") else None})[k] for k in r.PLAN))
        made = spark.createDataFrame(rows, ", ".join(f"{k} {'int' if k in ('section', 'step') else 'string'}" for k in r.PLAN))
        held = spark.createDataFrame(recorded, "account_id string, clip_id string, path string")
        want = r.suppress_path_aliasing(r.suppress_target_clobber(made, held, held))
        got = r.suppressed(r.keyed(made), r.with_pathkey(held).select("account_id", "clip_id", "pathkey"))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_roll_forward_moves_few_bytes(spark):
    before = moved_bytes(spark)
    n = entry.queries()["h14_roll_forward"](spark, "/root/testdata/sf0.01").count()
    assert n and moved_bytes(spark) - before < 60_000_000  # 15000 clips


def test_slots_meet_like_in_joins(spark):
    """Rows that are there twice, keys that are null and accounts that are unknown, as a full outer join and a join to the clips have them."""
    rnd = random.Random(11)
    some = lambda n, *more: [(rnd.choice(["a", "b", None]), rnd.choice(["c1", "c2", "c3"]), *(f() for f in more)) for _ in range(n)]
    kind, key, ord_, text = (lambda: rnd.choice(["cover_jpg", "stem", None])), (lambda: rnd.choice(["", "s", None])), (lambda: rnd.choice([1, 1, 2])), (lambda: rnd.choice(["P/x.mp3", "q/É.mp3", "", None]))
    w = spark.createDataFrame([(*x, None, None) for x in some(200, ord_, kind, key, text, text, text)], "account_id string, clip_id string, ord int, kind string, key string, path string, source_url string, hash string, content string, format string")
    s = spark.createDataFrame(some(200, kind, key, text, text, text), M_SLOTS)
    # one ord to a clip, though its row may be there twice
    c = [(a, c, n, can, True, False, "P/x.mp3", "p/x.mp3", "mp3", False, False, True) for a, c, n in (("a", "c1", 1), ("a", "c2", 2), ("b", "c3", 1), (None, "c1", 1)) for can in rnd.choice([(True,), (True, False), (True, True)])]
    c = spark.createDataFrame(c, "account_id string, clip_id string, d_ord int, can_delete boolean, m boolean, m_preserve boolean, d_path string, d_pathkey string, d_format string, d_trashed boolean, protected_now boolean, d_stems_authoritative boolean")
    keys = ["account_id", "clip_id", "kind", "key"]
    current = w.join(c.selectExpr("account_id", "clip_id", "d_ord as ord"), ["account_id", "clip_id", "ord"], "left_semi").drop("ord")
    pairs = current.selectExpr(*keys, "path as w_path", "true as w").join(s.selectExpr(*keys, "path as s_path", "true as s"), keys, "full_outer").join(c.selectExpr("account_id", "clip_id", "can_delete"), ["account_id", "clip_id"])
    want = sorted(map(repr, pairs.select(*keys, "w", "w_path", "s", "s_path", "can_delete").collect()))
    got = r.clip_slots(w, s, c).selectExpr(*keys, "if(w is null, null, true) as w", "w.path as w_path", "if(s is null, null, true) as s", "s.path as s_path", "c.may as can_delete")
    assert sorted(map(repr, got.collect())) == want and len(want) > 60


def test_files_listed_twice(spark):
    files = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("a", "y"), ("b", "z")], "account_id string, path string")
    assert [tuple(x) for x in r.repeated_files(files).collect()] == [("a", "x")] * 2
    assert r.repeated_files(files.where("account_id = 'b'")).collect() == []


def test_slots_move_few_rows(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        before = moved_bytes(spark)
        n = entry.queries()["h08_h09_plan_slots_and_stems"](spark, "/root/testdata/sf0.01").count()
        moved = moved_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert n and moved < 16_000_000, moved  # 15000 clips
