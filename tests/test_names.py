import unicodedata

from pyspark.sql import functions as F

from mirrorplan.functions import naming


def test_whole_library_names(spark):
    nfd = unicodedata.normalize("NFD", "Café")
    rows = [  # id, title, root title, root id, track
        ("gggggggg-1", "Song", "Song", "gggggggg-1", 0), ("GGGGGGGG-2", "Song", "Song", "GGGGGGGG-2", 0), ("aaaaaaaa-1", "Café", "X", "rrrrrrrr-9", 3), ("AAAAAAAA-1x", nfd, "X", "rrrrrrrr-9", 3),
        ("bbbbbbbb-1", "untitled", "", "bbbbbbbb-1", 0), ("cccccccc-1", "a/b: c?", "Shared", "ssssssss-1", 12), ("dddddddd-1", "CON", "Shared", "tttttttt-1", 0),
    ]
    clips = spark.createDataFrame([("1", i, t, rt, r, n, "Ann", "ann") for i, t, rt, r, n in rows], "account_id string, clip_id string, title string, root_title string, root_id string, track int, display_name string, handle string")
    titles = spark.createDataFrame([("1", "Shared")], "account_id string, title string")
    ids = naming.colliding_clip_ids(clips.where("clip_id like 'g%' or clip_id like 'G%'"))
    got = {r.clip_id: r.path for r in naming.render_names(clips, titles, ids).collect()}
    # shared short ids get the whole id; the two spellings of one name are told apart by it too
    assert got["gggggggg-1"] == "Ann/Song/Ann-Song [gggggggg] [gggggggg-1]" and got["GGGGGGGG-2"] == "Ann/Song/Ann-Song [GGGGGGGG] [GGGGGGGG-2]"
    assert got["aaaaaaaa-1"] == "Ann/X/03 - Ann-Café [aaaaaaaa] [aaaaaaaa-1]" and got["AAAAAAAA-1x"].endswith("[AAAAAAAA] [AAAAAAAA-1x]")
    assert got["bbbbbbbb-1"] == "Ann/Untitled/Ann-Untitled [bbbbbbbb]"
    assert got["cccccccc-1"] == "Ann/Shared [ssssssss]/12 - Ann-a b c [cccccccc]" and got["dddddddd-1"] == "Ann/Shared [tttttttt]/Ann-CON_ [dddddddd]"
    assert len(set(got.values())) == len(rows)
    # a clip's name does not change when the batch is smaller, but for the passes over one batch
    part = {r.clip_id: r.path for r in naming.render_names(clips.where("clip_id not like 'a%' and clip_id not like 'A%'"), titles, ids).collect()}
    assert part == {k: v for k, v in got.items() if k in part}


def test_path_keys_by_characters(spark):
    """Every letter and mark there is, alone and after others, as one character at a time gives them; nulls, NULs and final sigmas."""
    points = [chr(k) for k in range(0x20, 0x30000) if not 0xD800 <= k <= 0xDFFF]
    rows = ["".join(points[k : k + 97]) for k in range(0, len(points), 97)] + [c + "́x" for c in points[::53]] + ["ΟΔΟΣ/ΟΔΟΣ.mp3", "İI", "a\0É\0", "", None, "é/É"]
    for batch in (rows, [None, "ascii/Only"], [r for r in rows if r is None or "\0" not in r]):
        got = spark.createDataFrame([(r,) for r in batch], "p string").select("p", naming.canonical_path_key("p").alias("k")).collect()
        assert all(r["k"] == (None if r["p"] is None else "".join(ch.lower() for ch in unicodedata.normalize("NFC", r["p"]))) for r in got)


def test_keys_put_together_from_parts(spark):
    """The keys of moved sidecars and stems are those of the whole paths, whatever letters and marks meet at the seams."""
    bases = ["a/Café", "a/Café", "İ/ΟΔΟΣ", "x/가", "k/K̸", "", "e.MP3", "z/á.Stems/B"]
    olds = ["q/É.stems/ s.mp3", "q/É.stems/́é.MP3", "q.stems/w.STEMS/İ/x̸.mp3", "q.stems/a.stems/b.mp3", "q.STEMS/n.mp3", "none.mp3", "", None, ";.stems/;/Å"]
    rows = [(f"{b}.{x}", x, o) for b in bases for x in ("mp3", "MP3", "flac") for o in olds] + [("odd.wav", "mp3", "q.stems/a.mp3")]
    df = spark.createDataFrame(rows, "path string, format string, old string").withColumn("base", naming.audio_base("path", "format"))
    df = df.withColumns({"key": naming.canonical_path_key("path"), "old_key": naming.canonical_path_key("old"), "moved": naming.relocated_stem_path("base", "old"), "healed": F.concat("base", F.lit(".details.txt"))})
    base_key = F.when(F.col("base").isNotNull(), naming.audio_base("key", F.lower("format")))
    df = df.withColumns({"moved_key": naming.relocated_stem_key(base_key, "old", "old_key"), "healed_key": F.concat(base_key, F.lit(".details.txt"))})
    fold = lambda p: None if p is None else "".join(ch.lower() for ch in unicodedata.normalize("NFC", p))
    for r in df.collect():
        assert (r["moved_key"], r["healed_key"]) == (fold(r["moved"]), fold(r["healed"])), r
