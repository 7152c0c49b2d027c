"""The planner: from what is wanted, what was recorded and what is there to one table of actions.

Nothing is fetched, changed or removed here; the plan is data. Tables (all with account_id):

desired         clip_id, ord, path, format, meta_hash, art_hash, embedded_lyrics_hash, embedded_timed_lyrics_hash,
                lyrics_reencode_safe, modes array<string>, trashed, private, stems_authoritative
desired_slots   clip_id, ord (of its desired row), kind, key ('' unless kind is 'stem'), path, source_url, hash, content, stem_id, format
manifest        clip_id, path, format, meta_hash, art_source_hash, art_content_hash, embedded_lyrics_hash,
                embedded_timed_lyrics_hash, size, preserve
manifest_slots  clip_id, kind, key, path, source_hash, content_hash
inventory       path, exists, size, content_hash, unreadable; and, if files were looked into, observed boolean, tags_differ,
                lyrics_hash, n_lyrics, timed_hash, timed_fits, cover_hash

Plan rows: account_id, section, clip_id, step, slot_kind, slot_key, action, path, from_path, source_url, hash, content,
format, from_format, reason. Their order is (section, clip_id, step, slot_kind, slot_key).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clips import content_hash
from ..functions.naming import SIDECARS, audio_base, canonical_path_key, relocated_stem_key, relocated_stem_path
from ..operators.authority import deletion_allowed
from ..tables import discard, numbered, written

# Format order for ties, kinds that a run may delete when they are switched off, kind order.
FORMATS = ("mp3", "flac", "wav", "alac")
REMOVABLE = ("cover_webp", "details_txt")
KINDS = ("cover_jpg", "cover_webp", "details_txt", "lyrics_txt", "lrc", "video_mp4", "stem")
WRITES = ("download", "reformat", "write_artifact", "write_stem")
MOVES = ("rename", "move_artifact", "move_stem")
DELETES = ("delete", "delete_artifact", "delete_stem")
CLIP = ["account_id", "clip_id"]
# Slots of more clips are planned in several passes, so that what one of them shuffles stays a part of the tables.
CLIPS_AT_ONCE = 16_000_000
# Where the key of each path lies, for plans that carry the keys of their paths.
_KEYS = {"d_path": "d_pathkey", "m_path": "m_pathkey", "w_path": "w_pathkey", "s_path": "s_pathkey", "_heal": "_healkey", "_moved": "_movedkey", "path": "pathkey"}
PLAN = ["account_id", "section", "clip_id", "step", "slot_kind", "slot_key", "action", "path", "from_path", "source_url", "hash", "content", "format", "from_format", "reason"]


def _row(action: Column | str, step: int = 0, **fields: Column | str) -> Column:
    """One plan row as a struct, with the keys of its paths; what is not given is null, slot fields ''. Paths are given by name."""
    null = F.lit(None).cast("string")
    base = {"slot_kind": F.lit(""), "slot_key": F.lit(""), **{k: null for k in PLAN[7:]}}
    values = base | {k: F.col(v) if isinstance(v, str) else v for k, v in fields.items()}
    values |= {key: F.col(_KEYS[fields[at]]) if at in fields else null for key, at in (("_key", "path"), ("_from", "from_path"))}
    return F.struct(F.lit(step).alias("step"), (F.lit(action) if isinstance(action, str) else action).alias("action"), *(v.cast("string").alias(k) for k, v in values.items()))


def _exploded(rows: DataFrame, section: int, actions: Column, keys: bool) -> DataFrame:
    return _flat(rows.select("account_id", F.lit(section).alias("section"), "clip_id", F.explode(F.array_compact(actions)).alias("a")), keys)


def _flat(rows: DataFrame, keys: bool) -> DataFrame:
    """Plan rows from their structs. keys: with _key and _from, as keyed() gives them."""
    carried = (F.coalesce(f"a.{k}", _no_path()).alias(k) for k in ("_key", "_from") if keys)
    return rows.select("account_id", "section", "clip_id", *(F.col(f"a.{x}") for x in PLAN[3:]), *carried)


def with_pathkey(df: DataFrame) -> DataFrame:
    """df with pathkey, the canonical key of its path, unless it was landed with one."""
    return df if "pathkey" in df.columns else df.withColumn("pathkey", canonical_path_key("path"))


def aggregate_desired(desired: DataFrame) -> DataFrame:
    """One row per clip: private if any row is, trashed if all are, modes of all; the rest from the row that is
    least by path, meta hash, art hash and format, then first by ord."""
    rank = F.array_position(F.array(*map(F.lit, FORMATS)), F.col("format"))
    rest = [c for c in desired.columns if c not in ("account_id", "clip_id", "private", "trashed", "modes")]
    first = ("path", "meta_hash", "art_hash", "ord")
    has = lambda m: F.when(F.bool_or(F.array_contains("modes", m)), F.lit(m))
    rows = desired.repartition(*CLIP).groupBy(*CLIP).agg(  # few clips have several rows: dealt as they are, they are sorted once
        F.bool_or("private").alias("private"), F.bool_and("trashed").alias("trashed"), F.array_compact(F.array(has("mirror"), has("copy"))).alias("modes"),
        F.min(F.struct("path", "meta_hash", "art_hash", rank.alias("_rank"), "ord", *(c for c in rest if c not in first))).alias("d"),
    )
    return rows.select(*CLIP, "private", "trashed", "modes", *(f"d.{c}" for c in rest))


def plan_inputs(desired: DataFrame, manifest: DataFrame, inventory: DataFrame, gate: DataFrame, lean: bool = False) -> DataFrame:
    """Desired and recorded rows of each clip side by side (d_*, m_*), with the keys of their paths and the file at the recorded path (f_*).

    lean: only what the planner reads, with _state for the hashes that it is made from, before the files are looked up if it can be.
    """
    desired, manifest = with_pathkey(desired), with_pathkey(manifest)
    d = desired.select(*CLIP, F.lit(True).alias("d"), *(F.col(c).alias(f"d_{c}") for c in desired.columns if c not in CLIP))
    m = manifest.select(*CLIP, F.lit(True).alias("m"), *(F.col(c).alias(f"m_{c}") for c in manifest.columns if c not in CLIP))
    f = inventory.select("account_id", F.col("path").alias("m_path"), F.lit(True).alias("f"), *(F.col(c).alias(f"f_{c}") for c in inventory.columns if c not in ("account_id", "path")))
    rows = d.join(m, CLIP, "full_outer")
    early = lean and "observed" not in inventory.columns
    rows = _beside(_lean(rows) if early else rows, f, "m_path").join(gate, "account_id", "left")
    rows = _lean(rows) if lean and not early else rows
    copy_held = F.coalesce(F.array_contains("d_modes", "copy"), F.lit(False))
    may_delete = F.coalesce(F.col("can_delete"), F.lit(False)) & F.coalesce((F.col("m_path") != "") & ~F.col("m_preserve"), F.lit(False))
    return rows.withColumns({"copy_held": copy_held, "may_delete": may_delete, "protected_now": F.coalesce("d_private", F.lit(False)) | copy_held})


def _lean(rows: DataFrame) -> DataFrame:
    """rows with _state; of the wanted and recorded columns only those that are read after it."""
    rows = rows.withColumn("_state", audio_state(rows))
    rows = rows.withColumn("d_meta_hash", F.when(F.col("_state") == "verify", F.col("d_meta_hash")))
    kept = {"d_ord", "d_path", "d_pathkey", "d_format", "d_meta_hash", "d_lyrics_reencode_safe", "d_modes", "d_trashed", "d_private", "d_stems_authoritative", "m_path", "m_pathkey", "m_format", "m_preserve"}
    return rows.drop(*(c for c in rows.columns if c[:2] in ("d_", "m_") and c not in kept))


def _beside(rows: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """rows with the file at their path. A null path gets a key of its own, so that such rows do not meet in one task."""
    rows = rows.withColumn("_at", F.coalesce(path, _no_path()))
    return rows.join(files.withColumnRenamed(path, "_at"), ["account_id", "_at"], "left").drop("_at")


def _no_path() -> Column:
    return F.concat(F.lit("\0"), "clip_id")


def audio_state(rows: DataFrame) -> Column:
    """retag, verify or current, for clips whose file is there in the wanted format."""
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    recorded = (
        differs("d_meta_hash", "m_meta_hash") | differs("d_art_hash", "m_art_source_hash") | differs("d_embedded_lyrics_hash", "m_embedded_lyrics_hash")
        | differs("d_embedded_timed_lyrics_hash", "m_embedded_timed_lyrics_hash")
    )
    unseen = F.when(recorded, "retag").otherwise("current")
    if "f_observed" not in rows.columns:
        return unseen
    no_lyrics = F.col("d_lyrics_blank")
    lyrics = no_lyrics & (F.col("d_embedded_lyrics_hash") != "") & ((F.col("f_n_lyrics") != 1) | differs("f_lyrics_hash", "d_embedded_lyrics_hash"))
    timed = (F.col("d_embedded_timed_lyrics_hash") != "") & ~F.coalesce(F.col("f_timed_fits") & (F.col("f_timed_hash") == F.col("d_embedded_timed_lyrics_hash")), F.lit(False))
    art = (
        F.when(F.col("d_art_hash") == "", F.col("f_cover_hash").isNotNull())
        .when(differs("m_art_source_hash", "d_art_hash"), True)
        .when(F.col("m_art_content_hash").isNull(), False)
        .when(F.col("f_cover_hash").isNull(), F.col("m_art_content_hash") != "")
        .otherwise(F.col("m_art_content_hash") != F.col("f_cover_hash"))
    )
    seen_lyrics = F.when(no_lyrics, F.coalesce("f_lyrics_hash", F.lit(""))).otherwise("")
    seen_art = F.when(F.col("d_art_hash") != "", F.coalesce("f_cover_hash", F.lit("")))
    stale = (
        differs("m_meta_hash", "d_meta_hash") | differs("m_art_source_hash", "d_art_hash") | ~F.col("m_art_content_hash").eqNullSafe(seen_art)
        | (F.col("m_embedded_lyrics_hash") != seen_lyrics) | (F.col("m_embedded_timed_lyrics_hash") != F.coalesce("f_timed_hash", F.lit("")))
    )
    seen = F.when(F.col("f_tags_differ") | lyrics | timed | art, "retag").when(stale, "verify").otherwise("current")
    return F.when(F.coalesce("f_observed", F.lit(False)), seen).otherwise(unseen)


def plan_audio(inputs: DataFrame, keys: bool = False) -> DataFrame:
    """Rows of every wanted clip's audio file (section 0)."""
    rows = (inputs if "_state" in inputs.columns else inputs.withColumn("_state", audio_state(inputs))).where("d")
    skip = _row("skip")
    download = _row("download", path="d_path", format="d_format")
    missing = F.col("f").isNull() | ~F.col("f_exists") | (F.col("f_size") == 0)
    moved = F.col("d_pathkey") != F.col("m_pathkey")
    verify = lambda step: _row("verify_audio", step, hash="d_meta_hash")
    second = F.when(F.col("_state") == "retag", _row("retag", 1, path="d_path")).when(F.col("_state") == "verify", verify(1))
    alone = F.when(F.col("_state") == "retag", _row("retag", path="m_path")).when(F.col("_state") == "verify", verify(0)).otherwise(skip)
    one = lambda x: F.array(x, F.lit(None))
    actions = (
        F.when(F.col("d_trashed") & ~F.col("d_private") & ~F.col("copy_held"), one(F.when(F.col("may_delete"), _row("delete", path="m_path")).otherwise(skip)))
        .when(F.col("m").isNull() | missing, one(download))
        .when(F.col("f_unreadable"), one(_row("unverifiable", path="m_path", reason=F.lit("could not read managed audio metadata"))))
        .when(F.col("d_format") != F.col("m_format"), one(F.when(~F.col("d_lyrics_reencode_safe"), skip).otherwise(_row("reformat", path="d_path", from_path="m_path", format="d_format", from_format="m_format"))))
        .when(moved, F.array(_row("rename", path="d_path", from_path="m_path"), second))
        .otherwise(one(alone))
    )
    return _exploded(rows, 0, actions, keys)


def absent_actions(inputs: DataFrame, keys: bool = False) -> DataFrame:
    """Recorded clips that are no longer wanted (section 1): deleted if they may be, else skipped."""
    return _exploded(inputs.where("d is null"), 1, F.array(F.when(F.col("may_delete"), _row("delete", path="m_path")).otherwise(_row("skip"))), keys)


def write_drift(expected: Column, differs: Column | None = None) -> Column:
    """write, verify or current for a slot: stored (s_*), wanted (w_*), the file at the stored path (f_*).

    s: whether anything is stored; expected: hash of the content that the file should have, or null. differs: whether hashes
    or keys of paths do, if that is known already.
    """
    differs = (F.col("s_source_hash") != F.col("w_hash")) | (F.col("s_pathkey") != F.col("w_pathkey")) if differs is None else differs
    known = F.coalesce(expected, F.col("s_content_hash"))
    actual = F.col("f_content_hash")
    return (
        F.when(F.col("s").isNull() | F.coalesce("f_unreadable", F.lit(False)), "write")
        .when(differs, "write")
        .when(F.col("f").isNull(), "current")
        .when(~F.col("f_exists") | (F.col("f_size") == 0), "write")
        .when(actual.isNotNull() & known.isNotNull() & (known != actual), "write")
        .when(actual.isNotNull() & (known.isNull() | F.col("s_content_hash").isNull()), "verify")
        .otherwise("current")
    )


def slot_inputs(wanted: DataFrame, stored: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted (w_*) and stored (s_*) slots side by side, with the keys of their paths and the file at the stored path."""
    wanted, stored = with_pathkey(wanted), with_pathkey(stored)
    w = wanted.select(*keys, F.lit(True).alias("w"), *(F.col(c).alias(f"w_{c}") for c in wanted.columns if c not in keys))
    s = stored.select(*keys, F.lit(True).alias("s"), *(F.col(c).alias(f"s_{c}") for c in stored.columns if c not in keys))
    f = inventory.select("account_id", F.col("path").alias("s_path"), F.lit(True).alias("f"), *(F.col(c).alias(f"f_{c}") for c in ("exists", "size", "content_hash", "unreadable")))
    s = s.withColumn("_at", F.coalesce("s_path", F.concat(F.lit("\0"), keys[1]))).join(f.withColumnRenamed("s_path", "_at"), ["account_id", "_at"], "left").drop("_at")
    return w.join(s, keys, "full_outer")


def _there() -> Column:
    return F.coalesce(F.col("f_exists") & (F.col("f_size") > 0), F.lit(False))


# What plan_slots needs to know of a clip, besides the ord of its desired row.
NEEDED = ["can_delete", "m", "m_preserve", "d_path", "d_pathkey", "d_format", "d_trashed", "protected_now", "d_stems_authoritative"]


def repeated_files(inventory: DataFrame) -> DataFrame:
    """The rows of an inventory on paths that it lists more than once, mostly none. Hashes are counted first."""
    hashed = F.xxhash64("account_id", "path").alias("_h")
    many = written(inventory.select(hashed).groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").select("_h"), "repeated")
    if many.isEmpty():
        discard(many)
        return inventory.limit(0)
    return inventory.withColumn("_h", hashed).join(many, "_h", "left_semi").drop("_h")


def clip_slots(wanted: DataFrame, stored: DataFrame, clips: DataFrame) -> DataFrame:
    """Wanted (w) and stored (s) slots of the clips side by side, with what is known of the clip (c), as structs.

    As a full outer join by (account_id, clip_id, kind, key), then a join to the clips. All three tables are dealt by clip
    once and sorted once; a clip's rows meet in a window, its slots in a narrower one of the same order. A hash leads the
    order, since accounts and clips begin alike.
    """
    key = F.when(F.col("pathkey") != F.col("path"), F.col("pathkey")).alias("pathkey")  # most paths are their own key
    w = with_pathkey(wanted).select(*CLIP, "kind", "key", F.struct("ord", "path", key, "source_url", "hash", "content", "format").alias("w"))
    s = with_pathkey(stored).select(*CLIP, "kind", "key", F.struct("path", key, "source_hash", "content_hash").alias("s"))
    base = audio_base("d_path", "d_format")
    base_key = F.when(base.isNotNull(), audio_base("d_pathkey", F.lower("d_format")))
    may = F.coalesce(F.col("can_delete") & F.col("m") & ~F.col("m_preserve"), F.lit(False))
    known = F.struct("d_ord", base.alias("base"), base_key.alias("basekey"), (~F.col("d_trashed") & (base != "")).alias("led"), may.alias("may"), F.col("protected_now").alias("protected"), F.col("d_stems_authoritative").alias("listed"))
    rows = clips.select(*CLIP, F.lit("").alias("kind"), F.lit("").alias("key"), known.alias("c")).unionByName(w, True).unionByName(s, True)
    rows = rows.where("account_id is not null and clip_id is not null").repartition(*CLIP).withColumn("_h", F.xxhash64(*CLIP))
    clip, slot = Window.partitionBy("_h", *CLIP).orderBy("kind", "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.partitionBy("_h", *CLIP, "kind", "key")
    rows = rows.withColumn("_clips", F.collect_list("c").over(clip)).where("c is null and size(_clips) > 0 and (w is null or w.ord = _clips[0].d_ord)").drop("c")
    rows = rows.withColumns({"_stored": F.collect_list("s").over(slot), "_wanted": F.count("w").over(slot)})
    alone = F.col("kind").isNull() | F.col("key").isNull()
    rows = rows.where(F.col("w").isNotNull() | (F.col("_wanted") == 0) | alone)
    # mostly one pair: the clip's row and the slot's stored row, if there is one
    n, pairs = F.size("_clips"), F.size("_clips") * F.when(F.col("w").isNull() | alone, 1).otherwise(F.greatest(F.size("_stored"), F.lit(1)))
    rows = rows.select(*CLIP, "kind", "key", "w", "s", "_stored", "_clips", F.explode(F.when(pairs == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), pairs - 1))).alias("_n"))
    beside = F.when(F.col("w").isNull(), F.col("s")).when(~alone, F.get("_stored", F.floor(F.col("_n") / n).cast("int")))
    return rows.select(*CLIP, "kind", "key", "w", beside.alias("s"), F.get("_clips", F.col("_n") % n).alias("c"))


# What becomes of a slot: action, step and fields of its plan row.
_SLOT_ROWS = {
    "verify": ("verify_artifact", 10, {"path": "s_path", "hash": "w_hash", "content": "f_content_hash"}),
    "unresolved": ("unverifiable", 10, {"path": "w_path", "reason": F.lit}),
    "move": ("move_artifact", 10, {"path": "w_path", "from_path": "s_path", "source_url": "w_source_url", "hash": "w_hash"}),
    "write": ("write_artifact", 10, {"path": "w_path", "source_url": "w_source_url", "hash": "w_hash", "content": "w_content"}),
    "remove": ("delete_artifact", 11, {"path": "s_path"}),
    "heal": ("move_artifact", 12, {"path": "_heal", "from_path": "s_path", "source_url": "_none", "hash": "s_source_hash"}),
    "move stem": ("move_stem", 13, {"path": "w_path", "from_path": "s_path", "source_url": "w_source_url", "hash": "w_hash", "format": "w_format"}),
    "follow": ("move_stem", 13, {"path": "_moved", "from_path": "s_path", "source_url": "_none", "hash": "s_source_hash", "format": "_mp3"}),
    "write stem": ("write_stem", 13, {"path": "w_path", "source_url": "w_source_url", "hash": "w_hash", "format": "w_format"}),
    "remove stem": ("delete_stem", 14, {"path": "s_path"}),
}


def _by_slot(values: dict[str, Column]) -> Column:
    """One of the values by what becomes of the slot, else null."""
    found = F
    for what, value in values.items():
        found = found.when(F.col("_what") == what, value)
    return F.lit(None).cast("string") if found is F else found


def plan_slots(wanted: DataFrame, stored: DataFrame, inventory: DataFrame, clips: DataFrame, keys: bool = False) -> DataFrame:
    """Rows of the sidecars and stems of clips whose audio is kept (section 0, steps 10 to 13).

    wanted: slots by (account_id, clip_id, kind, key) and ord; those of other desired rows than the clip's do not count.
    clips: per clip, d_ord, can_delete, m, m_preserve, d_path, d_pathkey, d_format, d_trashed, protected_now, d_stems_authoritative.
    """
    col = F.col
    rows = clip_slots(wanted, stored, clips).withColumns({f"{x}_pathkey": F.coalesce(f"{x}.pathkey", f"{x}.path") for x in "ws"})
    w_key, s_key = col("w_pathkey"), col("s_pathkey")
    suffix = F.element_at(F.create_map(*[F.lit(x) for kv in SIDECARS.items() for x in kv]), col("kind"))
    is_stem, alone, may_delete = F.coalesce(col("kind") == "stem", F.lit(False)), col("w").isNull(), col("c.may") & F.coalesce(col("s.path") != "", F.lit(False))
    same, moved = col("s.source_hash") == col("w.hash"), s_key != w_key
    # a dot composes with nothing, so keys can be put together
    # exists() keeps this step out of whole-stage code, where all of it would be one method, too long to be compiled
    place = F.when(is_stem, relocated_stem_key("c.basekey", "s.path", s_key)).when(alone, F.concat("c.basekey", suffix))
    lost = F.exists(F.array(place), lambda k: s_key != k)
    removed = ~col("c.protected") & may_delete & (is_stem | col("kind").isin(*REMOVABLE))
    flags = {"_listed": col("c.listed"), "_same": same, "_elsewhere": moved, "_changed": col("s").isNull() | ~same | moved, "_removed": alone & removed, "_lost": col("c.led") & lost, "_stem": is_stem}
    rows = rows.select(
        *CLIP, "kind", "key", *(F.when(col(x).isNotNull(), True).alias(x) for x in "ws"), *(col(f"w.{k}").alias(f"w_{k}") for k in ("path", "source_url", "hash", "content", "format")),
        *(col(f"s.{k}").alias(f"s_{k}") for k in ("path", "source_hash", "content_hash")), "w_pathkey", "s_pathkey", col("c.base").alias("_base"), col("c.basekey").alias("_basekey"), *(v.alias(k) for k, v in flags.items()),
    )

    # files are looked up for those slots only that may have a row, whatever lies there
    rows = rows.where("if(_stem, if(_listed, w and _changed or _removed, s and _lost), w or _removed or _lost)")
    files = inventory.select("account_id", col("path").alias("_at"), F.lit(True).alias("f"), *(col(c).alias(f"f_{c}") for c in ("exists", "size", "content_hash", "unreadable")))
    hashed = F.xxhash64("account_id", "_at")
    rows = rows.withColumn("_at", F.coalesce("s_path", _no_path())).withColumn("_h", hashed).join(files.withColumn("_h", hashed), ["_h", "account_id", "_at"], "left")

    drift = write_drift(F.when(col("w_content").isNotNull(), content_hash("w_content")), ~col("_same") | col("_elsewhere"))
    unresolved = col("kind").isin("lrc", "lyrics_txt") & col("w_content").isNull() & (col("w_source_url") == "")
    relocated = col("_same") & col("_elsewhere") & col("s") & _there()
    write = F.when(unresolved, "unresolved").when(relocated & col("w_content").isNull(), "move").otherwise("write")
    side = F.when(col("w"), F.when(col("_drift") == "write", write).when(col("_drift") == "verify", "verify")).when(col("_removed"), "remove").when(col("_lost") & _there(), "heal")
    listed = F.when(col("w"), F.when(relocated, "move stem").otherwise("write stem")).otherwise("remove stem")
    stem = F.when(col("_listed"), listed).when(col("_lost") & _there(), "follow")  # an unknown listing only lets them follow the song
    rows = rows.withColumn("_drift", F.when(~col("_stem") & col("w"), drift)).withColumn("_what", F.explode(F.array(F.when(col("_stem"), stem).otherwise(side)))).where("_what is not null")

    healed = {"_heal": F.concat("_base", suffix), "_moved": relocated_stem_path("_base", "s_path"), "_none": F.lit(""), "_mp3": F.lit("mp3")}
    healed_keys = {"w_path": col("w_pathkey"), "s_path": col("s_pathkey"), "_heal": F.concat("_basekey", suffix), "_moved": relocated_stem_key("_basekey", "s_path", "s_pathkey")}
    value = lambda x: F.lit("lyrics content could not be resolved for repair") if x is F.lit else healed[x] if x in healed else col(x)
    field = lambda k, get=value: _by_slot({what: get(f[k]) for what, (_, _, f) in _SLOT_ROWS.items() if k in f})
    action, step = (_by_slot({what: F.lit(x[k]) for what, x in _SLOT_ROWS.items()}) for k in (0, 1))
    return rows.select(
        "account_id", F.lit(0).alias("section"), "clip_id", step.alias("step"), col("kind").alias("slot_kind"), col("key").alias("slot_key"), action.alias("action"), *(field(k).alias(k) for k in PLAN[7:]),
        *(F.coalesce(field(at, healed_keys.get), _no_path()).alias(k) for k, at in (("_key", "path"), ("_from", "from_path")) if keys),
    )


def co_deletes(audio: DataFrame, stored: DataFrame, keys: bool = False) -> DataFrame:
    """Deletes of all slots of the clips whose audio is deleted."""
    gone = audio.where("action = 'delete'").select(*CLIP, "section")
    rows = with_pathkey(stored).where("path <> ''").join(gone, CLIP).withColumns({"slot_kind": F.col("kind"), "slot_key": F.col("key"), "_stem": F.col("kind") == "stem"})
    row = _row(F.when(F.col("_stem"), "delete_stem").otherwise("delete_artifact"), 20, path="path", slot_kind="slot_kind", slot_key="slot_key")
    return _flat(rows.select("account_id", "section", "clip_id", row.alias("a")), keys)


def suppress_target_clobber(plan: DataFrame, manifest: DataFrame, manifest_slots: DataFrame) -> DataFrame:
    """A write or move onto a path that another clip holds becomes a skip, unless a delete of this plan frees it.

    A path is held by the clip with the smallest id that recorded it, whatever its case or composition.
    """
    return skip_clobbers(plan, path_holders(manifest, manifest_slots))


def path_holders(manifest: DataFrame, manifest_slots: DataFrame) -> DataFrame:
    """(account_id, _key, _holder): the clip that holds each recorded path."""
    paths = with_pathkey(manifest).select(*CLIP, "pathkey").union(with_pathkey(manifest_slots).select(*CLIP, "pathkey"))
    return paths.groupBy("account_id", F.col("pathkey").alias("_key")).agg(F.min("clip_id").alias("_holder"))


def skip_clobbers(plan: DataFrame, holders: DataFrame) -> DataFrame:
    """suppress_target_clobber with path_holders() at hand."""
    rows = keyed(plan)
    freed = rows.where(F.col("action").isin(*DELETES)).select("account_id", "_key", F.lit(True).alias("_freed")).distinct()
    rows = rows.join(holders, ["account_id", "_key"], "left").join(freed, ["account_id", "_key"], "left")
    rows = rows.join(holders.select("account_id", F.col("_key").alias("_from"), F.col("_holder").alias("_from_holder")), ["account_id", "_from"], "left")
    actor = F.when(F.col("action") == "rename", F.col("_from_holder")).otherwise(F.col("clip_id"))
    targets = F.col("action").isin(*WRITES, *MOVES)
    clash = targets & F.col("_freed").isNull() & F.col("_holder").isNotNull() & ~F.coalesce(F.col("_holder") == actor, F.lit(False))
    return _skipped(rows, clash, F.coalesce(actor, "_holder"), plan.columns)


def suppressed(plan: DataFrame, recorded: DataFrame) -> DataFrame:
    """skip_clobbers(), then suppress_path_aliasing(), on a plan that is read several times. recorded: (account_id, clip_id, pathkey).

    Most paths are met by one clip alone, and nothing changes there: hashes of paths and clips are counted first, and only
    rows on paths that several clips, or a delete and a write, may meet go through the two steps. Those are written as they
    become, so that recorded is not read any more.
    """
    hashed = lambda k: F.xxhash64("account_id", k)
    mark = lambda df, k, n: df.select(hashed(k).alias("_h"), F.xxhash64(*CLIP).alias("_c"), F.lit(n).alias("_kind"))
    rows = keyed(plan)
    aims, ends, renames = F.col("action").isin(*WRITES, *MOVES), F.col("action").isin(*DELETES), F.col("action") == "rename"
    marks = mark(recorded.where("pathkey is not null"), "pathkey", 1)
    of_plan = rows.where(aims | ends).select(*CLIP, F.explode(F.array(F.struct(F.col("_key").alias("k"), F.when(aims, 2).otherwise(4).alias("n")), F.when(renames, F.struct(F.col("_from").alias("k"), F.lit(8).alias("n"))))).alias("e"))
    marks = marks.unionByName(of_plan.where("e is not null").select(hashed("e.k").alias("_h"), F.xxhash64(*CLIP).alias("_c"), F.col("e.n").alias("_kind")))
    met = marks.groupBy("_h").agg(F.bit_or("_kind").alias("_k"), (F.min("_c") != F.max("_c")).alias("_many"))
    has = lambda n: F.col("_k").bitwiseAND(n) != 0
    contested = met.where((has(2) & has(4)) | (has(2) & has(1) & F.col("_many")) | (has(8) & (~has(1) | F.col("_many"))))
    contested = written(contested.select("_h"), "contested")
    odd = rows.where(renames).withColumn("_h", hashed("_from")).join(contested, "_h", "left_semi").select(hashed("_key").alias("_h"))
    keys = written(contested.union(odd).distinct(), "contested")
    rows = rows.withColumn("_h", hashed("_key"))
    part = written(rows.join(keys, "_h", "left_semi"), "contested")
    asked = keys.union(part.where(renames).select(hashed("_from"))).distinct()
    holders = recorded.withColumn("_h", hashed("pathkey")).join(asked, "_h", "left_semi").groupBy("account_id", F.col("pathkey").alias("_key")).agg(F.min("clip_id").alias("_holder"))
    settled = written(suppress_path_aliasing(skip_clobbers(part, holders)).select(*PLAN, "_h"), "holders")
    discard(contested, keys, part)
    rest = rows.join(settled.select("_h"), "_h", "left_anti")
    return rest.select(*PLAN).unionByName(settled.select(*PLAN))


def keyed(plan: DataFrame) -> DataFrame:
    """plan with the keys of its paths, _key and _from. Most rows of a plan are skips and have none: theirs are unlike
    any path's and spread by clip."""
    if "_key" in plan.columns:
        return plan
    key = lambda x: F.coalesce(canonical_path_key(x), _no_path())
    return plan.withColumns({"_key": key("path"), "_from": key("from_path")})


def suppress_path_aliasing(plan: DataFrame) -> DataFrame:
    """A delete on a path that the plan also writes or moves to becomes a skip."""
    rows = keyed(plan)
    targets = rows.where(F.col("action").isin(*WRITES, *MOVES)).select("account_id", "_key", F.lit(True).alias("_target")).distinct()
    rows = rows.join(targets, ["account_id", "_key"], "left")
    return _skipped(rows, F.col("action").isin(*DELETES) & F.col("_target").isNotNull(), F.col("clip_id"), plan.columns)


def _skipped(rows: DataFrame, where: Column, owner: Column, columns: list[str]) -> DataFrame:
    """rows with those turned into skips; the owner goes to reason, so the place in the order stays."""
    null = F.lit(None).cast("string")
    change = {"action": F.lit("skip"), "reason": F.concat(F.lit("path is taken; clip "), owner), **{k: null for k in PLAN[7:14]}}
    flag = rows.withColumn("_hit", where)
    return flag.select(*(F.when(F.col("_hit"), change[k]).otherwise(F.col(k)).alias(k) if k in change else k for k in columns))


def plan_albums(album_desired: DataFrame, album_art: DataFrame, inventory: DataFrame, gate: DataFrame, art_authority: DataFrame | None = None) -> DataFrame:
    """Album art rows (section 2) of (account_id, root_id, kind, path, source_url, hash) and stored art.

    art_authority (account_id, library_authoritative): also needed for deletes, if given.
    """
    keys = ["account_id", "root_id", "kind"]
    rows = slot_inputs(album_desired, album_art, inventory, keys).join(gate, "account_id", "left")
    may = F.coalesce("can_delete", F.lit(False))
    if art_authority is not None:
        rows = rows.join(art_authority.select("account_id", "library_authoritative"), "account_id", "left")
        may = may & F.coalesce("library_authoritative", F.lit(False))
    rows = rows.withColumns({"clip_id": F.col("root_id"), "slot_kind": F.col("kind")})
    drift = write_drift(F.lit(None).cast("string"))
    wanted = F.when(drift == "verify", _row("verify_artifact", path="s_path", hash="w_hash", content="f_content_hash", slot_kind="slot_kind")).when(
        drift == "write", _row("write_artifact", path="w_path", source_url="w_source_url", hash="w_hash", slot_kind="slot_kind")
    )
    gone = F.when(may & (F.col("s_path") != ""), _row("delete_artifact", path="s_path", slot_kind="slot_kind"))
    return _exploded(rows, 2, F.array(F.when(F.col("w"), wanted).otherwise(gone)), False)


def plan_playlists(playlist_desired: DataFrame, playlist_state: DataFrame, inventory: DataFrame, gate: DataFrame, listed: DataFrame) -> DataFrame:
    """Playlist rows (section 3) of (account_id, playlist_id, path, content, hash) and stored (path, hash).

    listed (account_id, playlists_enumerated) gates deletes besides can_delete. A rename deletes the old file.
    """
    keys = ["account_id", "playlist_id"]
    stored = playlist_state.select(*keys, "path", F.col("hash").alias("source_hash"), F.col("hash").alias("content_hash"))
    rows = slot_inputs(playlist_desired.select(*keys, "path", "content", "hash"), stored, inventory, keys).join(gate, "account_id", "left").join(listed.select("account_id", "playlists_enumerated"), "account_id", "left")
    rows = rows.withColumns({"clip_id": F.col("playlist_id"), "slot_kind": F.lit("playlist")})
    may = F.coalesce(F.col("can_delete") & F.col("playlists_enumerated"), F.lit(False)) & (F.col("s_path") != "")
    write = F.when(F.col("w") & (write_drift(F.col("w_hash")) == "write"), _row("write_artifact", 0, path="w_path", source_url=F.lit(""), hash="w_hash", content="w_content", slot_kind="slot_kind"))
    delete = F.when(may & (F.col("w").isNull() | (F.col("s_path") != F.col("w_path"))), _row("delete_artifact", 1, path="s_path", slot_kind="slot_kind"))
    return suppress_path_aliasing(_exploded(rows, 3, F.array(write, delete), True)).select(*PLAN)


def order_plan(plan: DataFrame) -> DataFrame:
    """The plan with seq, the place of each row in its account."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("slot_kind"))
    return numbered(plan, "account_id", ["section", "clip_id", "step", kind, "slot_kind", "slot_key", "action", "path"], "seq")


def reconcile(
    desired: DataFrame, desired_slots: DataFrame, manifest: DataFrame, manifest_slots: DataFrame, inventory: DataFrame, accounts: DataFrame, statuses: DataFrame,
    albums: tuple[DataFrame, DataFrame] | None = None, playlists: tuple[DataFrame, DataFrame] | None = None, authority: DataFrame | None = None,
) -> DataFrame:
    """The whole plan. albums and playlists: their desired and stored tables; authority: run_authority rows."""
    gate = deletion_allowed(accounts, statuses)
    recorded = with_pathkey(manifest_slots)
    if "pathkey" not in manifest_slots.columns:
        recorded = written(recorded, "slots")  # three readers below
    inputs = written(plan_inputs(aggregate_desired(with_pathkey(desired)), manifest, inventory, gate, lean=True), "inputs")  # five readers below
    audio = written(plan_audio(inputs, True).unionByName(absent_actions(inputs, True)), "audio")
    blocked = audio.where("action in ('delete', 'unverifiable')").select(*CLIP)
    kept = inputs.where("d").join(blocked, CLIP, "left_anti").select(*CLIP, "d_ord", *NEEDED)
    n = max(1, -(-inputs.count() // CLIPS_AT_ONCE))
    part = lambda df, k: df.where(F.pmod(F.xxhash64("clip_id"), F.lit(n)) == k) if n > 1 else df
    sides = (plan_slots(part(desired_slots, k), part(recorded, k), inventory, part(kept, k), True) for k in range(n))
    first = audio.unionByName(next(sides)).unionByName(co_deletes(audio, recorded, True))
    plan = reduce(DataFrame.unionByName, [written(rows, "plan") for rows in (first, *sides)])
    paths = inputs.where("m").select(*CLIP, F.col("m_pathkey").alias("pathkey")).union(recorded.select(*CLIP, "pathkey"))
    plan = suppressed(plan, paths)
    discard(inputs, audio, *([recorded] if recorded is not manifest_slots else []))
    if albums:
        plan = plan.unionByName(plan_albums(*albums, inventory, gate, authority))
    if playlists:
        plan = plan.unionByName(plan_playlists(*playlists, inventory, gate, authority))
    return plan


# --- what a finished run leaves ------------------------------------------------------------------


def roll_forward(
    manifest: DataFrame, manifest_slots: DataFrame, desired: DataFrame, plan: DataFrame, outcomes: DataFrame,
    album_art: DataFrame | None = None, playlist_state: DataFrame | None = None, playlist_desired: DataFrame | None = None,
) -> tuple[DataFrame, ...]:
    """Next manifest and slots from the plan's succeeded rows; and next album art and playlists, if those are given.

    outcomes: (account_id, seq, ok, size, content_hash) by the seq of an ordered plan. preserve becomes
    private or copy-held for every clip that is still wanted, also where the row was a skip.
    """
    merged = aggregate_desired(desired)
    plan = plan.where("action not in ('skip', 'unverifiable') or section = 3")  # the others change nothing
    done = plan.join(outcomes.where("ok").select("account_id", "seq", F.col("size").alias("_size"), F.col("content_hash").alias("_content")), ["account_id", "seq"])
    main = done.where("slot_kind = ''")
    per_clip = main.groupBy(*CLIP).agg(
        F.bool_or(F.col("action") == "delete").alias("_deleted"),
        F.max(F.when(F.col("action").isin("download", "reformat", "rename"), F.col("path"))).alias("_path"),
        F.max(F.when(F.col("action").isin("download", "reformat"), F.col("format"))).alias("_format"),
        F.max(F.when(F.col("action").isin("download", "reformat"), F.col("_size"))).alias("_new_size"),
        F.bool_or(F.col("action").isin("download", "reformat", "retag", "verify_audio")).alias("_tagged"),
    )
    hashes = {"meta_hash": "meta_hash", "art_source_hash": "art_hash", "embedded_lyrics_hash": "embedded_lyrics_hash", "embedded_timed_lyrics_hash": "embedded_timed_lyrics_hash"}
    want = merged.select(*CLIP, *(F.col(v).alias(f"_w_{k}") for k, v in hashes.items()), (F.col("private") | F.array_contains("modes", "copy")).alias("_preserve"))
    rows = manifest.join(per_clip, CLIP, "full_outer").join(want, CLIP, "left").where("not coalesce(_deleted, false) and (path is not null or _path is not null)")
    tagged = F.coalesce("_tagged", F.lit(False)) & F.col("_preserve").isNotNull()
    next_manifest = rows.select(
        *CLIP, F.coalesce("_path", "path").alias("path"), F.coalesce("_format", "format").alias("format"), *(F.when(tagged, F.col(f"_w_{k}")).otherwise(F.col(k)).alias(k) for k in hashes),
        "art_content_hash", F.coalesce("_new_size", "size").alias("size"), F.coalesce("_preserve", "preserve", F.lit(False)).alias("preserve"),
    )
    slot = [*CLIP, "kind", "key"]
    changed = done.where("slot_kind <> '' and section < 2 and action not in ('skip', 'unverifiable')").select(
        *CLIP, F.col("slot_kind").alias("kind"), F.col("slot_key").alias("key"), F.col("action").alias("_a"), F.col("path").alias("_path"), F.col("hash").alias("_hash"), "_content"
    )
    rows = manifest_slots.join(changed, slot, "full_outer").where(~F.coalesce(F.col("_a").isin(*DELETES), F.lit(False)))
    rows = rows.join(next_manifest.select(*CLIP), CLIP, "left_semi")
    wrote = F.col("_a").isin("write_artifact", "write_stem", "verify_artifact")
    next_slots = rows.select(
        *slot, F.coalesce("_path", "path").alias("path"), F.coalesce("_hash", "source_hash").alias("source_hash"), F.when(F.coalesce(wrote, F.lit(False)), F.col("_content")).otherwise(F.col("content_hash")).alias("content_hash")
    )
    found = [next_manifest, next_slots]
    if album_art is not None:
        found.append(_next_albums(album_art, done))
    if playlist_state is not None:
        found.append(_next_playlists(playlist_state, playlist_desired, done))
    return tuple(found)


def _next_albums(album_art: DataFrame, done: DataFrame) -> DataFrame:
    """Album art after the succeeded rows of section 2; what is deleted has no row any more."""
    keys = ["account_id", "root_id", "kind"]
    changed = done.where("section = 2 and action in ('write_artifact', 'verify_artifact', 'delete_artifact')").select(
        "account_id", F.col("clip_id").alias("root_id"), F.col("slot_kind").alias("kind"), F.col("action").alias("_a"), F.col("path").alias("_path"), F.col("hash").alias("_hash"), "_content"
    )
    rows = album_art.join(changed, keys, "full_outer").where(~F.coalesce(F.col("_a") == "delete_artifact", F.lit(False)))
    new = F.col("_a").isNotNull()
    take = lambda a, b: F.when(new, F.col(a)).otherwise(F.col(b)).alias(b)
    return rows.select(*keys, take("_path", "path"), take("_hash", "source_hash"), take("_content", "content_hash"))


def _next_playlists(state: DataFrame, desired: DataFrame, done: DataFrame) -> DataFrame:
    """Playlists after the succeeded rows of section 3: written ones as they are wanted now, deleted ones gone."""
    keys = ["account_id", "playlist_id"]
    per = done.where("section = 3").groupBy("account_id", F.col("clip_id").alias("playlist_id")).agg(
        F.max(F.when(F.col("action") == "write_artifact", F.struct("path", "hash"))).alias("_w"), F.bool_or(F.col("action") == "delete_artifact").alias("_d")
    )
    names = desired.select(*keys, F.col("name").alias("_name"))
    rows = state.select(*keys, "name", "path", "hash").join(per, keys, "full_outer").join(names, keys, "left").where("_w is not null or not coalesce(_d, false)")
    take = lambda a, b: F.when(F.col("_w").isNotNull(), F.col(a)).otherwise(F.col(b)).alias(b)
    return rows.select(*keys, take("_name", "name"), take("_w.path", "path"), take("_w.hash", "hash"))
