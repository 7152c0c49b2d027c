"""What a run wants on disk: files and sidecars of clips, stems, album art, playlists."""

from __future__ import annotations



import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clips as fn
from ..functions import naming

CLIP = ["account_id", "clip_id"]
LOSSLESS = ("flac", "wav", "alac")


def build_desired(clips: DataFrame, modes: DataFrame, names: DataFrame, format: str = "flac", animated: bool = False, webp: str = "q80") -> DataFrame:
    """Clips with lineage context (and ord) -> one desired row each; names: (account_id, clip_id, path without extension)."""
    rows = clips.join(modes, CLIP, "left").join(names.withColumnRenamed("path", "_base"), CLIP)
    return rows.select(
        *CLIP, "ord", F.concat("_base", F.lit("." + format)).alias("path"), F.lit(format).alias("format"), fn.meta_hash().alias("meta_hash"), fn.embedded_art_hash(animated, webp).alias("art_hash"),
        F.lit("").alias("embedded_lyrics_hash"), F.lit("").alias("embedded_timed_lyrics_hash"), F.lit(True).alias("lyrics_reencode_safe"),
        F.coalesce("modes", F.array().cast("array<string>")).alias("modes"), F.col("is_trashed").alias("trashed"), F.lit(False).alias("private"), F.lit(False).alias("stems_authoritative"),
    )


def desired_slots(clips: DataFrame, names: DataFrame, details: bool = True, lyrics: bool = True, lrc: bool = True, video: bool = True, version: str = "v1/line") -> DataFrame:
    """Sidecars of each clip: cover if there is art, details with their text, lyric files to be resolved, video if there is one."""
    slot = lambda kind, url, digest, content=None: F.struct(
        F.lit(kind).alias("kind"), F.lit("").alias("key"), F.concat("_base", F.lit(naming.SIDECARS[kind])).alias("path"), url.alias("source_url"), digest.alias("hash"),
        (F.lit(None).cast("string") if content is None else content).alias("content"), F.lit("").alias("stem_id"), F.lit("").alias("format"),
    )
    none, image = F.lit(""), fn.selected_image_url()
    slots = [F.when(image.isNotNull(), slot("cover_jpg", F.coalesce(image, none), fn.art_hash(image)))]
    if details:
        slots.append(slot("details_txt", none, fn.content_hash("_details"), F.col("_details")))
    if lyrics:
        slots.append(slot("lyrics_txt", none, fn.digest("lyrics-txt", F.lit(version), "clip_id")))
    if lrc:
        slots.append(slot("lrc", none, fn.digest("synced-lrc", F.lit(version), "clip_id")))
    if video:
        slots.append(F.when(F.col("video_url") != "", slot("video_mp4", F.col("video_url"), fn.art_hash("video_url"))))
    rows = clips.join(names.withColumnRenamed("path", "_base"), CLIP).withColumn("_details", fn.details_text())
    return rows.select(*CLIP, "ord", F.explode(F.array_compact(F.array(*slots))).alias("s")).select(*CLIP, "ord", "s.*")


def stem_targets(stems: DataFrame, format: str = "mp3", charset: str = "unicode") -> DataFrame:
    """(account_id, clip_id, pos, stem_id, label, url, base) -> slots of kind 'stem' with a unique key per clip.

    The key is the id, else the label, else 'stem<pos>'; repeats get -1, -2 and so on. A label that looks
    like such a number can still clash; only those clips go through a loop.
    """
    name = F.when(F.col("stem_id") != "", F.col("stem_id")).when(F.col("label") != "", F.col("label")).otherwise(F.concat(F.lit("stem"), F.col("pos").cast("string")))
    nth = F.row_number().over(Window.partitionBy(*CLIP, "_name").orderBy("pos")) - 1
    rows = stems.withColumn("_name", name).withColumn("_nth", nth).withColumn("key", F.when(F.col("_nth") == 0, F.col("_name")).otherwise(F.concat("_name", F.lit("-"), F.col("_nth").cast("string"))))
    clash = rows.groupBy(*CLIP).agg((F.count("*") > F.countDistinct("key")).alias("_clash"))
    rows = rows.join(clash, CLIP).drop("_nth")
    fields = rows.drop("_clash").schema

    def one_by_one(group: pd.DataFrame) -> pd.DataFrame:
        group, seen, keys = group.sort_values("pos"), set(), []
        for name in group["_name"]:
            key, n = name, 1
            while key in seen:
                key, n = f"{name}-{n}", n + 1
            seen.add(key)
            keys.append(key)
        return group.assign(key=keys)[fields.names]

    rows = rows.where("not _clash").drop("_clash").unionByName(rows.where("_clash").drop("_clash").groupBy(*CLIP).applyInPandas(one_by_one, fields))
    kind = F.when((F.col("stem_id") == "") & F.lit(format == "wav"), "mp3").otherwise(format)
    mark = F.when(F.col("stem_id") == "", F.col("key")).otherwise(F.col("stem_id"))
    return rows.select(
        *CLIP, F.lit("stem").alias("kind"), "key", naming.stem_file_path("base", "label", mark, kind, charset).alias("path"), F.col("url").alias("source_url"), fn.art_hash("url").alias("hash"), "stem_id", kind.alias("format")
    )


def stems_for(desired: DataFrame, clips: DataFrame, stem_status: DataFrame) -> DataFrame:
    """desired with stems_authoritative: the clip has stems and their listing is complete and not empty."""
    status = stem_status.select(*CLIP, (F.col("complete") & (F.col("n_stems") > 0)).alias("_listed"))
    has = clips.select(*CLIP, F.col("has_stem").alias("_has")).distinct()
    return desired.join(has, CLIP, "left").join(status, CLIP, "left").withColumn("stems_authoritative", F.coalesce(F.col("_has") & F.col("_listed"), F.lit(False))).drop("_has", "_listed")


def album_desired(desired: DataFrame, clips: DataFrame, animated: bool = True, raw_cover: bool = True, webp: str = "q80") -> DataFrame:
    """Folder art per root: (account_id, root_id, kind, path, source_url, hash).

    The still is that of the most played clip with art (then earliest, then smallest id), the preview that
    of the earliest clip with one; the folder is the smallest of the members'.
    """
    need = clips.select(*CLIP, "root_id", "play_count", "created_at", fn.selected_image_url().alias("_image"), F.col("video_cover_url").alias("_preview"))
    rows = desired.select(*CLIP, "path").join(need, CLIP)
    per_root = rows.groupBy("account_id", "root_id").agg(
        F.min(naming.parent_dir("path")).alias("_dir"),
        F.min_by("_image", F.when(F.col("_image").isNotNull(), F.struct(-F.col("play_count"), "created_at", "clip_id"))).alias("_image"),
        F.min_by("_preview", F.when(F.col("_preview") != "", F.struct("created_at", "clip_id"))).alias("_preview"),
    )
    preview = fn.present("_preview")
    art = lambda kind, name, url, digest: F.when(
        url.isNotNull(),
        F.struct(F.lit(kind).alias("kind"), F.when(F.col("_dir") == "", name).otherwise(F.concat("_dir", F.lit("/" + name))).alias("path"), url.alias("source_url"), digest.alias("hash")),
    )
    kinds = [art("folder_jpg", "folder.jpg", F.col("_image"), fn.art_hash("_image"))]
    if animated:
        kinds.append(art("folder_webp", "cover.webp", preview, fn.webp_art_hash("_preview", webp)))
    if raw_cover:
        kinds.append(art("folder_mp4", "cover.mp4", preview, fn.art_hash("_preview")))
    return per_root.select("account_id", "root_id", F.explode(F.array_compact(F.array(*kinds))).alias("a")).select("account_id", "root_id", "a.*")


def lossless_fallback(desired: DataFrame, manifest: DataFrame, inventory: DataFrame, access: DataFrame) -> DataFrame:
    """desired, where an account without access (account_id, available: false or null to leave alone) keeps a
    lossless file that is there and takes mp3 otherwise; old_path is the path before."""
    there = inventory.where("exists and size > 0").select("account_id", F.col("path").alias("_path"), F.lit(True).alias("_there")).distinct()
    m = manifest.select(*CLIP, F.col("format").alias("_format"), F.col("path").alias("_path"))
    rows = desired.join(m, CLIP, "left").join(there, ["account_id", "_path"], "left").join(access.select("account_id", "available"), "account_id", "left")
    applies = F.col("available").eqNullSafe(False) & F.col("format").isin(*LOSSLESS)
    keeps = F.col("_format").isin(*LOSSLESS) & F.coalesce("_there", F.lit(False))
    rows = rows.withColumn("_new", F.when(~applies, F.col("format")).when(keeps, F.col("_format")).otherwise("mp3"))
    moved = F.concat(F.coalesce(naming.audio_base("path", "format"), F.col("path")), F.lit("."), F.col("_new"))
    rows = rows.withColumn("old_path", F.col("path")).withColumn("path", F.when(F.col("_new") == F.col("format"), F.col("path")).otherwise(moved))
    return rows.withColumn("format", F.col("_new")).select(*desired.columns, "old_path")


# --- playlists -----------------------------------------------------------------------------------


def playlist_entries(members: DataFrame, desired: DataFrame, clips: DataFrame) -> DataFrame:
    """Members (account_id, playlist_id, pos, clip_id, title, duration) with path, title and duration of the
    wanted file, or their own title and an empty path."""
    have = desired.select(*CLIP, "path").join(clips.select(*CLIP, F.col("title").alias("_title"), F.col("duration").alias("_duration")), CLIP)
    return members.join(have, CLIP, "left").select(
        "account_id", "playlist_id", "pos", "clip_id", F.coalesce("_title", "title").alias("title"), F.coalesce("_duration", "duration").alias("duration"), F.coalesce("path", F.lit("")).alias("path")
    )


def entry_lines(title: Column, duration: Column, path: Column) -> Column:
    """An entry's lines; a member without a file is a comment, never a dangling path."""
    found = F.concat(F.lit("#EXTINF:"), fn.whole_seconds(duration).cast("string"), F.lit(","), fn.single_line(title), F.lit("\n"), fn.single_line(path), F.lit("\n"))
    return F.when(path == "", F.concat(F.lit("# (not in library) "), fn.single_line(title), F.lit("\n"))).otherwise(found)


def render_m3u8(playlists: DataFrame, entries: DataFrame) -> DataFrame:
    """(account_id, playlist_id, name) -> with path, content and hash; entries in the order of pos."""
    lines = entries.select("account_id", "playlist_id", "pos", entry_lines(F.col("title"), F.col("duration"), F.col("path")).alias("line"))
    body = lines.groupBy("account_id", "playlist_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("_body"))
    content = F.concat(F.lit("#EXTM3U\n#PLAYLIST:"), fn.single_line("name"), F.lit("\n"), F.coalesce("_body", F.lit("")))
    rows = playlists.join(body, ["account_id", "playlist_id"], "left").withColumn("content", content)
    return rows.select("account_id", "playlist_id", "name", F.concat(naming.sanitise_name("name"), F.lit(".m3u8")).alias("path"), "content", fn.content_hash("content").alias("hash"))


def rewrite_playlist_paths(playlists: DataFrame, path_map: DataFrame) -> DataFrame:
    """playlists whose lines equal to an old_path hold the path instead, with a new hash where any did."""
    keys = ["account_id", "playlist_id"]
    lines = playlists.select(*keys, F.posexplode(F.split("content", "\n")).alias("n", "line"))
    new = path_map.where("old_path <> path").select("account_id", F.col("old_path").alias("line"), F.col("path").alias("_new")).distinct()
    found = lines.join(new, ["account_id", "line"], "left")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("_new", "line").alias("t")))), lambda x: x["t"]), "\n")
    body = found.groupBy(*keys).agg(joined.alias("_content"), F.bool_or(F.col("_new").isNotNull()).alias("_changed"))
    rows = playlists.join(body, keys, "left")
    changed = F.coalesce("_changed", F.lit(False))
    return rows.withColumns({"hash": F.when(changed, fn.content_hash("_content")).otherwise(F.col("hash")), "content": F.when(changed, F.col("_content")).otherwise(F.col("content"))}).drop("_content", "_changed")


def protected_playlists(stored: DataFrame, rendered: DataFrame) -> DataFrame:
    """(account_id, playlist_id) of stored playlists that this run did not render from an intact listing."""
    return stored.select("account_id", "playlist_id").join(rendered.select("account_id", "playlist_id"), ["account_id", "playlist_id"], "left_anti")


def scoped_playlists(areas: DataFrame) -> DataFrame:
    """(account_id, playlist_id, name) that may be rendered: enumerated playlist areas, and the liked one as 'liked'."""
    rows = areas.where("fully_enumerated and kind in ('playlist', 'liked')")
    liked = F.col("kind") == "liked"
    return rows.select("account_id", F.when(liked, "liked").otherwise(F.col("area_id")).alias("playlist_id"), F.when(liked, "Liked Songs").otherwise(F.col("name")).alias("name")).distinct()


