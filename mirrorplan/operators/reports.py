"""Summaries, guards and exports of plans, outcomes and libraries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clips as fn
from ..functions import naming
from ..plans.reconcile import DELETES

CLIP = ["account_id", "clip_id"]
# Which actions each bucket of a report counts; the smallest manifest that the guard watches.
BUCKETS = {
    "downloaded": ("download", "reformat"),
    "tagged": ("retag",),
    "renamed": ("rename", "move_artifact", "move_stem"),
    "deleted": DELETES,
    "sidecars": ("write_artifact", "write_stem"),
    "skipped": ("skip", "verify_audio", "verify_artifact"),
    "unverifiable": ("unverifiable",),
}
GUARD_FLOOR = 8


def plan_summary(plan: DataFrame) -> DataFrame:
    """Counts of the report's buckets per account, and their total."""
    return plan.groupBy("account_id").agg(*(F.count_if(F.col("action").isin(*v)).alias(k) for k, v in BUCKETS.items()), F.count("*").alias("total"))


def plan_changes(plan: DataFrame) -> DataFrame:
    """(account_id, has_changes): any row that is no skip."""
    return plan.groupBy("account_id").agg(F.bool_or(F.col("action") != "skip").alias("has_changes"))


def deletion_paths(plan: DataFrame) -> DataFrame:
    return plan.where(F.col("action").isin(*DELETES)).select("account_id", "clip_id", "path")


def mass_delete_guard(accounts: DataFrame, plan: DataFrame, desired: DataFrame, manifest: DataFrame) -> DataFrame:
    """(account_id, min_newest, explicit_zero, yes) -> (account_id, abort): whether deletes look like a broken listing.

    With nothing wanted any delete aborts, unless the run itself said zero and yes. Else deletes of half of
    a manifest of 8 or more abort, unless min_newest is 0 and yes.
    """
    count = lambda df, name: df.groupBy("account_id").agg(F.count("*").alias(name))
    rows = accounts.join(count(plan.where("action = 'delete'"), "_deletes"), "account_id", "left").join(count(manifest, "_had"), "account_id", "left")
    rows = rows.join(desired.groupBy("account_id").agg(F.countDistinct("clip_id").alias("_want")), "account_id", "left").na.fill(0, ["_deletes", "_had", "_want"])
    abort = (
        F.when((F.col("_deletes") == 0) | (F.col("_had") == 0), False)
        .when(F.col("_want") == 0, ~(F.col("explicit_zero") & F.col("yes")))
        .when((F.col("min_newest") == 0) & F.col("yes"), False)
        .otherwise((F.col("_had") >= GUARD_FLOOR) & (F.col("_deletes") * 2 >= F.col("_had")))
    )
    return rows.select("account_id", abort.alias("abort"))


def guarded(plan: DataFrame, guard: DataFrame) -> DataFrame:
    """The plan of accounts that no guard stops."""
    return plan.join(guard.where("not abort"), "account_id", "left_semi")


def run_severity(runs: DataFrame) -> DataFrame:
    """(account_id, status, n_unverifiable, n_failed, n_progressed) -> (account_id, code): disk 9, auth 4, partial 5,
    nothing progressed 6, clean 0; one more row with a null account holds the worst."""
    code = (
        F.when(F.col("status") == "disk_full", 9).when(F.col("status") == "auth_aborted", 4).when(F.col("n_unverifiable") > 0, 5)
        .when(F.col("n_failed") == 0, 0).when(F.col("n_progressed") == 0, 6).otherwise(5)
    )
    return runs.withColumn("code", code).rollup("account_id").agg(F.max("code").alias("code"))


def path_refcounts(manifest: DataFrame, manifest_slots: DataFrame, albums: DataFrame, playlists: DataFrame) -> DataFrame:
    """(account_id, path, n): how many recorded slots hold each path."""
    rows = [df.select("account_id", "path") for df in (manifest, manifest_slots, albums, playlists)]
    paths = rows[0].union(rows[1]).union(rows[2]).union(rows[3]).where("path <> ''")
    return paths.groupBy("account_id", "path").agg(F.count("*").alias("n"))


def given_up(ordered: DataFrame, manifest_slots: DataFrame) -> DataFrame:
    """(account_id, seq, path, move) of the plan's rows by which a sidecar or stem leaves its recorded path: moves, and writes elsewhere."""
    rows = ordered.where(F.col("action").isin("write_artifact", "write_stem", "move_artifact", "move_stem"))
    old = manifest_slots.select(*CLIP, F.col("kind").alias("slot_kind"), F.col("key").alias("slot_key"), F.col("path").alias("_old"))
    rows = rows.join(old, [*CLIP, "slot_kind", "slot_key"], "left").withColumn("_from", F.coalesce("from_path", "_old", F.lit("")))
    move = F.col("action").isin("move_artifact", "move_stem")
    return rows.where((F.col("_from") != "") & (F.col("_from") != F.col("path"))).select("account_id", "seq", F.col("_from").alias("path"), move.alias("move"))


def release_paths(events: DataFrame, refcounts: DataFrame, writes: DataFrame) -> DataFrame:
    """What becomes of old files as slots leave them one by one: (account_id, seq, path, move, outcome, removed).

    events: (account_id, seq, path, move), a slot leaving path at place seq of the run. refcounts: (account_id, path, n)
    before the run. writes: (account_id, seq, path) of files that the run puts somewhere. Each event takes one off
    the count of its path. A move renames the file (`rename`) if the slot holds it alone and nothing was written there
    earlier in the run; otherwise it is written anew at its new place (`refetch`), and like any write (`write`) removes the
    old file if no slot holds it any more and nothing was written there. So of n slots on one path the last one removes it.
    Paths that nothing records count as held by none. Events of one path are ranked together: as many rows as slots share it.
    """
    first = writes.groupBy("account_id", "path").agg(F.min("seq").alias("_written"))
    rank = F.row_number().over(Window.partitionBy("account_id", "path").orderBy("seq"))
    rows = events.withColumn("_rank", rank).join(refcounts.select("account_id", "path", "n"), ["account_id", "path"], "left").join(first, ["account_id", "path"], "left")
    untouched = ~F.coalesce(F.col("_written") < F.col("seq"), F.lit(False))
    held = F.greatest(F.coalesce("n", F.lit(0)) - F.col("_rank") + 1, F.lit(0))  # before the event
    renamed = F.col("move") & (held <= 1) & untouched
    outcome = F.when(renamed, "rename").when(F.col("move"), "refetch").otherwise("write")
    return rows.select("account_id", "seq", "path", "move", outcome.alias("outcome"), (~renamed & (held <= 1) & untouched).alias("removed"))


def shared_sources(plan: DataFrame) -> DataFrame:
    """(account_id, source_url, n) of addresses that several writes need, to be fetched once."""
    rows = plan.where(F.col("action").isin("write_artifact", "write_stem") & (F.col("source_url") != ""))
    return rows.groupBy("account_id", "source_url").agg(F.count("*").alias("n")).where("n > 1")


def failure_rows(failures: DataFrame, clips: DataFrame, base: str = fn.SONG_BASE) -> DataFrame:
    """(account_id, clip_id, class, reason) with title and address of the clip, '' where it is unknown."""
    return failures.join(clips.select(*CLIP, "title"), CLIP, "left").select(*CLIP, "class", "reason", F.coalesce("title", F.lit("")).alias("title"), F.concat(F.lit(base + "/"), "clip_id").alias("url"))


def audit_rows(plan: DataFrame, failed: DataFrame, now: str) -> DataFrame:
    """Log rows of the applied deletes (audio and sidecars, not stems) and renames of clips that did not fail."""
    rows = plan.where("action in ('delete', 'delete_artifact', 'rename')").join(failed.select(*CLIP), CLIP, "left_anti")
    return rows.select(F.lit(now).alias("at"), "account_id", "clip_id", "action", "slot_kind", "path", "from_path")


def library_index(manifest: DataFrame, nodes: DataFrame, roots: DataFrame, clips: DataFrame, contexts: DataFrame, artist: str = fn.UNKNOWN_ARTIST) -> DataFrame:
    """One row per recorded clip. clips: those listed now; contexts: (account_id, clip_id, album) of any clip."""
    live = clips.select(*CLIP, F.lit(True).alias("_live"), *(F.col(c).alias(f"_{c}") for c in ("title", "display_name", "handle", "duration", "tags")))
    node = nodes.select(*CLIP, F.col("title").alias("_node_title"), F.col("created_at").alias("_node_created"))
    rows = manifest.join(live, CLIP, "left").join(node, CLIP, "left").join(roots.select(*CLIP, "root_id"), CLIP, "left").join(contexts.select(*CLIP, "album"), CLIP, "left")
    return rows.select(
        *CLIP, "path", "format", "size", F.coalesce(fn.present("_title"), fn.present("_node_title"), F.lit("Untitled")).alias("title"),
        F.when(F.col("_live"), F.coalesce(fn.present("_display_name"), F.lit(artist))).alias("artist"), fn.present("_handle").alias("handle"), F.coalesce("album", F.lit("")).alias("album"),
        F.coalesce(fn.present("root_id"), "clip_id").alias("root_id"), fn.present("_node_created").alias("created_at"), F.col("_duration").alias("duration"), F.col("_tags").alias("tags"),
    )


# The keys of a listing's JSON object in their order; those that are null where the string is empty.
LISTED = (
    "id", "title", "status", "duration", "created_at", "is_liked", "has_vocal", "clip_type", "tags", "prompt", "gpt_description_prompt", "lyrics", "model_name", "major_model_version",
    "display_name", "handle", "edited_clip_id", "audio_url", "image_url", "image_large_url", "video_url", "video_cover_url",
)
NULLABLE = ("prompt", "gpt_description_prompt", "lyrics", "edited_clip_id")


def export_listing(clips: DataFrame) -> DataFrame:
    """(account_id, clip_id, line, json) of every clip: a tab-separated row, and a JSON object of the LISTED keys.

    Durations have one decimal, of the exact value and with ties to even. A clip without has_vocal has none.
    """
    line = F.concat_ws("\t", "clip_id", F.concat(fn.tenths("duration"), F.lit("s")), fn.truncated(fn.title_or_untitled(), 48), "tags")
    special = {"id": F.col("clip_id"), "title": fn.title_or_untitled()} | ({} if "has_vocal" in clips.columns else {"has_vocal": F.lit(False)})
    value = lambda k: special.get(k, fn.present(k) if k in NULLABLE else F.col(k))
    fields = F.struct(*(value(k).alias(k) for k in LISTED))
    return clips.select("account_id", "clip_id", line.alias("line"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


# The report's line of each action, the names of sidecars there, which lines can be marked as failed, and
# the lines of the summaries with the buckets that they count.
LINES = {
    "download": "download  {id}  {title}  {path}",
    "reformat": "reformat  {id}  {title}  -> {format} {path}",
    "retag": "tag       {id}  {title}  tags updated",
    "rename": "rename    {from_path} -> {path}",
    "delete": "delete    {id}  {path}  removed (absent from source)",
    "skip": "skip      {id}  already up to date",
    "unverifiable": "verify    {id}  {path}  {reason}",
    "verify_artifact": "skip      {id}  {kind} verified at {path}",
    "verify_audio": "skip      {id}  audio metadata verified",
    "write_artifact": "artifact  {id}  {kind}  -> {path}",
    "move_artifact": "artifact  {id}  {kind}  {from_path} -> {path}",
    "delete_artifact": "artifact  {id}  {kind}  removed {path}",
    "write_stem": "stem      {id}  {slot_key}  -> {path}",
    "move_stem": "stem      {id}  {slot_key}  {from_path} -> {path}",
    "delete_stem": "stem      {id}  {slot_key}  removed {path}",
}
ARTIFACTS = {
    "cover_jpg": "cover.jpg", "cover_webp": "cover.webp", "details_txt": "details.txt", "lyrics_txt": "lyrics.txt", "lrc": "lrc", "video_mp4": "video.mp4",
    "folder_jpg": "folder.jpg", "folder_webp": "folder.webp", "folder_mp4": "cover.mp4", "playlist": "playlist",
}
UNMARKED = ("rename", "skip", "verify_artifact", "verify_audio")
PENDING = (("to download", "downloaded"), ("to tag", "tagged"), ("to rename", "renamed"), ("to delete", "deleted"), ("sidecars", "sidecars"), ("up to date", "skipped"), ("unverified", "unverifiable"), ("total", "total"))
DONE = (("downloaded", "downloaded"), ("tagged", "tagged"), ("renamed", "renamed"), ("deleted", "deleted"), ("sidecars", "sidecars"), ("skipped", "skipped"), ("unverified", "unverifiable"), ("failed", "failed"), ("total", "total"))
ENDS = {"completed": "complete: {}", "disk_full": "aborted: {} (disk full, run stopped early)", "auth_aborted": "aborted: {} (authentication failed, run stopped early)"}


def plan_report(ordered: DataFrame, failed: DataFrame, clips: DataFrame) -> DataFrame:
    """(account_id, seq, line): every row of the plan as a line of text, marked where its clip failed. clips: (account_id, clip_id, title), for the titles."""
    rows = ordered.join(failed.select(*CLIP, F.lit(True).alias("_failed")).distinct(), CLIP, "left").join(clips.select(*CLIP, "title"), CLIP, "left")
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ARTIFACTS.items() for x in kv)), F.col("slot_kind")), F.col("slot_kind"))
    known = {"id": fn.short_id("clip_id"), "title": fn.truncated(fn.title_or_untitled(), 40), "reason": fn.truncated("reason", 80), "kind": kind}
    text = F.lit(None).cast("string")
    for action, line in LINES.items():
        parts = [F.coalesce(known.get(x, F.col(x)), F.lit("")) if k % 2 else F.lit(x) for k, x in enumerate(re.split(r"\{(\w+)\}", line)) if x]
        mark = F.lit("") if action in UNMARKED else F.when(F.col("_failed"), "  [FAILED]").otherwise("")
        text = F.when(F.col("action") == action, F.concat(F.lit("  "), *parts, mark)).otherwise(text)
    return rows.select("account_id", "seq", text.alias("line"))


def _counted(head: Column, lines: tuple[tuple[str, str], ...]) -> list[Column]:
    right = lambda n: F.lpad(F.col(n).cast("string"), F.greatest(F.lit(4), F.length(F.col(n).cast("string"))), " ")
    return [head, *(F.concat(F.lit(f"\n  {label:<11} "), right(n)) for label, n in lines)]


def dry_summary(plan: DataFrame) -> DataFrame:
    """(account_id, text): what a run of the plan would do, by bucket."""
    head = F.concat(F.lit("Dry run: "), "account_id", F.lit(" (no changes made)"))
    return plan_summary(plan).select("account_id", F.concat(*_counted(head, PENDING)).alias("text"))


def run_summary(runs: DataFrame, verb: str) -> DataFrame:
    """(account_id, status, seconds and a count for each bucket and `failed`) -> (account_id, text)."""
    end = lambda s: F.concat(F.lit(f"{verb} {ENDS[s].split('{}')[0]}"), "account_id", F.lit(ENDS[s].split("{}")[1]))
    head = F.when(F.col("status") == "disk_full", end("disk_full")).when(F.col("status") == "auth_aborted", end("auth_aborted")).otherwise(end("completed"))
    rows = runs.withColumn("total", reduce(Column.__add__, (F.col(n) for _, n in DONE[:-1])))
    return rows.select("account_id", F.concat(*_counted(head, DONE), F.lit("\nDuration: "), fn.tenths("seconds"), F.lit("s")).alias("text"))


def first_paths(paths: DataFrame, show: int) -> DataFrame:
    """(account_id, n, shown): how many paths an account has and its first `show` in order.

    A rank with a fixed bound leaves few rows of an account in each task before they are dealt out, so no task holds a whole account.
    """
    rank = F.row_number().over(Window.partitionBy("account_id").orderBy("path"))
    few = paths.select("account_id", "path").withColumn("_r", rank).where(F.col("_r") <= show)
    few = few.groupBy("account_id").agg(F.array_sort(F.collect_list("path")).alias("shown"))
    return paths.groupBy("account_id").agg(F.count("*").alias("n")).join(few, "account_id", "left").select("account_id", "n", F.coalesce("shown", F.array().cast("array<string>")).alias("shown"))


def _block(head: str, more: str, end: str, show: int) -> Column:
    """Head and remainder with {} for a count, around the shown paths."""
    n = lambda text, count: F.concat(*(count.cast("string") if k % 2 else F.lit(t) for k, t in enumerate(re.split(r"(\{\})", text)) if t))
    lines = F.array_join(F.transform("shown", lambda p: F.concat(F.lit("  "), p, F.lit("\n"))), "")
    rest = F.when(F.col("n") > show, n(more, F.col("n") - show)).otherwise("")
    return F.concat(n(head, F.col("n")), lines, rest, F.lit(end))


def delete_prompt(deletions: DataFrame, show: int = 20) -> DataFrame:
    """(account_id, path) -> (account_id, text): the question asked before a run that deletes."""
    text = _block("sync will delete {} local file(s) that are no longer in the source:\n", "  ... and {} more (run with -v to see the full list)\n", "\nProceed?", show)
    return first_paths(deletions, show).select("account_id", text.alias("text"))


def orphan_files(inventory: DataFrame, manifest: DataFrame, manifest_slots: DataFrame) -> DataFrame:
    """(account_id, path) of audio files that nothing records, whatever their path's case or composition."""
    tracked = manifest.select("account_id", "path").union(manifest_slots.select("account_id", "path")).select("account_id", naming.canonical_path_key("path").alias("_key"))
    audio = inventory.where(F.col("exists") & F.lower("path").rlike(r"\.(flac|mp3|wav|m4a)$")).select("account_id", "path").distinct()
    return audio.withColumn("_key", naming.canonical_path_key("path")).join(tracked, ["account_id", "_key"], "left_anti").select("account_id", "path")


def orphan_report(orphans: DataFrame, show: int = 20) -> DataFrame:
    """(account_id, path) -> (account_id, text): a note on files that nothing records, the first `show` of each account by name."""
    text = _block(
        "note: {} untracked audio file(s) on disk, not touched (moved or renamed by hand, or from an older layout):\n", "  ... and {} more\n",
        "  Move each into place or delete it; a re-sync re-downloads any a clip still needs.", show,
    )
    return first_paths(orphans, show).select("account_id", text.alias("text"))
