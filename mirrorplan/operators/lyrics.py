"""Lyric texts from aligned lines and words, and which clips still need a lookup.

lyric_lines: account_id, clip_id, line_no, text, start_s, words array<struct<text, start_s>>
lyric_words: account_id, clip_id, word_no, word
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clips as fn

CLIP = ["account_id", "clip_id"]
# Versions of the rendered texts, and how long an empty or untimed answer is trusted.
VERSION = 1
TIMED_VERSION = 1
RECHECK_SECONDS = 14 * 86_400
TIMED_FORMATS = ("mp3", "wav")


def emitted_words() -> Column:
    return F.filter("words", lambda w: fn.strip(w["text"]) != "")


def line_text() -> Column:
    """The trimmed text, or the words where it is blank."""
    return F.coalesce(fn.present(fn.strip("text")), F.array_join(F.transform(emitted_words(), lambda w: fn.strip(w["text"])), " "))


def is_section_label() -> Column:
    text = fn.strip("text")
    return (F.length(text) >= 2) & text.startswith("[") & text.endswith("]") & (F.size("words") == 0)


def _joined(rows: DataFrame, at: str, text: Column, sep: str, name: str) -> DataFrame:
    """Texts of each clip in the order of `at`."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("n"), text.alias("t")))), lambda x: x["t"])
    return rows.groupBy(*CLIP).agg(F.array_join(parts, sep).alias(name))


def plain_text(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(account_id, clip_id, text): lines without trailing space, or all words where a clip has no line."""
    by_line = _joined(lines, "line_no", F.regexp_replace("text", r"(?U)\s+$", ""), "\n", "_lines")
    by_word = _joined(words, "word_no", F.col("word"), " ", "_words")
    return by_line.join(by_word, CLIP, "full_outer").select(*CLIP, F.coalesce("_lines", "_words", F.lit("")).alias("text"))


def plain_lyrics(clips: DataFrame, texts: DataFrame) -> DataFrame:
    """(account_id, clip_id, text): the clip's own lyrics, else the aligned text, with one line end; clips with neither are left out."""
    end = lambda x: F.regexp_replace(x, r"(?U)\s+$", "")
    rows = clips.select(*CLIP, "lyrics").join(texts.select(*CLIP, F.col("text").alias("_text")), CLIP, "left")
    best = F.coalesce(F.when(fn.strip("lyrics") != "", end("lyrics")), fn.present(end(F.col("_text"))))
    return rows.select(*CLIP, F.concat(best, F.lit("\n")).alias("text")).where("text is not null")


def _hundredths(seconds: Column) -> Column:
    good = ~F.isnan(seconds) & (seconds > 0) & (seconds < F.lit(float("inf")))
    return F.when(good, F.round(seconds * 100).cast("bigint")).otherwise(0)


def lrc_stamp(seconds: Column) -> Column:
    """mm:ss.xx; minutes may pass 59."""
    cs = _hundredths(seconds)
    return F.format_string("%02d:%02d.%02d", F.floor(cs / 6000), F.floor(cs / 100) % 60, cs % 100)


def _milliseconds(seconds: Column) -> Column:
    good = ~F.isnan(seconds) & (seconds > 0) & (seconds < F.lit(float("inf")))
    return F.when(good, F.round(seconds * 1000).cast("bigint")).otherwise(0)


def lrc_body(lines: DataFrame, timing: str = "line") -> DataFrame:
    """(account_id, clip_id, body): stamped lines; timing 'word' stamps each word too. Section labels are left out."""
    head = F.concat(F.lit("["), lrc_stamp(F.col("start_s")), F.lit("]"))
    words = F.array_join(F.transform(emitted_words(), lambda w: F.concat(F.lit("<"), lrc_stamp(w["start_s"]), F.lit(">"), fn.strip(w["text"]))), " ")
    text = F.when(F.size(emitted_words()) > 0, words).otherwise(line_text()) if timing == "word" else line_text()
    rows = lines.where(~is_section_label())
    return _joined(rows, "line_no", F.concat(head, text, F.lit("\n")), "", "body")


def timed_entries(lines: DataFrame, timing: str = "line") -> DataFrame:
    """(account_id, clip_id, line_no, word_no, ms, text): each line but the first emitted one begins with a line end."""
    rows = lines.where(~is_section_label()).withColumns({"_words": emitted_words(), "_text": line_text()})
    by_word = (F.size("_words") > 0) if timing == "word" else F.lit(False)
    rows = rows.where(by_word | (F.col("_text") != ""))
    first = F.row_number().over(Window.partitionBy(*CLIP).orderBy("line_no")) == 1
    rows = rows.withColumn("_lead", F.when(first, "").otherwise("\n"))
    whole = F.array(F.struct(_milliseconds(F.col("start_s")).alias("ms"), F.concat("_lead", "_text").alias("text")))
    single = F.transform("_words", lambda w, i: F.struct(_milliseconds(w["start_s"]).alias("ms"), F.concat(F.when(i == 0, F.col("_lead")).otherwise(" "), fn.strip(w["text"])).alias("text")))
    return rows.select(*CLIP, "line_no", F.posexplode(F.when(by_word, single).otherwise(whole)).alias("word_no", "e")).select(*CLIP, "line_no", "word_no", "e.ms", "e.text")


def lrc_document(clips: DataFrame, bodies: DataFrame, tool: str = "mirrorplan") -> DataFrame:
    """Clips with lineage context -> (account_id, clip_id, document): header tags and the timed body, else the
    clip's own lyrics line by line; clips with neither are left out."""
    m = fn.track_metadata()
    tags = [("ti", m["title"]), ("ar", m["artist"]), ("al", m["album"]), ("length", fn.minutes("duration")), ("re", F.lit(tool))]
    head = F.concat(*(F.when(v == "", "").otherwise(F.concat(F.lit(f"[{k}:"), fn.single_line(v), F.lit("]\n"))) for k, v in tags))
    own = F.when(fn.strip("lyrics") != "", F.concat(F.replace(F.regexp_replace("lyrics", r"(?U)\s+$", ""), F.lit("\r\n"), F.lit("\n")), F.lit("\n")))
    rows = clips.join(bodies.select(*CLIP, fn.present("body").alias("_body")), CLIP, "left")
    return rows.select(*CLIP, F.concat(head, F.coalesce("_body", own)).alias("document")).where("document is not null")


def lyric_targets(desired: DataFrame, slots: DataFrame, manifest: DataFrame, manifest_slots: DataFrame, now: int, timing: str = "line") -> DataFrame:
    """(account_id, clip_id) of wanted clips whose lyrics have to be looked up.

    manifest carries check_version, check_timed_version, check_timing, check_empty, check_timed and checked_unix
    (null: never looked up). desired carries lyrics_blank. A text that is to be embedded, a timed text, or
    a lyric file asks for a lookup, each on its own terms; an empty or untimed answer is asked again after
    14 days.
    """
    old = F.lit(now) - F.col("checked_unix") > RECHECK_SECONDS
    fields = ["format", "embedded_lyrics_hash", "embedded_timed_lyrics_hash", "check_version", "check_timed_version", "check_timing", "check_empty", "check_timed", "checked_unix"]
    m = manifest.select(*CLIP, F.lit(True).alias("m"), *(F.col(c).alias(f"m_{c}" if c in fields[:3] else c) for c in fields))
    wanted = slots.where("kind in ('lrc', 'lyrics_txt')").select(*CLIP, "kind", F.col("path").alias("w_path"))
    have = manifest_slots.where("kind in ('lrc', 'lyrics_txt')").select(*CLIP, "kind", F.col("path").alias("s_path"))
    rows = wanted.join(have, [*CLIP, "kind"], "left").join(m, CLIP, "left")
    stale_timing = (F.col("check_timed_version") != TIMED_VERSION) | ~F.col("check_timing").eqNullSafe(F.lit(timing))
    fetch = (
        F.when(F.col("m").isNull() | F.col("check_version").isNull() | (F.col("check_version") != VERSION), True)
        .when((F.col("kind") == "lrc") & stale_timing, True)
        .when(F.col("check_empty"), old)
        .when(F.col("s_path").isNull() | (F.col("s_path") != F.col("w_path")), True)
        .when(~F.col("check_timed"), old)
        .otherwise(False)
    )
    by_slot = rows.where(fetch).select(*CLIP)
    has_lrc = wanted.where("kind = 'lrc'").select(*CLIP, F.lit(True).alias("_lrc"))
    d = desired.select(*CLIP, "format", "lyrics_blank").join(m, CLIP, "left").join(has_lrc, CLIP, "left")
    known_empty = F.coalesce(F.col("check_empty") & (F.col("check_version") == VERSION), F.lit(False))
    embed = (
        F.when(~F.col("lyrics_blank"), False)
        .when(F.col("m").isNull() | (F.col("m_format") != F.col("format")), True)
        .when(F.col("m_embedded_lyrics_hash") != "", False)
        .when(known_empty, old)
        .otherwise(True)
    )
    timed = (
        F.when(~F.col("format").isin(*TIMED_FORMATS) | F.col("_lrc").isNull(), False)
        .when(F.col("m").isNull() | (F.col("m_format") != F.col("format")) | F.col("check_version").isNull() | stale_timing, True)
        .otherwise((F.col("m_embedded_timed_lyrics_hash") == "") & F.coalesce("check_timed", F.lit(False)))
    )
    return by_slot.union(d.where(embed | timed).select(*CLIP)).distinct()


def apply_lyrics(desired: DataFrame, slots: DataFrame, manifest: DataFrame, manifest_slots: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """desired and slots with the texts of this run's lookups, and pending (account_id, clip_id, empty, timed, slots).

    fetched: (account_id, clip_id, plain, lrc, timed_hash) of every lookup that succeeded; null texts mean
    that there are none. A fetched text fills its slot and hash; an empty answer drops a slot that nothing
    is stored for; no answer keeps what is stored. Where the format changes and a stored embedded text
    could not be fetched again, lyrics_reencode_safe turns false.
    """
    f = fetched.select(*CLIP, F.lit(True).alias("_f"), "plain", "lrc", "timed_hash")
    m = manifest.select(*CLIP, F.col("format").alias("_format"), F.col("embedded_lyrics_hash").alias("_plain_hash"), F.col("embedded_timed_lyrics_hash").alias("_timed_hash"))
    wants = slots.where("kind = 'lrc'").select(*CLIP, F.lit(True).alias("_lrc")).distinct()
    rows = desired.join(m, CLIP, "left").join(f, CLIP, "left").join(wants, CLIP, "left")
    changes = F.coalesce(F.col("_format") != F.col("format"), F.lit(False))
    timed_wanted = F.col("format").isin(*TIMED_FORMATS) & F.coalesce("_lrc", F.lit(False))
    fallback = F.when(F.col("lyrics_blank"), F.col("plain"))
    kept_timed = F.when(changes & ~timed_wanted, "").otherwise(F.coalesce("_timed_hash", F.lit("")))
    unsafe_plain = changes & F.col("lyrics_blank") & (F.coalesce("_plain_hash", F.lit("")) != "") & fallback.isNull()
    unsafe_timed = changes & timed_wanted & (F.coalesce("_timed_hash", F.lit("")) != "") & F.col("lrc").isNull()
    new = rows.withColumns(
        {
            "embedded_lyrics_hash": F.coalesce(F.when(fallback.isNotNull(), fn.content_hash(fallback)), F.col("_plain_hash"), F.lit("")),
            "embedded_timed_lyrics_hash": F.when(timed_wanted & F.col("lrc").isNotNull(), F.coalesce("timed_hash", F.lit(""))).otherwise(kept_timed),
            "lyrics_reencode_safe": ~(unsafe_plain | unsafe_timed),
        }
    ).select(*desired.columns)

    stored = manifest_slots.where("kind in ('lrc', 'lyrics_txt')").select(*CLIP, "kind", F.col("source_hash").alias("_stored"))
    s = slots.join(stored, [*CLIP, "kind"], "left").join(f, CLIP, "left")
    lyric = F.col("kind").isin("lrc", "lyrics_txt")
    text = F.when(F.col("kind") == "lrc", F.col("lrc")).when(F.col("kind") == "lyrics_txt", F.col("plain"))
    wrote = lyric & text.isNotNull()
    s = s.withColumn("_wrote", wrote).where(~lyric | wrote | F.col("_stored").isNotNull() | F.col("_f").isNull())
    hashed = F.when(F.col("_wrote"), fn.content_hash(text)).when(lyric & F.col("_stored").isNotNull(), F.col("_stored")).otherwise(F.col("hash"))
    filled = s.withColumns({"hash": hashed, "content": F.when(F.col("_wrote"), text).otherwise(F.col("content"))})
    by_clip = s.where("_wrote").groupBy(*CLIP).agg(F.array_sort(F.collect_set("kind")).alias("slots"))
    pending = f.join(by_clip, CLIP, "left").select(
        *CLIP, (F.col("plain").isNull() & F.col("lrc").isNull()).alias("empty"), F.col("lrc").isNotNull().alias("timed"), F.coalesce("slots", F.array().cast("array<string>")).alias("slots")
    )
    return new, filled.select(*slots.columns), pending


def record_checks(manifest: DataFrame, pending: DataFrame, landed: DataFrame, now: int, timing: str = "line") -> DataFrame:
    """manifest with the check of each pending clip stamped, where every slot it wrote has landed
    (account_id, clip_id, kind)."""
    need = pending.select(*CLIP, "empty", "timed", F.explode_outer("slots").alias("kind"))
    done = need.join(landed.select(*CLIP, "kind", F.lit(True).alias("_ok")), [*CLIP, "kind"], "left")
    done = done.groupBy(*CLIP).agg(F.bool_and(F.col("kind").isNull() | F.coalesce("_ok", F.lit(False))).alias("_all"), F.first("empty").alias("_empty"), F.first("timed").alias("_timed"))
    rows = manifest.join(done.where("_all"), CLIP, "left")
    now_or = lambda value, name: F.when(F.col("_all"), value).otherwise(F.col(name))
    stamped = {
        "check_version": now_or(F.lit(VERSION), "check_version"), "checked_unix": now_or(F.lit(now).cast("bigint"), "checked_unix"), "check_empty": now_or(F.col("_empty"), "check_empty"), "check_timed": now_or(F.col("_timed"), "check_timed"),
        "check_timed_version": now_or(F.when(F.col("_timed"), TIMED_VERSION).otherwise(F.col("check_timed_version")), "check_timed_version"), "check_timing": now_or(F.when(F.col("_timed"), timing).otherwise(F.col("check_timing")), "check_timing"),
    }
    return rows.withColumns(stamped).select(*manifest.columns)


def lookup_completeness(targets: DataFrame, fetched: DataFrame) -> DataFrame:
    """(account_id, n_missing, complete) of required lookups."""
    rows = targets.select(*CLIP).join(fetched.select(*CLIP, F.lit(True).alias("_f")).distinct(), CLIP, "left")
    return rows.groupBy("account_id").agg(F.count_if(F.col("_f").isNull()).alias("n_missing")).withColumn("complete", F.col("n_missing") == 0)


def tag_differences(observed: str | Column, wanted: str | Column, fields: list[str], empty_is_absent: bool = True, collapse: bool = False) -> Column:
    """Fields of two map<string, array<string>> whose sorted values differ, in the order of `fields`."""

    def values(tags: Column, field: str) -> Column:
        v = F.coalesce(F.element_at(tags, field), F.array().cast("array<string>"))
        v = F.filter(v, lambda x: x != "") if empty_is_absent else v
        return F.array_sort(F.array_distinct(v) if collapse else v)

    a, b = fn.c(observed), fn.c(wanted)
    return F.array_compact(F.array(*(F.when(values(a, f) != values(b, f), F.lit(f)) for f in fields)))


def observed_manifest(manifest: DataFrame, manifest_slots: DataFrame, inventory: DataFrame) -> DataFrame:
    """manifest as the files are: embedded lyric hashes from observed files, and a check whose lyric files
    are missing, empty or changed counts as never made (version 0)."""
    files = inventory.select("account_id", "path", F.lit(True).alias("_seen"), *(F.col(c).alias(f"_{c}") for c in inventory.columns if c not in ("account_id", "path")))
    slots = manifest_slots.where("kind in ('lrc', 'lyrics_txt')").join(files, ["account_id", "path"])
    drift = ~F.col("_exists") | (F.col("_size") == 0) | F.coalesce(F.col("content_hash") != F.col("_content_hash"), F.lit(False))
    drifted = slots.where(drift).select(*CLIP, F.lit(True).alias("_drift")).distinct()
    rows = manifest.join(files, ["account_id", "path"], "left").join(drifted, CLIP, "left")
    change = {"check_version": F.when(F.col("_drift"), F.when(F.col("check_version").isNotNull(), 0)).otherwise(F.col("check_version"))}
    if "observed" in inventory.columns:
        seen = F.coalesce("_observed", F.lit(False))
        change |= {
            "embedded_lyrics_hash": F.when(seen, F.coalesce("_lyrics_hash", F.lit(""))).otherwise(F.col("embedded_lyrics_hash")),
            "embedded_timed_lyrics_hash": F.when(seen, F.coalesce("_timed_hash", F.lit(""))).otherwise(F.col("embedded_timed_lyrics_hash")),
        }
    return rows.withColumns(change).select(*manifest.columns)
