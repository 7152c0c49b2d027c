"""Column functions on clip, account and outcome rows. Absent strings are '' throughout.

All run inside Spark's generated code; none is a Python UDF. Names of clip columns are those that
`sources.ingest.clip_columns` makes. Names and addresses of the source service are parameters.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the source's vocabulary.
EXCLUDED_TASKS = ("infill", "fixed_infill")
EXCLUDED_TYPES = ("rendered_context_window",)
ZERO_ID = "00000000-0000-0000-0000-000000000000"
EDGE_LABELS = {
    "cover": "Cover of",
    "remaster": "Remaster of",
    "speed_edit": "Speed-edited from",
    "edit": "Edited from",
    "extend": "Extended from",
    "section_replace": "Section replaced from",
    "stitch": "Stitched from",
    "derived": "Derived from",
    "uploaded": "Uploaded",
}
UNKNOWN_ARTIST = "Unknown Artist"
MEDIA_BASE = "https://media.example.org"
SONG_BASE = "https://www.example.org/song"


#: Where the next tenth begins, as the nearest double, and whether that double itself counts up: it lies above the true
#: place, or is the true place and a tie whose upper digit is even.
_TENTHS = [(k / 20, Fraction(k / 20) > Fraction(k, 20) or Fraction(k / 20) == Fraction(k, 20) and (k + 1) // 2 % 2 == 0) for k in range(1, 20, 2)]


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def present(x: str | Column) -> Column:
    """The string, or null where it is absent."""
    return F.nullif(c(x), F.lit(""))


def strip(x: str | Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c(x), r"(?U)^\s+|\s+$", "")


def is_downloadable() -> Column:
    """A finished clip that is no fragment; whether it is trashed plays no part."""
    return (F.col("status") == "complete") & ~F.col("clip_type").isin(*EXCLUDED_TYPES) & ~F.col("task").isin(*EXCLUDED_TASKS)


def normalise_id(x: str | Column) -> Column:
    """Without one leading 'm_'; null for an empty or all-zero id."""
    bare = F.regexp_replace(F.coalesce(c(x), F.lit("")), "^m_", "")
    return F.when((bare != "") & (bare != ZERO_ID), bare)


def edge_type() -> Column:
    """Slug of a clip's relation to its parent, by the first rule that fits; null for none."""
    task, kind = F.col("task"), F.col("clip_type")
    return (
        F.when(task.isin("infill", "fixed_infill"), "section_replace")
        .when(task == "extend", "extend")
        .when(kind == "concat", "stitch")
        .when(kind == "edit_speed", "speed_edit")
        .when(task == "cover", "cover")
        .when((kind == "upsample") | (task == "upsample"), "remaster")
        .when(kind == "edit_v3_export", "edit")
        .when(normalise_id("edited_clip_id").isNotNull(), "derived")
    )


#: Pointers that may name the parent, by edge type, in order.
PARENT_FIELDS = {
    "section_replace": ("override_history_clip_id", "override_future_clip_id", "history", "edited_clip_id"),
    "extend": ("history", "edited_clip_id"),
    "stitch": ("concat_history", "edited_clip_id"),
    "speed_edit": ("speed_clip_id", "edited_clip_id"),
    "cover": ("cover_clip_id", "edited_clip_id"),
    "remaster": ("upsample_clip_id", "remaster_clip_id", "edited_clip_id"),
    "edit": ("edited_clip_id",),
    "derived": ("edited_clip_id",),
}


#: The columns that edge_type() and primary_parent() read.
POINTING = ("task", "clip_type", *dict.fromkeys(f for fields in PARENT_FIELDS.values() for f in fields))


def primary_parent() -> Column:
    """struct(parent_id, edge, source_field) of the first usable pointer of the clip's edge type, else null."""

    def pointer(field: str) -> Column:
        value = F.get(F.col(field), F.lit(0))["id"] if field in ("history", "concat_history") else F.col(field)
        return normalise_id(value)

    edge, out = edge_type(), F.lit(None)
    for slug, fields in PARENT_FIELDS.items():
        pick = F.coalesce(
            *(F.when(pointer(f).isNotNull(), F.struct(pointer(f).alias("parent_id"), F.lit(slug).alias("edge"), F.lit(f).alias("source_field"))) for f in fields)
        )
        out = F.when(edge == slug, pick).otherwise(out)
    return out


def edge_label(slug: str | Column) -> Column:
    pairs = [F.lit(x) for kv in EDGE_LABELS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), c(slug))


def normalise_slug(x: str | Column) -> Column:
    """Lower case, white space runs as one underscore; 'attribution' if nothing is left."""
    words = F.regexp_replace(strip(x), r"(?U)\s+", "_")
    return F.coalesce(present(F.lower(words)), F.lit("attribution"))


def same_owner(handle: str | Column, other: str | Column) -> Column:
    a, b = strip(handle), strip(other)
    return (a != "") & (b != "") & (a == b)


def album_title(own: str | Column, root: str | Column) -> Column:
    """The root's title if it is not blank and differs from the clip's own."""
    return F.when((strip(root) != "") & (c(root) != c(own)), c(root)).otherwise(c(own))


def album_year(own_date: str | Column, root_date: str | Column) -> Column:
    return F.coalesce(present(F.left(c(root_date), F.lit(4))), F.left(c(own_date), F.lit(4)))


def cdn_audio_url(url: str | Column, clip_id: str | Column, base: str = MEDIA_BASE, expiring: str = "audiopipe") -> Column:
    """The stable address of a clip instead of one on a host whose links expire."""
    return F.when(F.contains(c(url), F.lit(expiring)) & (c(clip_id) != ""), F.concat(F.lit(base + "/"), c(clip_id), F.lit(".mp3"))).otherwise(c(url))


def mp3_url(base: str = MEDIA_BASE) -> Column:
    """The first non-empty mp3 among media_urls, else audio_url, else the stable address."""
    first = F.get(F.filter("media_urls", lambda m: (m["content_type"] == "mp3") & (m["url"] != "")), F.lit(0))["url"]
    made = F.concat(F.lit(base + "/"), F.col("clip_id"), F.lit(".mp3"))
    return F.when(first.isNotNull(), cdn_audio_url(first, "clip_id", base)).otherwise(F.coalesce(present("audio_url"), made))


def selected_image_url() -> Column:
    """The large image, else the small one, else null."""
    return F.coalesce(present("image_large_url"), present("image_url"))


def cover_candidates() -> Column:
    return F.filter(F.array("image_large_url", "image_url"), lambda u: u != "")


def stem_label() -> Column:
    """The group's name with spaces for underscores, else what the title's last bracket holds."""
    group = strip(F.translate("stem_type_group_name", "_", " "))
    return F.when(group != "", group).otherwise(strip(F.regexp_extract("title", r"(?s)\(([^(]*)\)\s*$", 1)))


def account_health() -> Column:
    return (
        F.when(F.col("is_past_due").eqNullSafe(True), "past due")
        .when(F.col("is_paused").eqNullSafe(True), "paused")
        .when(F.col("is_active").eqNullSafe(False), "inactive")
    )


def lossless_access() -> Column:
    """available, unknown, or why not: past due, paused, inactive, not included."""
    return F.coalesce(
        account_health(),
        F.when(F.array_contains("features", "convert_audio"), "available").when(F.col("features_known"), "not included").otherwise("unknown"),
    )


def usage_line() -> Column:
    left = F.coalesce(F.concat(F.col("credits_left").cast("string"), F.lit(" remaining")), F.lit("unknown"))
    quota = F.concat(F.lit(" ("), F.col("monthly_usage").cast("string"), F.lit(" of "), F.col("monthly_limit").cast("string"), F.lit(" used this "), F.coalesce("period", F.lit("period")), F.lit(")"))
    health = F.concat(F.lit("; "), account_health())
    return F.concat(left, F.coalesce(quota, F.lit("")), F.coalesce(health, F.lit("")))


def deadline_bucket(expires: str | Column, now: int | Column, window: int) -> Column:
    """struct(bucket, days): expired, expiring (days rounded up) within the window, or fresh."""
    left = c(expires) - (F.lit(now) if isinstance(now, int) else now)
    bucket = F.when(left <= 0, "expired").when(left < window, "expiring").otherwise("fresh")
    days = F.when((left > 0) & (left < window), F.ceil(left / 86400)).cast("bigint")
    return F.struct(bucket.alias("bucket"), days.alias("days"))


def parse_recency(spec: str) -> int | str:
    """Seconds of 'Nd' or 'Nw', or 'last-run'; anything else raises."""
    text = spec.strip().lower()
    if text == "last-run":
        return text
    if m := re.fullmatch(r"(\d+)([dw])", text):
        return int(m[1]) * {"d": 86_400, "w": 604_800}[m[2]]
    raise ValueError(f"no recency: {spec!r}")


def parse_created(x: str | Column) -> Column:
    """Unix seconds of 'YYYY-MM-DDTHH:MM:SS[.fraction]Z'; null for anything else and before 1970."""
    text = F.regexp_extract(c(x), r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(\.[^T]*)?Z$", 1)
    seconds = F.unix_timestamp(F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    return F.when(seconds >= 0, seconds)


def epoch_days(x: str | Column) -> Column:
    return F.unix_date(F.to_date(c(x)))


def rfc3339(unix_seconds: str | Column) -> Column:
    """UTC stamp; the session's time zone has to be UTC. Years have four digits from 0 to 9999; others stand as they are, without a plus."""
    at = F.timestamp_seconds(c(unix_seconds))
    year = F.year(at).cast("string")
    return F.concat(F.when(F.year(at).between(0, 9999), F.lpad(year, 4, "0")).otherwise(year), F.date_format(at, "-MM-dd'T'HH:mm:ss'Z'"))


def single_line(x: str | Column) -> Column:
    return F.replace(F.replace(c(x), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))


def whole_seconds(x: str | Column) -> Column:
    """Rounded half away from zero; 0 where not finite."""
    finite = ~F.isnan(c(x)) & (F.abs(c(x)) < F.lit(float("inf")))
    return F.when(finite, F.round(c(x)).cast("bigint")).otherwise(0)


def minutes(x: str | Column) -> Column:
    """'m:ss', or '' where not finite or not positive."""
    total = whole_seconds(x)
    return F.when((c(x) > 0) & (c(x) < F.lit(float("inf"))), F.format_string("%d:%02d", F.floor(total / 60), total % 60)).otherwise("")


def tenths(x: str | Column) -> Column:
    """One decimal of a double as text, rounded by its exact binary value, ties to the even digit; NaN, inf and -inf by name."""
    size = F.abs(c(x))
    part = size - F.floor(size)  # exact
    passed = reduce(Column.__add__, ((part >= F.lit(edge) if up else part > F.lit(edge)).cast("int") for edge, up in _TENTHS))
    whole = F.floor(size) + F.floor(passed / 10)
    text = F.concat(F.when(c(x) < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), (passed % 10).cast("string"))
    infinite = size == F.lit(float("inf"))
    return F.when(F.isnan(c(x)), "NaN").when(infinite, F.when(c(x) < 0, "-inf").otherwise("inf")).otherwise(text)


def title_or_untitled(x: str | Column = "title") -> Column:
    return F.when(F.coalesce(strip(x), F.lit("")) == "", "Untitled").otherwise(c(x))


def truncated(x: str | Column, size: int) -> Column:
    return F.when(F.length(c(x)) <= size, c(x)).otherwise(F.concat(F.left(c(x), F.lit(max(0, size - 1))), F.lit("…")))


def short_id(x: str | Column) -> Column:
    return F.left(c(x), F.lit(8))


def digest(kind: str, *parts: str | Column) -> Column:
    """A change sentinel: SHA-256 over the kind and the parts, kept apart by x01."""
    return F.sha2(F.concat_ws("\x01", F.lit(kind), *(F.coalesce(c(p).cast("string"), F.lit("")) for p in parts)), 256)


def content_hash(x: str | Column) -> Column:
    return digest("content", x)


def art_hash(url: str | Column) -> Column:
    """'' for no address."""
    return F.when(F.coalesce(c(url), F.lit("")) == "", "").otherwise(digest("art", url))


def webp_art_hash(url: str | Column, settings: str) -> Column:
    return F.when(F.coalesce(c(url), F.lit("")) == "", "").otherwise(digest("webp", url, F.lit(settings)))


def embedded_art_hash(animated: bool, settings: str) -> Column:
    """Over the preview, the still and the settings if previews are embedded and there is one, else the still's."""
    still = art_hash(selected_image_url())
    if not animated:
        return still
    both = digest("webp-embed", "video_cover_url", F.coalesce(selected_image_url(), F.lit("")), F.lit(settings))
    return F.when(F.col("video_cover_url") != "", both).otherwise(still)


def model_label() -> Column:
    both = (F.col("model_name") != "") & (F.col("major_model_version") != "")
    return F.when(both, F.concat("model_name", F.lit(" ("), "major_model_version", F.lit(")"))).otherwise(F.col("model_name"))


def lineage_summary() -> Column:
    """Lines on the parent and on the root, of a clip row with its lineage context."""
    label = F.coalesce(edge_label("edge_type"), F.lit("Derived from"))
    parent = F.when(F.col("parent_id") != "", F.concat(label, F.lit(" "), short_id("parent_id")))
    root = F.when(
        (F.col("root_id") != "") & (F.col("root_id") != F.col("clip_id")),
        F.concat(F.lit("Root "), short_id("root_id"), F.lit(" ("), F.col("root_title"), F.lit(")")),
    )
    return F.concat_ws("\n", parent, root)


def track_metadata(artist: str = UNKNOWN_ARTIST, song_base: str = SONG_BASE, aligned: str | None = None) -> dict[str, Column]:
    """The twenty tag fields of a clip row with its lineage context; aligned: a column of fallback lyrics."""
    name = F.coalesce(present("display_name"), F.lit(artist))
    lyrics = F.col("lyrics")
    if aligned:
        lyrics = F.when((strip("lyrics") == "") & (strip(F.coalesce(aligned, F.lit(""))) != ""), F.col(aligned)).otherwise(lyrics)
    return {
        "title": F.col("title"),
        "artist": name,
        "album": album_title("title", "root_title"),
        "album_artist": name,
        "date": F.left("created_at", F.lit(10)),
        "year": album_year("created_at", "root_date"),
        "lyrics": lyrics,
        "prompt": F.col("prompt"),
        "comment": F.col("gpt_description_prompt"),
        "style": F.col("tags"),
        "style_summary": F.col("gpt_description_prompt"),
        "model": model_label(),
        "handle": F.col("handle"),
        "parent": F.col("parent_id"),
        "root": F.col("root_id"),
        "lineage": lineage_summary(),
        "id": F.col("clip_id"),
        "url": F.when(F.col("clip_id") != "", F.concat(F.lit(song_base + "/"), "clip_id")).otherwise(""),
        "track": F.coalesce(F.col("track"), F.lit(0)),
        "track_total": F.coalesce(F.col("track_total"), F.lit(0)),
    }


def meta_hash(artist: str = UNKNOWN_ARTIST, song_base: str = SONG_BASE) -> Column:
    return digest("meta", *track_metadata(artist, song_base).values())


def details_text(artist: str = UNKNOWN_ARTIST, song_base: str = SONG_BASE) -> Column:
    """Labelled lines of a clip with its lineage context; empty fields are left out."""
    m = track_metadata(artist, song_base)
    fields = [
        ("Title", m["title"]), ("Artist", m["artist"]), ("Album", m["album"]), ("Album Artist", m["album_artist"]), ("Date", m["date"]),
        ("Duration", minutes("duration")), ("Model", m["model"]), ("Handle", m["handle"]), ("Style", m["style"]), ("Style Summary", m["style_summary"]),
        ("Comment", m["comment"]), ("Prompt", m["prompt"]), ("Parent", m["parent"]), ("Root", m["root"]), ("Lineage", m["lineage"]),
        ("Id", m["id"]), ("Url", m["url"]),
    ]
    return F.concat(*(F.when(v == "", "").otherwise(F.concat(F.lit(f"{k}: "), single_line(v), F.lit("\n"))) for k, v in fields))


def owner_gate(allow_change: str | Column = "allow_change") -> Column:
    """Of an account joined to its pin (null: none): what the run may do about who owns it."""
    return (
        F.when(F.col("configured_id").isNotNull() & (F.col("configured_id") != F.col("authed_id")), "abort_config_mismatch")
        .when(F.col("pinned_id").isNull(), "first_use")
        .when(F.col("pinned_id") == F.col("authed_id"), "proceed")
        .when(c(allow_change), "repin")
        .otherwise("abort_mismatch")
    )


def failure_class() -> Column:
    """struct(class, reason) of a landed outcome: status null is a transport error; null class is success."""
    s, full = F.col("status"), F.col("declared_bytes").isNull() | (F.col("declared_bytes") == F.col("body_bytes"))
    kind = (
        F.when(s.isNull(), "transient")
        .when(s.between(200, 299), F.when(~full, "transient"))
        .when(s.isin(401, 403, 408, 429) | s.between(500, 599), "transient")
        .otherwise("permanent")
    )
    reason = (
        F.when(s.isNull(), "transport error")
        .when(s.between(200, 299), F.when(~full, "truncated"))
        .when(s.isin(401, 403), "rejected")
        .when(s == 408, "timeout")
        .when(s == 429, "rate limited")
        .when(s.between(500, 599), "server error")
        .otherwise("failed")
    )
    return F.struct(kind.alias("class"), reason.alias("reason"))
