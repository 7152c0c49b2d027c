"""File names that are safe on any file system, and names of a whole library without collisions."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import written
from .clips import album_title, c, present, strip

# The default template, lengths, and the accents that ascii names fold.
TEMPLATE = "{creator}/{album}/{track2} - {creator}-{title} [{id8}]"
MAX_LENGTH = 80
FOLDED = {
    "A": "ÀÁÂÃÄÅ", "a": "àáâãäå", "C": "Ç", "c": "ç", "E": "ÈÉÊË", "e": "èéêë", "I": "ÌÍÎÏ", "i": "ìíîï", "N": "Ñ", "n": "ñ",
    "O": "ÒÓÔÕÖØ", "o": "òóôõöø", "U": "ÙÚÛÜ", "u": "ùúûü", "Y": "ÝŸ", "y": "ýÿ",
}
PAIRS = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss"}
DEVICES = r"(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])"
SIDECARS = {"cover_jpg": ".jpg", "cover_webp": ".webp", "details_txt": ".details.txt", "lyrics_txt": ".lyrics.txt", "lrc": ".lrc", "video_mp4": ".mp4"}


def _ascii(x: Column) -> Column:
    x = F.translate(x, "".join(FOLDED.values()), "".join(k * len(v) for k, v in FOLDED.items()))
    for one, two in PAIRS.items():
        x = F.replace(x, F.lit(one), F.lit(two))
    return F.regexp_replace(x, r"[^\x00-\x7F]", " ")


def sanitise_component(x: str | Column, charset: str = "unicode", size: int | Column = MAX_LENGTH) -> Column:
    """One path component: no forbidden or control characters, single spaces, no spaces or dots at its ends,
    at most `size` characters, and no device name."""
    size = F.greatest(F.lit(1), F.lit(size) if isinstance(size, int) else size)
    out = _ascii(c(x)) if charset == "ascii" else c(x)
    out = F.regexp_replace(out, r'[<>:"/\\|?*\x00-\x1F\x7F-\x9F]', " ")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    out = F.left(F.trim(out, F.lit(" .")), size)
    return F.regexp_replace(F.trim(out, F.lit(" .")), rf"(?i)^({DEVICES})(?=\.|$)", "$1_")


def creator_name() -> Column:
    return F.coalesce(present(strip("display_name")), present(strip("handle")), F.lit("Unknown Creator"))


def title_name(x: str | Column = "title") -> Column:
    bare = strip(x)
    return F.when((bare == "") | (F.lower(bare) == "untitled"), "Untitled").otherwise(bare)


def sanitise_name(x: str | Column) -> Column:
    return F.coalesce(present(sanitise_component(x)), F.lit("playlist"))


def append_suffix(base: str | Column, suffix: str | Column, charset: str = "unicode", size: int = MAX_LENGTH) -> Column:
    """base with ' [suffix]', cut before the suffix and never through it; once only."""
    mark = F.concat(F.lit(" ["), c(suffix), F.lit("]"))
    top = F.greatest(F.lit(size), F.length(mark) + 1)
    cut = F.left(F.rtrim(sanitise_component(base, charset, top)), top - F.length(mark))
    added = sanitise_component(F.concat(cut, mark), charset, top)
    return F.when(F.endswith(c(base), mark), sanitise_component(base, charset, size)).otherwise(added)


def sanitise_segment(x: Column, marks: list[Column], charset: str = "unicode", size: int = MAX_LENGTH) -> Column:
    """A rendered segment; one of the marks at its end, in brackets, is kept whole."""
    out = sanitise_component(x, charset, size)
    for m in reversed(marks):
        tail = F.concat(F.lit(" ["), m, F.lit("]"))
        base = F.left(x, F.length(x) - F.length(tail))
        out = F.when((m != "") & F.endswith(x, tail), append_suffix(base, m, charset, size)).otherwise(out)
    return out


def render_template(values: dict[str, Column], marks: list[Column], template: str = TEMPLATE, charset: str = "unicode", size: int = MAX_LENGTH) -> Column:
    """The template as a path; an empty value swallows the run of ' -_.' after it, empty segments are dropped."""
    segments = []
    for segment in template.split("/"):
        parts = re.split("(" + "|".join(re.escape("{%s}" % k) for k in sorted(values, key=len, reverse=True)) + ")", segment)
        out = F.lit(parts[0])
        for token, text in zip(parts[1::2], parts[2::2], strict=True):
            value = values[token[1:-1]]
            out = F.concat(out, value, F.when(value == "", text.lstrip(" -_.")).otherwise(text))
        segments.append(present(sanitise_segment(out, marks, charset, size)))
    return F.array_join(F.array_compact(F.array(*segments)), "/")


def placeholder_values(album: Column, charset: str = "unicode", size: int = MAX_LENGTH) -> dict[str, Column]:
    """Values of the nine placeholders for a clip row with its lineage context."""
    clean = lambda x: sanitise_component(x, charset, size)
    plain = lambda x: sanitise_component(x, "ascii", size)
    track = F.coalesce(F.col("track"), F.lit(0))
    return {
        "creator": clean(creator_name()),
        "handle": clean(F.col("handle")),
        "album": album,
        "title": clean(title_name()),
        "root_id8": plain(F.left("root_id", F.lit(8))),
        "id8": plain(F.left("clip_id", F.lit(8))),
        "id": plain(F.col("clip_id")),
        "track": F.when(track > 0, track.cast("string")).otherwise(""),
        "track2": F.when(track > 0, F.lpad(track.cast("string"), F.greatest(F.lit(2), F.length(track.cast("string"))), "0")).otherwise(""),
    }


@F.arrow_udf(T.StringType())
def _folded(paths: pa.Array) -> pa.Array:
    """A batch folded as one text: a NUL parts the paths, with which nothing composes. Lower case by characters knows no final sigma."""
    if paths.null_count == len(paths):
        return paths
    fold = lambda s: unicodedata.normalize("NFC", s).replace("Σ", "σ").lower()
    known = paths.drop_null().to_pylist()
    folded = fold("\0".join(known)).split("\0")
    folded = iter(folded if len(folded) == len(known) else map(fold, known))  # a path may hold a NUL itself
    return pa.array([next(folded) if there else None for there in paths.is_valid().to_pylist()], pa.string())


def canonical_path_key(x: str | Column) -> Column:
    """NFC and lower case, character by character. Spark has no normalisation, so paths beyond ASCII go
    through a vectorised function; the others send it a null and are lowered in place."""
    ascii_only = F.regexp_like(c(x), F.lit(r"^[\x00-\x7F]*$"))
    return F.coalesce(F.when(ascii_only, F.lower(c(x))), _folded(F.when(~ascii_only, c(x))))


def parent_dir(x: str | Column) -> Column:
    return F.regexp_extract(c(x), r"(?s)^(.*)/[^/]*$", 1)


def file_name(x: str | Column) -> Column:
    return F.substring_index(c(x), "/", -1)


def set_file_name(path: str | Column, name: Column) -> Column:
    d = parent_dir(path)
    return F.when(d == "", name).otherwise(F.concat(d, F.lit("/"), name))


def audio_base(path: str | Column, extension: str | Column) -> Column:
    """The path without its extension; null if it does not have that one."""
    tail = F.concat(F.lit("."), c(extension))
    return F.when(F.endswith(c(path), tail), F.left(c(path), F.length(c(path)) - F.length(tail)))


def relocated_stem_path(base: str | Column, old: str | Column) -> Column:
    """The stem's file under another base; null if it is in no stems folder."""
    inner = F.regexp_extract(c(old), r"(?s)^.*\.stems/(.*)$", 1)
    return F.when(F.contains(c(old), F.lit(".stems/")), F.concat(c(base), F.lit(".stems/"), inner))


def relocated_stem_key(base_key: str | Column, old: str | Column, old_key: str | Column) -> Column:
    """The canonical key of relocated_stem_path, from the keys of its parts. Slashes compose with nothing and stay as many as they are."""
    inner = F.regexp_extract(c(old), r"(?s)^.*\.stems/(.*)$", 1)
    parts = F.length(inner) - F.length(F.replace(inner, F.lit("/"))) + 1
    moved = F.concat(c(base_key), F.lit(".stems/"), F.call_function("substring_index", c(old_key), F.lit("/"), -parts))
    return F.when(F.contains(c(old), F.lit(".stems/")), moved)


def relative_path(x: str | Column) -> Column:
    """Without empty, '.' and '..' components."""
    return F.array_join(F.filter(F.split(c(x), "/"), lambda p: ~p.isin("", ".", "..")), "/")


def clean_extension(x: str | Column) -> Column:
    return F.coalesce(present(F.left(F.lower(F.regexp_replace(F.regexp_replace(c(x), r"^\.+", ""), "[^A-Za-z0-9]", "")), F.lit(8))), F.lit("mp3"))


def stem_file_path(base: str | Column, label: str | Column, stem_id: str | Column, extension: str | Column, charset: str = "unicode") -> Column:
    song, clean = file_name(base), sanitise_component(label, charset)
    id8 = sanitise_component(F.left(c(stem_id), F.lit(8)), "ascii")
    name = F.concat(song, F.when(clean == "", "").otherwise(F.concat(F.lit(" - "), clean)), F.when(id8 == "", "").otherwise(F.concat(F.lit(" ["), id8, F.lit("]"))))
    name = F.when(strip(name) == "", "stem").otherwise(name)
    return F.concat(c(base), F.lit(".stems/"), name, F.lit("."), clean_extension(extension))


def colliding_clip_ids(nodes: DataFrame) -> DataFrame:
    """(account_id, clip_id) of archived clips that share their first 8 characters, case aside, with another."""
    rows = nodes.select("account_id", "clip_id").distinct().withColumn("id8", F.lower(F.left("clip_id", F.lit(8))))
    shared = rows.groupBy("account_id", "id8").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(shared, ["account_id", "id8"], "left_semi").select("account_id", "clip_id")


def render_names(
    clips: DataFrame, colliding_titles: DataFrame, colliding_ids: DataFrame, template: str = TEMPLATE, charset: str = "unicode", size: int = MAX_LENGTH
) -> DataFrame:
    """Clips with lineage context -> (account_id, clip_id, path), no two of an account on one path.

    The album gets the root's short id if its title is shared; then the full clip id is appended to clips
    whose short id is shared in the archive, then to clips that still share a path, then to those that
    share one but for case or composition.
    """
    raw_album = album_title(title_name(), "root_title")
    rows = clips.withColumn("_raw", strip(raw_album)).join(
        colliding_titles.select("account_id", F.col("title").alias("_raw"), F.lit(True).alias("_shared_title")), ["account_id", "_raw"], "left"
    )
    rows = rows.join(colliding_ids.select("account_id", "clip_id", F.lit(True).alias("_shared_id")), ["account_id", "clip_id"], "left")
    album = sanitise_component(raw_album, charset, size)
    album = F.when(F.col("_shared_title"), append_suffix(album, F.left("root_id", F.lit(8)), charset, size)).otherwise(album)
    values = placeholder_values(F.col("_album"), charset, size)
    rows = rows.withColumn("_album", album).withColumns({f"_v_{k}": v for k, v in values.items()})
    ready = {k: F.col(f"_v_{k}") for k in values}
    path = render_template(ready, [ready["id8"], ready["root_id8"]], template, charset, size)
    path = F.coalesce(present(path), present(ready["title"]), append_suffix(F.lit(""), "clip_id", charset, size))
    rows = rows.select("account_id", "clip_id", "_shared_id", path.alias("path"))
    longer = set_file_name("path", append_suffix(file_name("path"), "clip_id", charset, size))
    rows = rows.withColumn("path", F.when(F.col("_shared_id"), longer).otherwise(F.col("path"))).drop("_shared_id")
    rows = _parted(rows.withColumn("_key", F.col("path")), longer)
    return _parted(rows.withColumn("_key", canonical_path_key("path")), longer)


def _parted(rows: DataFrame, longer: Column) -> DataFrame:
    """(account_id, clip_id, path, _key) -> (account_id, clip_id, path): the longer path where several rows of an account share the key.

    Hashes of keys are counted first, so that only rows that may share one are compared, and get a longer name made.
    """
    rows = written(rows.withColumn("_hash", F.xxhash64("_key")), "names")
    shared = rows.groupBy("account_id", "_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("account_id", "_hash")
    few = rows.join(shared, ["account_id", "_hash"], "left_semi")
    several = F.count("*").over(Window.partitionBy("account_id", "_key")) > 1
    few = few.withColumn("_several", several).select("account_id", "clip_id", F.when(F.col("_several"), longer).otherwise(F.col("path")).alias("path"))
    return rows.join(shared, ["account_id", "_hash"], "left_anti").select("account_id", "clip_id", "path").unionByName(few)
