"""Decoding of landed payloads. A missing key or a wrong type gives the default, never an error.

Payloads are strings of JSON; they are parsed once into VARIANT and read by typed accessors that check
the stored type first, since a plain variant cast would turn 91.5 into 91 and "true" into true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clips import cdn_audio_url, is_downloadable, mp3_url, present, stem_label
from ..operators.select import dedupe_first

MAX_PAGES = 100


def typed(v: Column, path: str, kind: str) -> Column:
    """The value at the path if it is of that kind (string, boolean, number, array), else null."""
    at = F.try_variant_get(v, path, "variant")
    schema = F.schema_of_variant(at)
    if kind == "number":
        ok = schema.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    else:
        ok = schema.startswith({"string": "STRING", "boolean": "BOOLEAN", "array": "ARRAY"}[kind])
    return F.when(ok, at)


def str_field(v: Column, path: str, default: str | None = "") -> Column:
    out = F.try_variant_get(typed(v, path, "string"), "$", "string")
    return out if default is None else F.coalesce(out, F.lit(default))


def str_or(v: Column, first: str, second: str) -> Column:
    return F.coalesce(present(str_field(v, first)), str_field(v, second))


def bool_field(v: Column, path: str, default: bool | None = False) -> Column:
    out = F.try_variant_get(typed(v, path, "boolean"), "$", "boolean")
    return out if default is None else F.coalesce(out, F.lit(default))


def number(v: Column, path: str) -> Column:
    return F.try_variant_get(typed(v, path, "number"), "$", "double")


def int_tolerant(v: Column, path: str) -> Column:
    """The integer, also of an integral float; null for 91.5 and for other types."""
    x = number(v, path)
    exact = F.try_variant_get(typed(v, path, "number"), "$", "bigint")
    return F.when(x == F.floor(x), exact)


def count_field(v: Column, path: str) -> Column:
    """A whole number that is not negative and was not written with a fraction, else null."""
    at = typed(v, path, "number")
    x = F.try_variant_get(at, "$", "bigint")
    return F.when(F.schema_of_variant(at).rlike(r"^BIGINT") & (x >= 0), x)


def text_integer(v: Column, path: str) -> Column:
    """An integer given as number or as text ('2450', '2450.0'); floats of 2**53 and more are refused."""
    x = number(v, path)
    fits = F.schema_of_variant(typed(v, path, "number")).rlike("^BIGINT") | ((x == F.floor(x)) & (F.abs(x) < float(1 << 53)))
    text = str_field(v, path, None)
    whole = F.regexp_extract(text, r"^([+-]?\d+)(?:\.0*)?$", 1)
    return F.coalesce(F.when(fits, F.try_variant_get(typed(v, path, "number"), "$", "bigint")), whole.try_cast("bigint"))


def items(v: Column, path: str = "$") -> Column:
    """The elements of the array at the path; no array: none."""
    return F.coalesce(F.try_variant_get(typed(v, path, "array"), "$", "array<variant>"), F.array().cast("array<variant>"))


def host_rewritten(url: Column, hosts: dict[str, str] | None) -> Column:
    for old, new in (hosts or {}).items():
        url = F.replace(url, F.lit(old), F.lit(new))
    return url


def _history(v: Column, path: str) -> Column:
    """Elements that are a bare id or an object."""
    one = lambda e: F.struct(
        F.coalesce(str_field(e, "$", None), str_field(e, "$.id")).alias("id"), bool_field(e, "$.infill").alias("infill"), number(e, "$.continue_at").alias("continue_at"), number(e, "$.infill_start_s").alias("infill_start_s"),
        number(e, "$.infill_end_s").alias("infill_end_s"), str_field(e, "$.infill_lyrics").alias("infill_lyrics"),
    )
    return F.transform(items(v, path), one)


def clip_columns(v: Column, hosts: dict[str, str] | None = None) -> dict[str, Column]:
    """Columns of a clip from one raw object."""
    top = lambda k: str_field(v, f"$.{k}")
    meta = lambda k: str_field(v, f"$.metadata.{k}")
    url = lambda k: host_rewritten(top(k), hosts)
    media = lambda m: F.struct(*(str_field(m, f"$.{k}").alias(k) for k in ("url", "content_type", "delivery", "encoding")))
    root = lambda r: F.struct(
        str_field(r, "$.id").alias("id"), str_field(r, "$.title").alias("title"), host_rewritten(str_field(r, "$.image_url"), hosts).alias("image_url"), bool_field(r, "$.is_public").alias("is_public"),
        str_field(r, "$.user_display_name").alias("display_name"), str_field(r, "$.user_handle").alias("handle"), str_field(r, "$.user_avatar_image_url").alias("avatar_image_url"),
    )
    out = {"clip_id": top("id"), "title": str_field(v, "$.title", "Untitled"), "audio_url": cdn_audio_url(top("audio_url"), top("id")), "media_urls": F.transform(items(v, "$.media_urls"), media)}
    out |= {k: url(k) for k in ("image_url", "image_large_url", "video_url", "video_cover_url")}
    out |= {"duration": F.coalesce(number(v, "$.metadata.duration"), F.lit(0.0)), "play_count": F.coalesce(count_field(v, "$.play_count"), F.lit(0)), "status": str_field(v, "$.status", "unknown")}
    out |= {k: top(k) for k in ("created_at", "user_id", "lyrics", "model_name", "major_model_version")}
    out |= {k: str_or(v, f"$.{k}", f"$.user_{k}") for k in ("display_name", "handle", "avatar_image_url")}
    out |= {"batch_index": F.when(F.schema_of_variant(typed(v, "$.batch_index", "number")).rlike("^BIGINT"), int_tolerant(v, "$.batch_index"))}
    out |= {k: bool_field(v, f"$.{k}") for k in ("is_liked", "is_trashed")} | {k: bool_field(v, f"$.metadata.{k}") for k in ("has_vocal", "has_stem", "is_remix")}
    out |= {k: meta(k) for k in ("tags", "task", "prompt", "gpt_description_prompt", "stem_from_id", "stem_task", "stem_type_group_name", "edited_clip_id", "cover_clip_id", "upsample_clip_id",
                                 "remaster_clip_id", "speed_clip_id", "override_history_clip_id", "override_future_clip_id")}
    out |= {"clip_type": meta("type"), "stem_type_id": int_tolerant(v, "$.metadata.stem_type_id"), "history": _history(v, "$.metadata.history"), "concat_history": _history(v, "$.metadata.concat_history")}
    return out | {"clip_roots": F.transform(items(v, "$.clip_roots.clips"), root), "clip_attribution_type": str_field(v, "$.clip_roots.clip_attribution_type")}


def unwrap_clip(v: Column) -> Column:
    """The object under 'clip', or the object itself."""
    return F.coalesce(F.try_variant_get(v, "$.clip", "variant"), v)


def decode_clips(raw: DataFrame, payload: str = "payload", hosts: dict[str, str] | None = None) -> DataFrame:
    """Rows with a JSON payload of one clip, bare, wrapped, or a batch {"clips": [...]} -> a row per clip with an id."""
    v = raw.withColumn("_v", F.try_parse_json(payload))
    each = F.when(F.size(items(F.col("_v"), "$.clips")) > 0, items(F.col("_v"), "$.clips")).otherwise(F.array(unwrap_clip(F.col("_v"))))
    rows = v.withColumn("_c", F.explode(each))
    keep = [c for c in raw.columns if c != payload]
    return rows.select(*keep, *(x.alias(k) for k, x in clip_columns(F.col("_c"), hosts).items())).where("clip_id <> ''")


def decode_feed_pages(pages: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(keys…, payload) -> clips that can be downloaded, and per page has_more, next_cursor and any_filtered."""
    keys = [c for c in pages.columns if c != payload]
    rows = pages.withColumn("_v", F.try_parse_json(payload)).withColumn("_clips", items(F.col("_v"), "$.clips"))
    clips = rows.select(*keys, F.posexplode("_clips").alias("pos", "_c"))
    clips = clips.select(*keys, "pos", *(x.alias(k) for k, x in clip_columns(F.col("_c")).items())).where(is_downloadable() & (F.col("clip_id") != ""))
    good = F.filter("_clips", lambda c: (str_field(c, "$.id") != "") & _downloadable(c))
    status = rows.select(
        *keys, bool_field(F.col("_v"), "$.has_more", None).alias("has_more"), present(str_field(F.col("_v"), "$.next_cursor")).alias("next_cursor"), (F.size(good) < F.size("_clips")).alias("any_filtered"), F.size(good).alias("n_clips")
    )
    return clips, status


def _downloadable(c: Column) -> Column:
    kind, task = str_field(c, "$.metadata.type"), str_field(c, "$.metadata.task")
    return (str_field(c, "$.status", "unknown") == "complete") & (kind != "rendered_context_window") & ~task.isin("infill", "fixed_infill")


def feed_completeness(status: DataFrame, walk: list[str], limit: int | None = None) -> DataFrame:
    """Page status (walk keys…, page, has_more, next_cursor, any_filtered, n_clips) -> per walk complete and any_filtered.

    A walk is complete if its last page says that there is no more, and every earlier one named a next
    page; pages beyond the cap or after the limit of clips was reached do not count.
    """
    at = Window.partitionBy(*walk).orderBy("page")
    before = F.coalesce(F.sum("n_clips").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.coalesce(F.bool_and(F.coalesce(F.col("has_more") & F.col("next_cursor").isNotNull(), F.lit(False))).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    rows = status.withColumns({"_n": F.row_number().over(at), "_before": before, "_open": open_}).where((F.col("_n") <= MAX_PAGES) & F.col("_open"))
    if limit is not None:
        rows = rows.where((F.col("_n") == 1) | (F.col("_before") < limit))
    return rows.groupBy(*walk).agg(F.bool_or(F.coalesce(~F.col("has_more"), F.lit(False))).alias("complete"), F.bool_or("any_filtered").alias("any_filtered"))


def decode_playlists(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """(account_id, page, payload) -> (account_id, playlist_id, name, num_clips), the first of each id."""
    rows = pages.select("account_id", "page", F.posexplode(items(F.try_parse_json(payload), "$.playlists")).alias("pos", "_p"))
    p = F.col("_p")
    rows = rows.select("account_id", "page", "pos", str_field(p, "$.id").alias("playlist_id"), F.coalesce(present(str_field(p, "$.name")), F.lit("Untitled")).alias("name"), F.coalesce(count_field(p, "$.num_total_results"), F.lit(0)).alias("num_clips"))
    return dedupe_first(rows, ["account_id", "playlist_id"], ["page", "pos"]).select("account_id", "playlist_id", "name", "num_clips")


def decode_playlist_members(raw: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(keys…, payload) -> members with pos, and per payload complete: the reported total is the number of
    entries, and none of them lost its id."""
    keys = [c for c in raw.columns if c != payload]
    rows = raw.withColumn("_v", F.try_parse_json(payload)).withColumn("_m", items(F.col("_v"), "$.playlist_clips"))
    members = rows.select(*keys, F.posexplode("_m").alias("pos", "_e")).select(*keys, "pos", *(x.alias(k) for k, x in clip_columns(unwrap_clip(F.col("_e"))).items())).where("clip_id <> ''")
    named = F.size(F.filter("_m", lambda e: str_field(unwrap_clip(e), "$.id") != ""))
    total = count_field(F.col("_v"), "$.num_total_results")
    complete = F.coalesce((total == F.size("_m")) & (named == F.size("_m")), F.lit(False))
    return members, rows.select(*keys, complete.alias("complete"))


def decode_stems(pages: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(account_id, clip_id, page, payload) -> stems (the first of each address), and per clip complete: all of 1 to 100
    declared pages are there and hold a stem."""
    rows = pages.withColumn("_v", F.try_parse_json(payload)).withColumn("_s", F.when(F.size(items(F.col("_v"))) > 0, items(F.col("_v"))).otherwise(items(F.col("_v"), "$.stems")))
    each = rows.select("account_id", F.col("clip_id").alias("_of"), "page", F.posexplode("_s").alias("pos", "_c"))
    each = each.select("account_id", "_of", "page", "pos", *(x.alias(k) for k, x in clip_columns(F.col("_c")).items()))
    stems = each.select("account_id", F.col("_of").alias("clip_id"), "page", "pos", F.col("clip_id").alias("stem_id"), stem_label().alias("label"), mp3_url().alias("url")).where("stem_id <> '' and url <> ''")
    stems = dedupe_first(stems, ["account_id", "clip_id", "url"], ["page", "pos"])
    declared = F.coalesce(F.max(count_field(F.col("_v"), "$.pages")), F.lit(0))
    status = rows.groupBy("account_id", "clip_id").agg(declared.alias("pages"), F.countDistinct("page").alias("_have")).join(
        stems.groupBy("account_id", "clip_id").agg(F.count("*").alias("n_stems")), ["account_id", "clip_id"], "left"
    )
    complete = F.col("pages").between(1, MAX_PAGES) & (F.col("_have") >= F.col("pages")) & (F.coalesce("n_stems", F.lit(0)) > 0)
    return stems, status.select("account_id", "clip_id", complete.alias("complete"), F.coalesce("n_stems", F.lit(0)).alias("n_stems"))


def decode_aligned_lyrics(raw: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(keys…, payload) -> lyric_lines and lyric_words; a bad body has neither."""
    keys = [c for c in raw.columns if c != payload]
    rows = raw.withColumn("_v", F.try_parse_json(payload))
    word = lambda w: F.struct(str_field(w, "$.text").alias("text"), F.coalesce(number(w, "$.start_s"), F.lit(0.0)).alias("start_s"), F.coalesce(number(w, "$.end_s"), F.lit(0.0)).alias("end_s"))
    line = F.col("_l")
    lines = rows.select(*keys, F.posexplode(items(F.col("_v"), "$.aligned_lyrics")).alias("line_no", "_l")).select(
        *keys, "line_no", str_field(line, "$.text").alias("text"), F.coalesce(number(line, "$.start_s"), F.lit(0.0)).alias("start_s"), F.coalesce(number(line, "$.end_s"), F.lit(0.0)).alias("end_s"),
        str_field(line, "$.section").alias("section"), F.transform(items(line, "$.words"), word).alias("words"),
    )
    w = F.col("_w")
    words = rows.select(*keys, F.posexplode(items(F.col("_v"), "$.aligned_words")).alias("word_no", "_w")).select(
        *keys, "word_no", str_field(w, "$.word").alias("word"), bool_field(w, "$.success").alias("success"), F.coalesce(number(w, "$.start_s"), F.lit(0.0)).alias("start_s"), F.coalesce(number(w, "$.end_s"), F.lit(0.0)).alias("end_s"),
        F.coalesce(number(w, "$.p_align"), F.lit(0.0)).alias("p_align"),
    )
    return lines, words


def decode_accounts(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(account_id, payload) -> credits, limits, tri-state flags, features and whether those are known."""
    v = F.col("_v")
    names = lambda path: F.transform(items(v, path), lambda f: str_field(f, "$.name"))
    features = F.array_sort(F.filter(F.array_union(names("$.accessible_features"), names("$.plan.usage_plan_features")), lambda x: x != ""))
    known = typed(v, "$.accessible_features", "array").isNotNull() | typed(v, "$.plan.usage_plan_features", "array").isNotNull()
    rows = raw.withColumn("_v", F.try_parse_json(payload))
    return rows.select(
        "account_id", *(text_integer(v, f"$.{k}").alias(n) for k, n in (("total_credits_left", "credits_left"), ("monthly_limit", "monthly_limit"), ("monthly_usage", "monthly_usage"))), present(str_field(v, "$.period")).alias("period"),
        *(bool_field(v, f"$.{k}", None).alias(k) for k in ("is_active", "is_paused", "is_past_due")), features.alias("features"), known.alias("features_known"),
    )
