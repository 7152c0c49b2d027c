"""Queries of the decoders over payloads that Spark makes from the tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import ingest, state
from .roles import role, with_roles
from .scalars import clips as clip_rows

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_roles(sql)
        return f

    return add


def list_of(o):
    """Lists of bounded size; their number grows with the orders."""
    return (F.floor(o / 12000) * 12 + o % 12).cast("int")


def raw_clips(spark, sf_dir):
    """Each clip as a JSON object in the service's layout; some keys are missing, misnamed or of a wrong type."""
    rows = clip_rows(spark, sf_dir)
    o = F.col("ord")
    meta = F.struct(
        "tags", "duration", "task", F.col("clip_type").alias("type"), "edited_clip_id", "cover_clip_id", "has_stem", (F.col("ord") % 7).cast("double").alias("stem_type_id"),
        F.when(o % 2 == 0, F.transform("history", lambda h: h["id"])).alias("history"),
    )
    top = F.struct(
        F.when(o % 47 != 0, F.col("clip_id")).alias("id"), F.when(o % 4 != 1, F.col("title")).alias("title"), F.when(o % 6 != 0, F.col("status")).alias("status"), "created_at", "play_count", F.when(o % 3 == 0, F.col("display_name")).alias("display_name"),
        F.col("display_name").alias("user_display_name"), "audio_url", "media_urls", meta.alias("metadata"), F.when(o % 5 == 0, F.lit("true")).alias("is_liked"), F.when(o % 5 != 0, F.col("is_trashed")).alias("is_trashed"),
    )
    return rows.select("account_id", "ord", F.to_json(top).alias("payload"))


@query(
    "a01_decode_clips",
    """SELECT account_id, clip_id, CASE WHEN ord % 4 = 1 THEN 'Untitled' ELSE title END AS title, CASE WHEN ord % 6 = 0 THEN 'unknown' ELSE status END AS status, CASE WHEN ord % 3 = 0 AND display_name <> '' THEN display_name ELSE display_name END AS display_name,
        tags, duration, play_count, task, clip_type, edited_clip_id, FALSE AS is_liked, ord % 5 <> 0 AND is_trashed AS is_trashed, CAST(ord % 7 AS BIGINT) AS stem_type_id, CASE WHEN ord % 2 = 0 AND history_id <> '' THEN history_id ELSE '' END AS first_history FROM {clips} WHERE ord % 47 <> 0""",
)
def a01(spark, sf_dir):
    rows = ingest.decode_clips(raw_clips(spark, sf_dir))
    first = F.coalesce(F.get("history", F.lit(0))["id"], F.lit(""))
    return rows.select("account_id", "clip_id", "title", "status", "display_name", "tags", "duration", "play_count", "task", "clip_type", "edited_clip_id", "is_liked", "is_trashed", "stem_type_id", first.alias("first_history"))


@query("a02_unwrap_and_batch", "SELECT account_id, clip_id, CASE ord % 3 WHEN 0 THEN 'bare' WHEN 1 THEN 'wrapped' ELSE 'batch' END AS form FROM {clips} WHERE ord % 47 <> 0")
def a02(spark, sf_dir):
    o = F.col("ord")
    wrapped = F.when(o % 3 == 0, F.col("payload")).when(o % 3 == 1, F.concat(F.lit('{"clip":'), "payload", F.lit("}"))).otherwise(F.concat(F.lit('{"clips":['), "payload", F.lit("]}")))
    form = F.when(o % 3 == 0, "bare").when(o % 3 == 1, "wrapped").otherwise("batch")
    return ingest.decode_clips(raw_clips(spark, sf_dir).withColumns({"form": form, "payload": wrapped})).select("account_id", "clip_id", "form")


@query(
    "a03_typed_fields",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS BIGINT) WHEN event_id % 3 = 1 THEN CAST(event_id AS BIGINT) END AS tolerant, CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 ELSE FALSE END AS flag, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS name FROM events""",
)
def a03(spark, sf_dir):
    e = F.col("event_id").cast("string")
    n = F.when(F.col("event_id") % 3 == 0, e).when(F.col("event_id") % 3 == 1, F.concat(e, F.lit(".0"))).otherwise(F.concat(e, F.lit(".5")))
    flag = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 8 == 0).cast("string")).otherwise('"true"')
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise("7")
    body = F.concat(F.lit('{"p":'), "props", F.lit(',"n":'), n, F.lit(',"f":'), flag, F.lit(',"s":'), name, F.lit("}"))
    rows = role(spark, sf_dir, "events").select("event_id", F.try_parse_json(body).alias("v"))
    v = F.col("v")
    return rows.select("event_id", ingest.int_tolerant(v, "$.p.k").alias("k"), ingest.int_tolerant(v, "$.n").alias("tolerant"), ingest.bool_field(v, "$.f").alias("flag"), ingest.str_field(v, "$.s").alias("name"))


def feed_pages(spark, sf_dir):
    """Pages of each account's clips, 40 orders a page; the last page of every third account is missing its end."""
    page = F.floor(F.col("ord") / 400).cast("int").alias("page")
    raw = raw_clips(spark, sf_dir).select("account_id", page, "ord", "payload")
    pages = raw.groupBy("account_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "payload"))), lambda x: x["payload"]), ",").alias("body"))
    last = role(spark, sf_dir, "clips").select("account_id", page).groupBy("account_id").agg(F.max("page").alias("last"))  # no payload is made for it
    pages = pages.join(last, "account_id")
    end = F.when(F.col("page") < F.col("last"), F.when(F.col("account_id").cast("int") % 5 == 4, '"has_more":true').otherwise('"has_more":true,"next_cursor":"c"')).when(F.col("account_id").cast("int") % 3 == 0, '"has_more":"no"').otherwise('"has_more":false')
    return pages.select("account_id", "page", F.concat(F.lit('{"clips":['), "body", F.lit("],"), end, F.lit("}")).alias("payload"))


_GOOD = "ord % 47 <> 0 AND CASE WHEN ord % 6 = 0 THEN 'unknown' ELSE status END = 'complete' AND clip_type <> 'rendered_context_window' AND task NOT IN ('infill', 'fixed_infill')"
PAGES_SQL = f"""SELECT account_id, ord // 400 AS page, count(*) AS n, count(*) FILTER (WHERE {_GOOD}) AS good FROM {{clips}} GROUP BY ALL"""


@query("a05_decode_feed_pages", f"SELECT account_id, CAST(page AS INTEGER) AS page, good < n AS any_filtered, CAST(good AS INTEGER) AS n_clips FROM ({PAGES_SQL})")
def a05(spark, sf_dir):
    return ingest.decode_feed_pages(feed_pages(spark, sf_dir))[1].select("account_id", "page", "any_filtered", "n_clips")


@query("a05_feed_clips", f"SELECT account_id, clip_id FROM {{clips}} WHERE {_GOOD}")
def a05b(spark, sf_dir):
    return ingest.decode_feed_pages(feed_pages(spark, sf_dir))[0].select("account_id", "clip_id")


@query(
    "a06_feed_completeness",
    f"""WITH p AS ({PAGES_SQL}), w AS (SELECT account_id, count(*) AS pages, bool_or(good < n) AS lost, min_by(good < n, page) AS first_lost FROM p GROUP BY account_id)
        SELECT account_id, CAST(account_id AS INTEGER) % 3 <> 0 AND NOT (CAST(account_id AS INTEGER) % 5 = 4 AND pages > 1) AS complete, CASE WHEN CAST(account_id AS INTEGER) % 5 = 4 THEN first_lost ELSE lost END AS any_filtered FROM w""",
)
def a06(spark, sf_dir):
    return ingest.feed_completeness(ingest.decode_feed_pages(feed_pages(spark, sf_dir))[1], ["account_id"])


@query(
    "a07_decode_playlists",
    "SELECT account_id, playlist_id, CASE WHEN p % 6 = 0 THEN 'Untitled' ELSE name END AS name, CASE WHEN p % 4 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(p AS BIGINT) END AS num_clips FROM {playlists} WHERE p % 9 <> 0",
)
def a07(spark, sf_dir):
    p = F.col("p")
    one = F.to_json(F.struct(F.when(p % 9 != 0, F.col("playlist_id")).alias("id"), F.when(p % 6 != 0, F.col("name")).alias("name"), F.when(p % 4 != 0, p).alias("num_total_results")))
    rows = role(spark, sf_dir, "playlists").groupBy("account_id", (p % 3).alias("page")).agg(F.concat(F.lit('{"playlists":['), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("payload"))
    again = rows.withColumns({"page": F.col("page") + 10, "payload": F.replace("payload", F.lit("Brand"), F.lit("Brand"))})
    return ingest.decode_playlists(rows.unionByName(again))


@query(
    "a08_decode_playlist_members",
    "SELECT account_id, list, NOT lost AND list % 4 <> 0 AND list % 5 <> 0 AS complete, n FROM (SELECT account_id, CAST(ord // 12000 * 12 + ord % 12 AS INTEGER) AS list, bool_or(ord % 47 = 0) AS lost, count(*) FILTER (WHERE ord % 47 <> 0) AS n FROM {clips} GROUP BY account_id, CAST(ord // 12000 * 12 + ord % 12 AS INTEGER))",
)
def a08(spark, sf_dir):
    rows = raw_clips(spark, sf_dir).groupBy("account_id", list_of(F.col("ord")).alias("list")).agg(F.array_join(F.transform(F.collect_list("payload"), lambda x: F.concat(F.lit('{"clip":'), x, F.lit("}"))), ",").alias("b"), F.count("*").alias("n"))
    k = F.col("list")
    total = F.when(k % 4 == 0, F.col("n") + 1).otherwise(F.col("n")).cast("string")
    body = F.concat(F.lit('{"playlist_clips":['), "b", F.lit("]"), F.when(k % 5 != 0, F.concat(F.lit(',"num_total_results":'), total)).otherwise(""), F.lit("}"))
    members, status = ingest.decode_playlist_members(rows.select("account_id", "list", body.alias("payload")))
    return status.join(members.groupBy("account_id", "list").agg(F.count("*").alias("n")), ["account_id", "list"], "left").select("account_id", "list", "complete", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "a11_decode_accounts",
    """SELECT account_id, credits_left, CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k * 10 AS BIGINT) END AS monthly_limit, is_past_due, is_paused, is_active, CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN 'a,b' WHEN k % 4 = 2 THEN 'b,c' ELSE 'a,b,c' END AS features, k % 4 <> 0 AS features_known FROM {accounts}""",
)
def a11(spark, sf_dir):
    k = F.col("k")
    feature = lambda *names: F.array(*(F.struct(F.lit(n).alias("name")) for n in names))
    plan = F.struct(F.when(k % 4 >= 2, feature("b", "c", "")).alias("usage_plan_features"))
    limit = F.when(k % 3 == 0, F.concat((k * 10).cast("string"), F.lit(".5"))).otherwise(F.concat((k * 10).cast("string"), F.lit(".00")))
    body = F.to_json(F.struct(F.col("credits_left").alias("total_credits_left"), limit.alias("monthly_limit"), "is_past_due", "is_paused", "is_active", F.when(k % 4 % 2 == 1, feature("a", "b")).alias("accessible_features"), plan.alias("plan")))
    rows = ingest.decode_accounts(role(spark, sf_dir, "accounts").select("account_id", body.alias("payload")))
    return rows.select("account_id", "credits_left", "monthly_limit", "is_past_due", "is_paused", "is_active", F.array_join("features", ",").alias("features"), "features_known")


@query(
    "a09_decode_stems",
    """WITH s AS (SELECT account_id, CAST(ord // 12000 * 12 + ord % 12 AS INTEGER) AS list, CAST(ord % 24 // 12 AS INTEGER) AS page, ord FROM {clips}),
        kept AS (SELECT account_id, list, CAST(ord % 36 AS INTEGER) AS k, min(page) AS page FROM s WHERE ord % 5 <> 0 GROUP BY account_id, list, CAST(ord % 36 AS INTEGER)),
        found AS (SELECT account_id, list, count(DISTINCT page) AS have FROM s GROUP BY account_id, list),
        status AS (SELECT account_id, list, have >= CASE WHEN list % 4 = 0 THEN 3 ELSE 2 END AND list % 4 <> 1 AS whole FROM found)
        SELECT account_id, 'l' || list AS clip_id, 's' || k AS stem_id, 'https://stems.example/' || k || '.mp3' AS url, page, coalesce(whole AND k IS NOT NULL, FALSE) AS complete,
        count(k) OVER (PARTITION BY account_id, list) AS n_stems FROM status LEFT JOIN kept USING (account_id, list)""",
)
def a09(spark, sf_dir):
    o = F.col("ord")
    k = (o % 36).cast("int").cast("string")
    one = F.to_json(F.struct(F.when(o % 5 != 0, F.concat(F.lit("s"), k)).alias("id"), F.concat(F.lit("https://stems.example/"), k, F.lit(".mp3")).alias("audio_url")))
    pages = role(spark, sf_dir, "clips").groupBy("account_id", list_of(o).alias("list"), (o % 24 / 12).cast("int").alias("page")).agg(F.array_join(F.collect_list(one), ",").alias("b"))
    form = F.col("list") % 4
    body = F.concat(F.lit('{"pages":'), F.when(form == 0, "3").when(form == 1, "101").otherwise("2"), F.lit(',"stems":['), "b", F.lit("]}"))
    stems, status = ingest.decode_stems(pages.select("account_id", F.concat(F.lit("l"), F.col("list").cast("string")).alias("clip_id"), "page", body.alias("payload")))
    rows = status.join(stems.select("account_id", "clip_id", "stem_id", "url", "page"), ["account_id", "clip_id"], "left")
    return rows.select("account_id", "clip_id", "stem_id", "url", "page", "complete", F.col("n_stems").cast("bigint").alias("n_stems"))


@query(
    "a10_decode_aligned_lyrics",
    """SELECT account_id, ord, n AS line_no, CASE WHEN n = 0 THEN coalesce(title, '') ELSE '' END AS text, CAST(CASE WHEN n = 0 AND ord % 3 <> 0 THEN ord / 2.0 ELSE 0 END AS DOUBLE) AS start_s,
        CASE WHEN n = 0 THEN 'verse' ELSE '' END AS section, CASE WHEN n = 0 THEN clip_id ELSE '' END AS words, CASE WHEN ord % 4 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS n_flat
        FROM {clips}, (SELECT unnest([0, 1]) AS n) WHERE ord % 11 <> 0""",
)
def a10(spark, sf_dir):
    o = F.col("ord")
    word = F.struct(F.col("clip_id").alias("text"), F.lit(1.5).alias("start_s"))
    first = F.to_json(F.struct(F.col("title").alias("text"), F.when(o % 3 != 0, o / F.lit(2.0)).alias("start_s"), F.lit("verse").alias("section"), F.array(word).alias("words")))
    flat = F.when(o % 4 == 0, "7").otherwise(F.concat(F.lit('[{"success":true,"word":'), F.to_json(F.struct("clip_id")), F.lit("}]")))
    body = F.concat(F.lit('{"aligned_lyrics":['), first, F.lit(',{"text":7,"words":false}],"aligned_words":'), flat, F.lit("}"))
    raw = role(spark, sf_dir, "clips").select("account_id", "ord", F.when(o % 11 == 0, F.concat(F.lit("{"), body)).otherwise(body).alias("payload"))
    lines, words = ingest.decode_aligned_lyrics(raw)
    flat_words = words.groupBy("account_id", "ord").agg(F.count("*").alias("n_flat"))
    text = F.coalesce(F.array_join(F.transform("words", lambda w: w["text"]), " "), F.lit(""))
    return lines.join(flat_words, ["account_id", "ord"], "left").select("account_id", "ord", "line_no", "text", "start_s", "section", text.alias("words"), F.coalesce("n_flat", F.lit(0)).alias("n_flat"))


@query(
    "b25_unpack_verified",
    """SELECT account_id, clip_id, CASE ord % 4 WHEN 2 THEN 'verified:' || md5(clip_id) WHEN 3 THEN 'plain' ELSE md5(clip_id) END AS source_hash, CASE ord % 4 WHEN 0 THEN md5(title) WHEN 1 THEN 'a:b' END AS content_hash FROM {clips}""",
)
def b25(spark, sf_dir):
    form, source = F.col("ord") % 4, F.md5("clip_id")
    packed = F.when(form == 0, F.concat(F.lit("verified:"), source, F.lit(":"), F.md5("title"))).when(form == 1, F.concat(F.lit("verified-art:"), source, F.lit(":a:b"))).when(form == 2, F.concat(F.lit("verified:"), source)).otherwise("plain")
    rows = role(spark, sf_dir, "clips").withColumn("packed", packed)
    return rows.select("account_id", "clip_id", *(x.alias(n) for n, x in state.unpack_verified("packed").items()))
