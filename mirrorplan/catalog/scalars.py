"""Queries of the column functions, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clips as fn
from .roles import role, with_roles

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_roles(sql)
        return f

    return add


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips role with its nested columns."""
    rows = role(spark, sf_dir, "clips")
    entry = lambda *cols: F.filter(F.array(*(F.struct(F.col(x).alias("id")) for x in cols)), lambda e: e["id"] != "")
    return rows.withColumns(
        {
            "media_urls": F.array(
                F.struct(F.lit("").alias("url"), F.lit("mp3").alias("content_type")), F.struct(F.col("media_url").alias("url"), F.col("media_type").alias("content_type"))
            ),
            "history": entry("history_id"),
            "concat_history": entry("concat_id", "concat_id2"),
            "clip_roots": F.filter(
                F.array(
                    F.struct(F.col("attributed_id").alias("id"), F.col("attributed_handle").alias("handle")),
                    F.struct(F.lit("m_").alias("id"), F.col("handle").alias("handle")),
                    F.struct(F.col("concat_id").alias("id"), F.col("handle").alias("handle")),
                ),
                lambda r: (r["id"] != "") | r["id"].isNull(),
            ),
        }
    )


_KEYS = ["account_id", "clip_id"]


@query("b01_is_downloadable", "SELECT account_id, clip_id FROM {clips} WHERE status = 'complete' AND clip_type <> 'rendered_context_window' AND task NOT IN ('infill', 'fixed_infill')")
def b01(spark, sf_dir):
    return clips(spark, sf_dir).where(fn.is_downloadable()).select(*_KEYS)


_NORM = "CASE WHEN regexp_replace({x}, '^m_', '') IN ('', '00000000-0000-0000-0000-000000000000') THEN NULL ELSE regexp_replace({x}, '^m_', '') END"
norm = lambda x: _NORM.replace("{x}", x)


@query("b02_normalise_id", f"SELECT account_id, clip_id, {norm('edited_clip_id')} AS edited, {norm('override_history_clip_id')} AS overridden, {norm('concat_id')} AS joined FROM {{clips}}")
def b02(spark, sf_dir):
    pairs = {"edited": "edited_clip_id", "overridden": "override_history_clip_id", "joined": "concat_id"}
    return role(spark, sf_dir, "clips").select(*_KEYS, *(fn.normalise_id(x).alias(k) for k, x in pairs.items()))


EDGE_SQL = f"""CASE WHEN task IN ('infill', 'fixed_infill') THEN 'section_replace' WHEN task = 'extend' THEN 'extend' WHEN clip_type = 'concat' THEN 'stitch'
    WHEN clip_type = 'edit_speed' THEN 'speed_edit' WHEN task = 'cover' THEN 'cover' WHEN 'upsample' IN (clip_type, task) THEN 'remaster'
    WHEN clip_type = 'edit_v3_export' THEN 'edit' WHEN {norm('edited_clip_id')} IS NOT NULL THEN 'derived' END"""


@query("b03_edge_type", f"SELECT account_id, clip_id, {EDGE_SQL} AS edge FROM {{clips}}")
def b03(spark, sf_dir):
    return role(spark, sf_dir, "clips").select(*_KEYS, fn.edge_type().alias("edge"))


_FIRST_CONCAT = "CASE WHEN concat_id <> '' THEN concat_id ELSE concat_id2 END"
#: Pointers of each edge type as (SQL, field) in order.
POINTERS_SQL = {
    "section_replace": [("override_history_clip_id",) * 2, ("override_future_clip_id",) * 2, ("history_id", "history"), ("edited_clip_id",) * 2],
    "extend": [("history_id", "history"), ("edited_clip_id",) * 2],
    "stitch": [(_FIRST_CONCAT, "concat_history"), ("edited_clip_id",) * 2],
    "speed_edit": [("speed_clip_id",) * 2, ("edited_clip_id",) * 2],
    "cover": [("cover_clip_id",) * 2, ("edited_clip_id",) * 2],
    "remaster": [("upsample_clip_id",) * 2, ("remaster_clip_id",) * 2, ("edited_clip_id",) * 2],
    "edit": [("edited_clip_id",) * 2],
    "derived": [("edited_clip_id",) * 2],
}
PARENT_SQL = "CASE edge " + " ".join(f"WHEN '{e}' THEN coalesce({', '.join(norm(x) for x, _ in ps)})" for e, ps in POINTERS_SQL.items()) + " END"
FIELD_SQL = (
    "CASE edge "
    + " ".join(f"WHEN '{e}' THEN CASE {' '.join(f'WHEN {norm(x)} IS NOT NULL THEN ' + repr(f) for x, f in ps)} END" for e, ps in POINTERS_SQL.items())
    + " END"
)
PARENTS_SQL = f"SELECT account_id, clip_id, {PARENT_SQL} AS parent_id, edge, {FIELD_SQL} AS source_field FROM (SELECT *, {EDGE_SQL} AS edge FROM {{clips}})"


@query("b04_primary_parent", f"SELECT * FROM ({PARENTS_SQL}) WHERE parent_id IS NOT NULL")
def b04(spark, sf_dir):
    rows = clips(spark, sf_dir).select(*_KEYS, fn.primary_parent().alias("p")).where("p IS NOT NULL")
    return rows.select(*_KEYS, "p.parent_id", "p.edge", "p.source_field")


LABEL_SQL = "CASE edge " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fn.EDGE_LABELS.items()) + " END"


@query(
    "b05_labels_and_slugs",
    f"""SELECT account_id, clip_id, {LABEL_SQL} AS label, CASE WHEN trim(clip_attribution_type) = '' THEN 'attribution'
        ELSE lower(regexp_replace(trim(clip_attribution_type), '\\s+', '_', 'g')) END AS slug FROM (SELECT *, {EDGE_SQL} AS edge FROM {{clips}})""",
)
def b05(spark, sf_dir):
    return role(spark, sf_dir, "clips").select(*_KEYS, fn.edge_label(fn.edge_type()).alias("label"), fn.normalise_slug("clip_attribution_type").alias("slug"))


@query("b06_same_owner", "SELECT account_id, clip_id, trim(handle) <> '' AND trim(handle) = trim(attributed_handle) AS same FROM {clips}")
def b06(spark, sf_dir):
    return role(spark, sf_dir, "clips").select(*_KEYS, fn.same_owner("handle", "attributed_handle").alias("same"))


@query(
    "b07_album_and_year",
    """SELECT account_id, clip_id, CASE WHEN trim(tags) <> '' AND tags <> title THEN tags ELSE title END AS album,
        CASE WHEN prompt <> '' THEN left(prompt, 4) ELSE left(created_at, 4) END AS year FROM {clips}""",
)
def b07(spark, sf_dir):
    return role(spark, sf_dir, "clips").select(*_KEYS, fn.album_title("title", "tags").alias("album"), fn.album_year("created_at", "prompt").alias("year"))


@query(
    "b08_media_addresses",
    """SELECT account_id, clip_id, CASE WHEN media_url <> '' AND media_type = 'mp3' THEN CASE WHEN contains(media_url, 'audiopipe')
            THEN 'https://media.example.org/' || clip_id || '.mp3' ELSE media_url END WHEN audio_url <> '' THEN audio_url
            ELSE 'https://media.example.org/' || clip_id || '.mp3' END AS mp3,
        CASE WHEN image_large_url <> '' THEN image_large_url WHEN image_url <> '' THEN image_url END AS image,
        concat_ws(' ', nullif(image_large_url, ''), nullif(image_url, '')) AS candidates FROM {clips}""",
)
def b08(spark, sf_dir):
    return clips(spark, sf_dir).select(
        *_KEYS, fn.mp3_url().alias("mp3"), fn.selected_image_url().alias("image"), F.array_join(fn.cover_candidates(), " ").alias("candidates")
    )


@query(
    "b09_stem_label",
    r"""SELECT account_id, clip_id, CASE WHEN trim(replace(stem_type_group_name, '_', ' ')) <> '' THEN trim(replace(stem_type_group_name, '_', ' '))
        ELSE trim(regexp_extract(title, '\(([^(]*)\)\s*$', 1)) END AS label FROM {clips}""",
)
def b09(spark, sf_dir):
    return role(spark, sf_dir, "clips").select(*_KEYS, fn.stem_label().alias("label"))


HEALTH_SQL = "CASE WHEN is_past_due THEN 'past due' WHEN is_paused THEN 'paused' WHEN NOT is_active THEN 'inactive' END"


@query(
    "b10_account_health",
    f"""SELECT account_id, {HEALTH_SQL} AS health, coalesce({HEALTH_SQL}, CASE WHEN has_convert THEN 'available' WHEN features_known THEN 'not included' ELSE 'unknown' END) AS lossless,
        coalesce(CAST(credits_left AS VARCHAR) || ' remaining', 'unknown') || coalesce(' (' || monthly_usage || ' of ' || monthly_limit || ' used this ' || coalesce(period, 'period') || ')', '')
        || coalesce('; ' || {HEALTH_SQL}, '') AS usage FROM {{accounts}}""",
)
def b10(spark, sf_dir):
    rows = role(spark, sf_dir, "accounts").withColumn("features", F.when(F.col("has_convert"), F.array(F.lit("convert_audio"), F.lit("get_stems"))).otherwise(F.array(F.lit("get_stems"))))
    return rows.select("account_id", fn.account_health().alias("health"), fn.lossless_access().alias("lossless"), fn.usage_line().alias("usage"))


@query(
    "b11_deadline_bucket",
    """SELECT o_orderkey, CASE WHEN e <= 800000000 THEN 'expired' WHEN e - 800000000 < 90000000 THEN 'expiring' ELSE 'fresh' END AS bucket,
        CASE WHEN e > 800000000 AND e - 800000000 < 90000000 THEN CAST(ceil((e - 800000000) / 86400) AS BIGINT) END AS days
        FROM (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS e FROM orders)""",
)
def b11(spark, sf_dir):
    rows = role(spark, sf_dir, "orders").select("o_orderkey", (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400).alias("e"))
    return rows.select("o_orderkey", fn.deadline_bucket("e", 800_000_000, 90_000_000).alias("d")).select("o_orderkey", "d.*")


CREATED_SQL = r"CASE WHEN regexp_matches(created_at, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.[^T]*)?Z$') THEN CAST(epoch(CAST(left(created_at, 19) AS TIMESTAMP)) AS BIGINT) END"


@query("b12_parse_created", f"SELECT account_id, clip_id, {CREATED_SQL} AS created FROM {{clips}}")
def b12(spark, sf_dir):
    return role(spark, sf_dir, "clips").select(*_KEYS, fn.parse_created("created_at").alias("created"))


@query(
    "b13_civil_dates",
    "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, strftime(make_timestamp(o_orderkey * 86399000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM orders",
)
def b13(spark, sf_dir):
    return role(spark, sf_dir, "orders").select("o_orderkey", fn.epoch_days("o_orderdate").alias("days"), fn.rfc3339(F.col("o_orderkey") * 86399).alias("stamp"))


@query(
    "b20_text_formats",
    """SELECT account_id, clip_id, replace(replace(prompt || lyrics, chr(13), ''), chr(10), ' ') AS one_line,
        CASE WHEN duration > 0 THEN CAST(floor(duration + 0.5) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(floor(duration + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') ELSE '' END AS minutes,
        CAST(floor(duration + 0.5) AS BIGINT) AS seconds, CASE WHEN length(title) <= 8 THEN title ELSE left(title, 7) || '…' END AS short, left(clip_id, 8) AS id8 FROM {clips}""",
)
def b20(spark, sf_dir):
    return role(spark, sf_dir, "clips").select(
        *_KEYS, fn.single_line(F.concat("prompt", "lyrics")).alias("one_line"), fn.minutes("duration").alias("minutes"), fn.whole_seconds("duration").alias("seconds"),
        fn.truncated("title", 8).alias("short"), fn.short_id("clip_id").alias("id8"),
    )


_IMAGE_SQL = "CASE WHEN image_large_url <> '' THEN image_large_url ELSE image_url END"
ART_SQL = f"CASE WHEN {_IMAGE_SQL} = '' THEN '' ELSE sha256('art' || chr(1) || {_IMAGE_SQL}) END"


@query(
    "b21_change_hashes",
    f"""SELECT account_id, clip_id, sha256('content' || chr(1) || lyrics) AS content, {ART_SQL} AS art, CASE WHEN video_cover_url = '' THEN '' ELSE sha256('webp' || chr(1) || video_cover_url || chr(1) || 'q80') END AS webp,
        CASE WHEN video_cover_url <> '' THEN sha256('webp-embed' || chr(1) || video_cover_url || chr(1) || {_IMAGE_SQL} || chr(1) || 'q80') ELSE {ART_SQL} END AS embedded FROM {{clips}}""",
)
def b21(spark, sf_dir):
    return clips(spark, sf_dir).select(
        *_KEYS, fn.content_hash("lyrics").alias("content"), fn.art_hash(fn.selected_image_url()).alias("art"), fn.webp_art_hash("video_cover_url", "q80").alias("webp"),
        fn.embedded_art_hash(True, "q80").alias("embedded"),
    )


def with_context(spark, sf_dir) -> DataFrame:
    """Clips with a lineage context whose root is the cover pointer: enough to exercise the projections."""
    rows = clips(spark, sf_dir).withColumn("p", fn.primary_parent())
    return rows.withColumns(
        {"parent_id": F.coalesce("p.parent_id", F.lit("")), "edge_type": F.col("p.edge"), "root_id": F.col("cover_clip_id"), "root_title": F.col("gpt_description_prompt"),
         "root_date": F.col("prompt"), "track": (F.col("ord") % 4).cast("int"), "track_total": F.lit(4)}
    )


CONTEXT_SQL = f"""SELECT c.*, coalesce(p.parent_id, '') AS parent_id, CASE WHEN p.parent_id IS NOT NULL THEN p.edge END AS edge, cover_clip_id AS root_id, gpt_description_prompt AS root_title, prompt AS root_date
    FROM {{clips}} c JOIN ({PARENTS_SQL}) p ON p.clip_id = c.clip_id AND p.account_id = c.account_id"""
TAGS_SQL = f"""SELECT *, CASE WHEN display_name = '' THEN 'Unknown Artist' ELSE display_name END AS artist, CASE WHEN trim(root_title) <> '' AND root_title <> title THEN root_title ELSE title END AS album,
    CASE WHEN model_name <> '' AND major_model_version <> '' THEN model_name || ' (' || major_model_version || ')' ELSE model_name END AS model,
    concat_ws(chr(10), CASE WHEN parent_id <> '' THEN coalesce({LABEL_SQL}, 'Derived from') || ' ' || left(parent_id, 8) END, CASE WHEN root_id <> '' AND root_id <> clip_id THEN 'Root ' || left(root_id, 8) || ' (' || root_title || ')' END) AS lineage,
    'https://www.example.org/song/' || clip_id AS url FROM ({CONTEXT_SQL})"""


@query(
    "b22_track_metadata",
    f"""SELECT account_id, clip_id, title, artist, album, artist AS album_artist, left(created_at, 10) AS date, CASE WHEN root_date <> '' THEN left(root_date, 4) ELSE left(created_at, 4) END AS year,
        lyrics, prompt, gpt_description_prompt AS comment, tags AS style, gpt_description_prompt AS style_summary, model, handle, parent_id AS parent, root_id AS root, lineage, clip_id AS id, url,
        CAST(ord % 4 AS INTEGER) AS track, 4 AS track_total FROM ({TAGS_SQL})""",
)
def b22(spark, sf_dir):
    return with_context(spark, sf_dir).select(*_KEYS, *(v.alias(k) for k, v in fn.track_metadata().items()))


_DETAILS = [
    ("Title", "title"), ("Artist", "artist"), ("Album", "album"), ("Album Artist", "artist"), ("Date", "left(created_at, 10)"),
    ("Duration", "CASE WHEN duration > 0 THEN CAST(floor(duration + 0.5) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(floor(duration + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') ELSE '' END"),
    ("Model", "model"), ("Handle", "handle"), ("Style", "tags"), ("Style Summary", "gpt_description_prompt"), ("Comment", "gpt_description_prompt"), ("Prompt", "prompt"),
    ("Parent", "parent_id"), ("Root", "root_id"), ("Lineage", "lineage"), ("Id", "clip_id"), ("Url", "url"),
]


@query(
    "b23_details_text",
    f"SELECT account_id, clip_id, {' || '.join(f'''CASE WHEN ({x}) = '' THEN '' ELSE '{k}: ' || replace(replace({x}, chr(13), ''), chr(10), ' ') || chr(10) END''' for k, x in _DETAILS)} AS details FROM ({TAGS_SQL})",
)
def b23(spark, sf_dir):
    return with_context(spark, sf_dir).select(*_KEYS, fn.details_text().alias("details"))


@query(
    "b24_owner_gate",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN 'abort_config_mismatch' WHEN c_custkey % 5 = 0 THEN 'first_use' WHEN c_nationkey % 3 <> 0 THEN 'proceed'
        WHEN c_custkey % 2 = 0 THEN 'repin' ELSE 'abort_mismatch' END AS gate, CASE WHEN c_custkey % 5 <> 0 AND c_nationkey % 3 = 0 AND c_custkey % 2 = 0 AND c_custkey % 8 IN (0, 2, 6) THEN TRUE ELSE FALSE END AS additive FROM customer""",
)
def b24(spark, sf_dir):
    k = F.col("c_custkey")
    rows = role(spark, sf_dir, "customer").withColumns(
        {"authed_id": F.col("c_name"), "configured_id": F.when(k % 8 == 0, F.col("c_name")).when(k % 4 == 0, F.lit("other")),
         "pinned_id": F.when(k % 5 != 0, F.when(F.col("c_nationkey") % 3 == 0, F.lit("someone")).otherwise(F.col("c_name"))), "allow_change": k % 2 == 0}
    )
    return rows.select("c_custkey", fn.owner_gate().alias("gate")).withColumn("additive", F.col("gate") == "repin")


@query(
    "b27_failure_class",
    """SELECT l_orderkey, l_linenumber, CASE WHEN s IS NULL THEN 'transient' WHEN s BETWEEN 200 AND 299 THEN CASE WHEN d IS NOT NULL AND d <> b THEN 'transient' END
        WHEN s IN (401, 403, 408, 429) OR s BETWEEN 500 AND 599 THEN 'transient' ELSE 'permanent' END AS class,
        CASE WHEN s IS NULL THEN 'transport error' WHEN s BETWEEN 200 AND 299 THEN CASE WHEN d IS NOT NULL AND d <> b THEN 'truncated' END WHEN s IN (401, 403) THEN 'rejected' WHEN s = 408 THEN 'timeout'
        WHEN s = 429 THEN 'rate limited' WHEN s BETWEEN 500 AND 599 THEN 'server error' ELSE 'failed' END AS reason
        FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 13 <> 0 THEN 200 + (l_partkey * 7) % 310 END AS s, CASE WHEN l_suppkey % 3 <> 0 THEN l_partkey END AS d, l_partkey + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS b FROM lineitem)""",
)
def b27(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = role(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(p % 13 != 0, 200 + (p * 7) % 310).alias("status"), F.when(s % 3 != 0, p).alias("declared_bytes"), (p + F.when(s % 5 == 0, 1).otherwise(0)).alias("body_bytes")
    )
    return rows.select("l_orderkey", "l_linenumber", fn.failure_class().alias("f")).select("l_orderkey", "l_linenumber", "f.*")
