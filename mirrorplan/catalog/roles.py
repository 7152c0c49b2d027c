"""Roles for the driver's tables: one SQL text per role that both Spark and DuckDB run.

Only the adapters live here; what is tested on top of them are the operators themselves. Names in
braces are tables or other roles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..tables import written

_NAME = re.compile(r"\{([a-z]\w*)\}")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels")
_ID = "CASE WHEN {k} % 50 = 0 THEN 'x' WHEN {k} % 50 = 1 THEN 'X' ELSE 'c' END || lpad(CAST(CASE WHEN {k} % 50 = 1 THEN {k} - 1 ELSE {k} END AS STRING), 7, '0') || CASE WHEN {k} % 50 = 1 THEN '-b' ELSE '-a' END"


def clip_id(key: str) -> str:
    """SQL of the id of the clip that order `key` stands for: some share their first 8 characters but for case."""
    return "(" + _ID.replace("{k}", key) + ")"


ROLES = {
    "accounts": """
        SELECT CAST(n_nationkey AS STRING) AS account_id, n_name AS label, r_name AS region, n_nationkey AS k,
            CASE n_nationkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_past_due, CASE n_nationkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_paused,
            CASE n_nationkey % 5 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS is_active, n_nationkey % 7 = 0 AS has_convert, n_nationkey % 2 = 0 AS features_known,
            CASE WHEN n_nationkey % 6 <> 0 THEN CAST(n_nationkey * 10 AS BIGINT) END AS credits_left, CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_nationkey AS BIGINT) END AS monthly_usage,
            CASE WHEN n_nationkey % 5 <> 0 THEN CAST(500 AS BIGINT) END AS monthly_limit, CASE WHEN n_nationkey % 2 = 0 THEN 'month' END AS period
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "named_orders": """
        SELECT o.*, c_name, c_nationkey, p_name, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_key,
            row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS of_customer,
            last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key
        FROM {orders} o JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON p_partkey = o_orderkey % (SELECT count(*) FROM {part})""",
    "clips": f"""
        SELECT CAST(c_nationkey AS STRING) AS account_id, {clip_id('o_orderkey')} AS clip_id, o_orderkey AS ord,
            CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 23 = 0 THEN ' unTitled ' WHEN o_orderkey % 19 = 0 THEN p_name || ' (take: ' || CAST(o_orderkey % 3 AS STRING) || ')' ELSE p_name END AS title,
            CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'streaming' ELSE 'queued' END AS status,
            CAST(CAST(o_orderdate AS DATE) AS STRING) || CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'T' || lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':0' || CAST(o_orderkey % 10 AS STRING) || ':30' || CASE WHEN o_orderkey % 3 = 0 THEN '.125' ELSE '' END || CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE 'Z' END END AS created_at,
            CAST(floor(o_totalprice) AS BIGINT) AS play_count, CAST(o_orderkey % 600 AS DOUBLE) + 0.25 * (o_orderkey % 4) AS duration,
            CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE c_name END AS display_name, CASE WHEN o_orderkey % 26 = 0 THEN ' ' ELSE lower(c_name) END AS handle,
            o_orderpriority AS tags, 'user-' || CAST(o_custkey AS STRING) AS user_id,
            CASE o_orderkey % 11 WHEN 0 THEN 'infill' WHEN 1 THEN 'extend' WHEN 2 THEN 'cover' WHEN 3 THEN 'upsample' WHEN 4 THEN 'fixed_infill' ELSE '' END AS task,
            CASE o_orderkey % 9 WHEN 0 THEN 'concat' WHEN 1 THEN 'edit_speed' WHEN 2 THEN 'upsample' WHEN 3 THEN 'edit_v3_export' WHEN 4 THEN 'rendered_context_window' ELSE 'gen' END AS clip_type,
            CASE WHEN prev_key IS NULL THEN CASE WHEN o_custkey % 11 = 0 THEN 'gone-' || CAST(o_custkey AS STRING) WHEN o_custkey % 7 = 0 AND of_customer > 1 THEN {clip_id('last_key')} ELSE '00000000-0000-0000-0000-000000000000' END
                WHEN o_orderkey % 8 = 0 THEN 'm_' || {clip_id('prev_key')} ELSE {clip_id('prev_key')} END AS edited_clip_id,
            CASE WHEN prev_key IS NOT NULL AND o_orderkey % 5 = 0 THEN {clip_id('prev_key')} ELSE '' END AS history_id,
            CASE WHEN o_orderkey % 4 = 0 THEN 'm_' || {clip_id('o_orderkey + 7')} ELSE '' END AS concat_id, CASE WHEN o_orderkey % 6 = 0 THEN {clip_id('o_orderkey + 3')} ELSE '' END AS concat_id2,
            CASE WHEN o_orderkey % 3 = 0 THEN {clip_id('o_orderkey + 1')} ELSE '' END AS cover_clip_id, CASE WHEN o_orderkey % 5 = 1 THEN {clip_id('o_orderkey + 2')} ELSE '' END AS upsample_clip_id,
            CASE WHEN o_orderkey % 7 = 1 THEN {clip_id('o_orderkey + 5')} ELSE '' END AS remaster_clip_id, CASE WHEN o_orderkey % 2 = 1 THEN {clip_id('o_orderkey + 4')} ELSE '' END AS speed_clip_id,
            CASE WHEN o_orderkey % 2 = 0 THEN 'm_' ELSE {clip_id('o_orderkey + 6')} END AS override_history_clip_id, CASE WHEN o_orderkey % 3 = 1 THEN {clip_id('o_orderkey + 6')} ELSE '' END AS override_future_clip_id,
            o_orderkey % 31 = 0 AS is_trashed, o_orderkey % 5 = 0 AS has_stem, o_orderkey % 10 = 0 AS is_liked, o_orderkey % 37 = 0 AS is_private,
            CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE 'https://img/' || CAST(o_orderkey AS STRING) END AS image_url, CASE WHEN o_orderkey % 3 = 1 THEN 'https://img/large/' || CAST(o_orderkey AS STRING) ELSE '' END AS image_large_url,
            CASE WHEN o_orderkey % 6 = 1 THEN 'https://vid/' || CAST(o_orderkey AS STRING) ELSE '' END AS video_url, CASE WHEN o_orderkey % 5 = 2 THEN 'https://cov/' || CAST(o_orderkey AS STRING) ELSE '' END AS video_cover_url,
            CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE 'https://aud/' || CAST(o_orderkey AS STRING) END AS audio_url,
            CASE o_orderkey % 5 WHEN 0 THEN 'https://audiopipe/' || CAST(o_orderkey AS STRING) WHEN 1 THEN 'https://m/' || CAST(o_orderkey AS STRING) ELSE '' END AS media_url, CASE WHEN o_orderkey % 2 = 0 THEN 'mp3' ELSE 'm4a' END AS media_type,
            CASE WHEN o_orderkey % 4 = 2 THEN '' ELSE 'model' || CAST(o_orderkey % 5 AS STRING) END AS model_name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'v' || CAST(o_orderkey % 3 AS STRING) END AS major_model_version,
            CASE WHEN o_orderkey % 12 = 0 THEN 'back_ing vocals ' WHEN o_orderkey % 12 = 1 THEN '_' ELSE '' END AS stem_type_group_name,
            CASE WHEN o_orderkey % 6 = 0 THEN 'line one' || chr(10) || 'line ' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 6 = 1 THEN ' ' ELSE '' END AS lyrics,
            CASE WHEN o_orderkey % 7 = 0 THEN 'a' || chr(13) || chr(10) || 'prompt' ELSE '' END AS prompt, CASE WHEN o_orderkey % 5 = 3 THEN 'described ' || p_name ELSE '' END AS gpt_description_prompt,
            CASE o_orderkey % 5 WHEN 0 THEN ' Remix  Cover ' WHEN 1 THEN ' ' WHEN 2 THEN 'SAMPLE' ELSE '' END AS clip_attribution_type,
            CASE WHEN o_orderkey % 4 = 0 THEN {clip_id('o_orderkey + 11')} ELSE '' END AS attributed_id, CASE WHEN o_orderkey % 8 = 0 THEN ' ' || lower(c_name) ELSE 'other' END AS attributed_handle
        FROM {{named_orders}}""",
    "areas": """
        SELECT account_id, k, a AS area_ord, CASE a WHEN 0 THEN 'library' WHEN 1 THEN 'liked' ELSE 'playlist' END AS kind, 'area-' || CAST(a AS STRING) AS area_id,
            CASE WHEN (k + a) % 2 = 0 THEN 'mirror' ELSE 'copy' END AS mode, (k * 3 + a) % 7 <> 0 OR k % 4 = 1 AS complete, (k + a) % 11 = 0 AND k % 4 <> 1 AS any_filtered, (k + 2 * a) % 13 = 0 AND k % 4 <> 1 AS narrowed
        FROM {accounts} CROSS JOIN (SELECT DISTINCT l_linenumber % 5 AS a FROM {lineitem}) n WHERE k <> 24""",
    "area_clips": """
        SELECT account_id, CAST(left(tags, 1) AS INTEGER) - 1 AS area_ord, ord AS pos, clip_id, title FROM {clips} WHERE CAST(left(tags, 1) AS INTEGER) < 5 OR ord % 2 = 1 AND CAST(account_id AS INTEGER) % 2 = 0
        UNION ALL SELECT account_id, 0, ord + 1, clip_id, title || '*' FROM {clips} WHERE ord % 3 = 0
        UNION ALL SELECT account_id, 1, ord + 2, clip_id, title || '+' FROM {clips} WHERE ord % 4 = 0""",
    "playlists": """
        SELECT account_id, p_brand || '-' || account_id AS playlist_id, CASE WHEN p % 5 = 0 THEN 'Mix' WHEN p % 7 = 0 THEN 'MIX' WHEN p % 3 = 0 THEN lower(p_brand) ELSE p_brand END AS name, p
        FROM {accounts} CROSS JOIN (SELECT p_brand, min(p_partkey) AS p FROM {part} GROUP BY p_brand) b""",
    "members": """
        SELECT account_id, 'Brand#' || CAST(1 + l_partkey % 25 AS STRING) || '-' || account_id AS playlist_id, l_linenumber * 1000000 + l_orderkey AS pos, clip_id, title, duration
        FROM {clips} JOIN {lineitem} ON l_orderkey = ord""",
}


def role(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """The role's rows from the tables under sf_dir. made: roles at hand, which are taken as they are."""
    if made and name in made:
        return made[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = ROLES[name]
    needs = sorted(set(_NAME.findall(text)))
    return spark.sql(text, **{n: role(spark, sf_dir, n, made) for n in needs})


def clips_once(spark: SparkSession, sf_dir: str, *columns: str) -> dict[str, DataFrame]:
    """The named columns of the clips, written once for all roles of a query that are made from them: two joins and a window stand behind each reading."""
    return {"clips": written(role(spark, sf_dir, "clips").select(*columns), "clips")}


def with_roles(sql: str) -> str:
    """DuckDB SQL with the roles that it names in braces put before it."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in ROLES and name not in order:
            for n in _NAME.findall(ROLES[name]):
                need(n)
            order.append(name)

    names = _NAME.findall(sql)
    for n in names:
        need(n)
    bare = lambda s: _NAME.sub(r"\1", s)
    body = bare(sql).strip()
    if not order:
        return body
    head = ", ".join(f"{n} AS MATERIALIZED ({bare(ROLES[n])})" for n in order)
    return f"WITH {head}{', ' + body[5:] if body[:5].upper() == 'WITH ' else ' ' + body}"


ROLES |= {
    "desired": """
        SELECT account_id, clip_id, ord, 'a' || CAST(ord % 50 AS STRING) || '/' || clip_id || CASE WHEN ord % 2 = 0 THEN '.mp3' ELSE '.flac' END AS path, CASE WHEN ord % 2 = 0 THEN 'mp3' ELSE 'flac' END AS format,
            md5(title) AS meta_hash, CASE WHEN image_url = '' THEN '' ELSE md5(image_url) END AS art_hash, '' AS embedded_lyrics_hash, '' AS embedded_timed_lyrics_hash, ord % 8 <> 1 AS lyrics_reencode_safe,
            ord % 3 <> 0 AS mirrored, ord % 4 = 0 AS copied, ord % 6 = 0 AS trashed, ord % 37 = 0 AS private, ord % 5 <> 0 AS stems_authoritative
        FROM {clips} WHERE ord % 9 <> 0
        UNION ALL SELECT account_id, clip_id, ord + 1000000000, 'Z/' || clip_id || '.mp3', 'mp3', md5(title), '', '', '', TRUE, ord % 2 = 0, ord % 10 = 0, ord % 5 <> 0, ord % 71 = 0, TRUE FROM {clips} WHERE ord % 14 = 1 AND ord % 9 <> 0""",
    "merged": """
        SELECT * FROM (SELECT account_id, clip_id, ord, path, format, meta_hash, art_hash, embedded_lyrics_hash, embedded_timed_lyrics_hash, lyrics_reencode_safe, stems_authoritative,
            max(CASE WHEN mirrored THEN 1 ELSE 0 END) OVER w = 1 AS mirrored, max(CASE WHEN copied THEN 1 ELSE 0 END) OVER w = 1 AS copied, min(CASE WHEN trashed THEN 1 ELSE 0 END) OVER w = 1 AS trashed, max(CASE WHEN private THEN 1 ELSE 0 END) OVER w = 1 AS private,
            row_number() OVER (PARTITION BY account_id, clip_id ORDER BY path, meta_hash, art_hash, CASE format WHEN 'mp3' THEN 0 ELSE 1 END, ord) AS nth
        FROM {desired} WINDOW w AS (PARTITION BY account_id, clip_id)) x WHERE nth = 1""",
    "manifest": """
        SELECT account_id, clip_id, ord, CASE WHEN ord % 97 = 0 THEN '' WHEN ord % 5 = 0 THEN 'old/' || clip_id || CASE WHEN ord % 2 = 0 THEN '.mp3' ELSE '.flac' END WHEN ord % 33 = 2 THEN 'a' || CAST((ord + 1) % 50 AS STRING) || '/' || clip_id || '.flac'
                WHEN ord % 5 = 1 THEN 'A' || CAST(ord % 50 AS STRING) || '/' || upper(clip_id) || CASE WHEN ord % 2 = 0 THEN '.mp3' ELSE '.flac' END ELSE 'a' || CAST(ord % 50 AS STRING) || '/' || clip_id || CASE WHEN ord % 2 = 0 THEN '.mp3' ELSE '.flac' END END AS path,
            CASE WHEN ord % 11 = 0 THEN 'wav' WHEN ord % 2 = 0 THEN 'mp3' ELSE 'flac' END AS format, CASE WHEN ord % 12 = 0 THEN 'stale' ELSE md5(title) END AS meta_hash, CASE WHEN image_url = '' THEN '' ELSE md5(image_url) END AS art_source_hash,
            CAST(NULL AS STRING) AS art_content_hash, '' AS embedded_lyrics_hash, '' AS embedded_timed_lyrics_hash, CAST(100 AS BIGINT) AS size, ord % 13 = 0 AS preserve
        FROM {clips} WHERE ord % 7 <> 0""",
    "desired_slots": """
        SELECT account_id, clip_id, ord, n, kind, key, 'a' || CAST(ord % 50 AS STRING) || '/' || clip_id || suffix AS path, CASE WHEN kind IN ('cover_jpg', 'video_mp4', 'stem') THEN 'u' || CAST(ord AS STRING) ELSE '' END AS source_url,
            CASE WHEN kind = 'details_txt' THEN 'd' || CAST(ord AS STRING) ELSE 'h' || CAST(ord % 1000 AS STRING) END AS hash, CASE WHEN kind = 'details_txt' THEN 'text ' || CAST(ord AS STRING) END AS content, '' AS stem_id, 'mp3' AS format
        FROM {clips} CROSS JOIN (SELECT 0 AS n, 'cover_jpg' AS kind, '' AS key, '.jpg' AS suffix UNION ALL SELECT 1, 'details_txt', '', '.details.txt' UNION ALL SELECT 2, 'lyrics_txt', '', '.lyrics.txt' UNION ALL SELECT 3, 'stem', 's1', '.stems/one.mp3' UNION ALL SELECT 4, 'stem', 's2', '.stems/two.mp3') k
        WHERE ord % 9 <> 0 AND (ord + n) % 4 <> 0""",
    "manifest_slots": """
        SELECT account_id, clip_id, ord, n, kind, key, CASE WHEN (ord + n) % 97 = 0 THEN '' WHEN (ord + n) % 7 = 0 THEN 'old/' || clip_id || suffix ELSE 'a' || CAST(ord % 50 AS STRING) || '/' || clip_id || suffix END AS path,
            CASE WHEN (ord + n) % 11 = 0 THEN 'stale' WHEN kind = 'details_txt' THEN 'd' || CAST(ord AS STRING) ELSE 'h' || CAST(ord % 1000 AS STRING) END AS source_hash, CASE WHEN (ord + n) % 3 = 0 THEN 'seen' END AS content_hash
        FROM {clips} CROSS JOIN (SELECT 0 AS n, 'cover_jpg' AS kind, '' AS key, '.jpg' AS suffix UNION ALL SELECT 1, 'details_txt', '', '.details.txt' UNION ALL SELECT 2, 'lyrics_txt', '', '.lyrics.txt' UNION ALL SELECT 3, 'stem', 's1', '.stems/one.mp3' UNION ALL SELECT 4, 'stem', 's3', '.stems/three.mp3' UNION ALL SELECT 5, 'cover_webp', '', '.webp') k
        WHERE ord % 7 <> 0 AND (ord + n) % 5 <> 0""",
    "inventory": """
        SELECT account_id, path, ord % 17 <> 0 AS exists, CASE WHEN ord % 19 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(100 AS BIGINT) END AS size, CAST(NULL AS STRING) AS content_hash, ord % 23 = 0 AS unreadable FROM {manifest} WHERE path <> '' AND ord % 29 <> 0
        UNION ALL SELECT account_id, path, (ord + n) % 17 <> 0, CASE WHEN (ord + n) % 19 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(7 AS BIGINT) END, CASE WHEN (ord + n) % 2 = 0 THEN CASE WHEN (ord + n) % 4 = 0 THEN 'seen' ELSE 'other' END END, (ord + n) % 31 = 0 FROM {manifest_slots} WHERE path <> '' AND kind <> 'stem' AND (ord + n) % 13 <> 0
        UNION ALL SELECT account_id, path, (ord + n) % 17 <> 0, CAST(9 AS BIGINT), CAST(NULL AS STRING), FALSE FROM {manifest_slots} WHERE path <> '' AND kind = 'stem'""",
    "gate": "SELECT account_id, k % 3 <> 0 AS can_delete FROM {accounts}",
    "list_gate": "SELECT account_id, can_delete, CAST(account_id AS INTEGER) % 2 = 0 AS listed FROM {gate}",
    "album_art": """
        SELECT account_id, clip_id, ord, CASE WHEN ord % 10 = 0 THEN 'ALBUM/' || clip_id || '/folder.jpg' WHEN ord % 10 = 3 THEN 'was/' || clip_id WHEN ord % 89 = 1 THEN '' ELSE 'album/' || clip_id || '/folder.jpg' END AS path,
            CASE WHEN ord % 6 = 0 THEN 'x' ELSE image_url END AS hash, CASE WHEN ord % 5 < 2 THEN 'seen' END AS content_hash FROM {clips} WHERE ord % 3 <> 0""",
    "album_files": """
        SELECT account_id, path, ord % 17 <> 0 AS exists, CASE WHEN ord % 19 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(100 AS BIGINT) END AS size, CASE WHEN ord % 2 = 1 THEN CASE WHEN ord % 4 = 1 THEN 'seen' ELSE 'other' END END AS content_hash, ord % 31 = 0 AS unreadable
        FROM {album_art} WHERE path <> '' AND ord % 13 <> 0""",
    "playlist_state": """
        SELECT account_id, playlist_id, name, p, CASE WHEN p % 3 = 0 THEN 'old-' || CAST(p AS STRING) || '.m3u8' ELSE name || '-' || CAST(p AS STRING) || '.m3u8' END AS path, CASE WHEN p % 5 = 0 THEN 'x' ELSE 'h' || CAST(p AS STRING) END AS hash
        FROM {playlists} WHERE p % 7 <> 0""",
    "playlist_files": """
        SELECT account_id, path, p % 11 <> 0 AS exists, CASE WHEN p % 6 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(50 AS BIGINT) END AS size, CASE WHEN p % 2 = 0 THEN CASE WHEN p % 8 = 0 THEN hash ELSE 'other' END END AS content_hash, p % 13 = 0 AS unreadable
        FROM {playlist_state} WHERE p % 9 <> 0""",
    "statuses": """
        SELECT account_id, 'library' AS kind, 'mirror' AS mode, k % 3 <> 0 AS fully_enumerated FROM {accounts} UNION ALL SELECT account_id, 'playlist', 'copy', k % 7 <> 0 FROM {accounts} WHERE k % 2 = 0""",
    "run_gate": """
        SELECT account_id, k % 3 <> 0 AND (k % 2 = 1 OR k % 7 <> 0) AS can_delete, k % 3 <> 0 AS library, k % 2 = 1 OR k % 7 <> 0 AS listed FROM {accounts}""",
    "all_files": """
        SELECT account_id, path, exists, size, content_hash, unreadable FROM {inventory} UNION ALL SELECT account_id, path, exists, size, content_hash, unreadable FROM {album_files}
        UNION ALL SELECT account_id, path, exists, size, content_hash, unreadable FROM {playlist_files}""",
    "report_plan": """
        SELECT account_id, clip_id, ord, 0 AS section, 0 AS step, CASE ord % 15 WHEN 0 THEN 'download' WHEN 1 THEN 'reformat' WHEN 2 THEN 'retag' WHEN 3 THEN 'rename' WHEN 4 THEN 'delete' WHEN 5 THEN 'skip' WHEN 6 THEN 'unverifiable' WHEN 7 THEN 'verify_artifact'
                WHEN 8 THEN 'verify_audio' WHEN 9 THEN 'write_artifact' WHEN 10 THEN 'move_artifact' WHEN 11 THEN 'delete_artifact' WHEN 12 THEN 'write_stem' WHEN 13 THEN 'move_stem' ELSE 'delete_stem' END AS action,
            CASE WHEN ord % 15 IN (7, 9, 10, 11) THEN CASE ord % 6 WHEN 0 THEN 'cover_jpg' WHEN 1 THEN 'details_txt' WHEN 2 THEN 'lrc' WHEN 3 THEN 'folder_mp4' WHEN 4 THEN 'playlist' ELSE 'cover_webp' END WHEN ord % 15 > 11 THEN 'stem' ELSE '' END AS slot_kind,
            CASE WHEN ord % 15 > 11 THEN 's' || CAST(ord % 3 AS STRING) ELSE '' END AS slot_key, 'a' || CAST(ord % 50 AS STRING) || '/' || clip_id AS path, CASE WHEN ord % 15 IN (3, 10, 13) THEN 'old/' || clip_id END AS from_path,
            CASE WHEN ord % 2 = 0 THEN 'flac' ELSE 'mp3' END AS format, CASE WHEN ord % 15 = 6 THEN 'cannot read ' || title || ' ' || title || ' ' || title || ' ' || title END AS reason
        FROM {clips}""",
    "give_ups": """
        SELECT account_id, row_number() OVER (PARTITION BY account_id ORDER BY clip_id, n) AS seq, CASE WHEN (ord + n) % 5 < 2 THEN 'shared/' || CAST((ord + n) % 40 AS STRING) ELSE path END AS path, (ord + n) % 3 = 0 AS move, CASE WHEN ord % 6 = 0 THEN 'shared/' || CAST(ord % 40 AS STRING) ELSE 'new/' || path END AS target
        FROM {manifest_slots} WHERE path <> '' AND ord % 4 <> 0""",
}
