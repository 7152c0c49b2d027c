"""Queries of wanted files, playlists and reports, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import desired as want
from ..operators import reports
from ..operators.select import dedupe_first
from . import plan as plan_catalog
from .library import clean_sql, statuses
from .plan import AUDIO_SQL, aimed
from .roles import role, with_roles
from .scalars import ART_SQL, clips, with_context

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_roles(sql)
        return f

    return add


def names(rows):
    return rows.select("account_id", "clip_id", F.concat(F.lit("a"), (F.col("ord") % 50).cast("string"), F.lit("/"), "clip_id").alias("path"))


_BASE = "'a' || (ord % 50) || '/' || clip_id"


@query("h01_build_desired", f"SELECT account_id, clip_id, {_BASE} || '.flac' AS path, {ART_SQL} AS art_hash, CASE WHEN ord % 2 = 0 THEN 'copy' ELSE '' END AS modes, is_trashed AS trashed FROM {{clips}}")
def h01(spark, sf_dir):
    rows = with_context(spark, sf_dir)
    modes = rows.where("ord % 2 = 0").select("account_id", "clip_id", F.array(F.lit("copy")).alias("modes"))
    return want.build_desired(rows, modes, names(rows)).select("account_id", "clip_id", "path", "art_hash", F.array_join("modes", ",").alias("modes"), "trashed")


@query(
    "h02_desired_slots",
    f"""SELECT account_id, clip_id, 'cover_jpg' AS kind, {_BASE} || '.jpg' AS path, CASE WHEN image_large_url <> '' THEN image_large_url ELSE image_url END AS source_url, {ART_SQL} AS hash FROM {{clips}} WHERE image_large_url <> '' OR image_url <> ''
        UNION ALL SELECT account_id, clip_id, 'lyrics_txt', {_BASE} || '.lyrics.txt', '', sha256('lyrics-txt' || chr(1) || 'v1/line' || chr(1) || clip_id) FROM {{clips}}
        UNION ALL SELECT account_id, clip_id, 'lrc', {_BASE} || '.lrc', '', sha256('synced-lrc' || chr(1) || 'v1/line' || chr(1) || clip_id) FROM {{clips}}
        UNION ALL SELECT account_id, clip_id, 'video_mp4', {_BASE} || '.mp4', video_url, sha256('art' || chr(1) || video_url) FROM {{clips}} WHERE video_url <> ''""",
)
def h02(spark, sf_dir):
    rows = with_context(spark, sf_dir)
    return want.desired_slots(rows, names(rows), details=False).select("account_id", "clip_id", "kind", "path", "source_url", "hash")


@query(
    "e04_stem_targets",
    """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'i' || (l_partkey % 2) ELSE '' END AS id, CASE WHEN l_partkey % 3 = 1 THEN 'Vox' ELSE '' END AS label FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
        n AS (SELECT *, CASE WHEN id <> '' THEN id WHEN label <> '' THEN label ELSE 'stem' || l_linenumber END AS name FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, name ORDER BY l_linenumber) - 1 AS nth FROM n)
        SELECT CAST(l_orderkey AS VARCHAR) AS clip_id, CASE WHEN nth = 0 THEN name ELSE name || '-' || nth END AS key, 'x/y.stems/y' || CASE WHEN label <> '' THEN ' - ' || label ELSE '' END || ' [' || CASE WHEN id <> '' THEN id ELSE left(CASE WHEN nth = 0 THEN name ELSE name || '-' || nth END, 8) END || '].mp3' AS path FROM k""",
)
def e04(spark, sf_dir):
    p = F.col("l_partkey")
    rows = role(spark, sf_dir, "lineitem").withColumn("clip_id", F.col("l_orderkey").cast("string")).withColumn("account_id", F.lit("0"))
    rows = dedupe_first(rows, ["l_linenumber", "clip_id"], ["l_partkey", "l_suppkey"])
    rows = rows.select(
        "account_id", "clip_id", F.col("l_linenumber").alias("pos"), F.when(p % 3 == 0, F.concat(F.lit("i"), (p % 2).cast("string"))).otherwise("").alias("stem_id"), F.when(p % 3 == 1, "Vox").otherwise("").alias("label"),
        F.lit("u").alias("url"), F.lit("x/y").alias("base"),
    )
    return want.stem_targets(rows).select("clip_id", "key", "path")


@query("c13_stems_for", "SELECT account_id, clip_id, ord % 5 = 0 AND ord % 3 = 0 AND ord % 2 = 0 AS stems_authoritative FROM {clips}")
def c13(spark, sf_dir):
    rows = role(spark, sf_dir, "clips")
    status = rows.where("ord % 3 = 0").select("account_id", "clip_id", F.lit(True).alias("complete"), (1 - F.col("ord") % 2).alias("n_stems"))
    return want.stems_for(rows.select("account_id", "clip_id"), rows, status)


@query(
    "d08_album_desired",
    """WITH r AS (SELECT account_id, clip_id, handle AS root_id, play_count, created_at, CASE WHEN image_large_url <> '' THEN image_large_url ELSE image_url END AS image, video_cover_url AS preview, 'a' || (ord % 50) AS dir FROM {clips}),
        d AS (SELECT account_id, root_id, min(dir) AS dir FROM r GROUP BY ALL),
        j AS (SELECT account_id, root_id, image FROM r WHERE image <> '' QUALIFY row_number() OVER (PARTITION BY account_id, root_id ORDER BY play_count DESC, created_at, clip_id) = 1),
        w AS (SELECT account_id, root_id, preview FROM r WHERE preview <> '' QUALIFY row_number() OVER (PARTITION BY account_id, root_id ORDER BY created_at, clip_id) = 1)
        SELECT account_id, root_id, 'folder_jpg' AS kind, dir || '/folder.jpg' AS path, image AS source_url, sha256('art' || chr(1) || image) AS hash FROM d JOIN j USING (account_id, root_id)
        UNION ALL SELECT account_id, root_id, 'folder_webp', dir || '/cover.webp', preview, sha256('webp' || chr(1) || preview || chr(1) || 'q80') FROM d JOIN w USING (account_id, root_id)
        UNION ALL SELECT account_id, root_id, 'folder_mp4', dir || '/cover.mp4', preview, sha256('art' || chr(1) || preview) FROM d JOIN w USING (account_id, root_id)""",
)
def d08(spark, sf_dir):
    rows = clips(spark, sf_dir).withColumn("root_id", F.col("handle"))
    return want.album_desired(names(rows), rows)


@query(
    "h17_lossless_fallback",
    """SELECT m.account_id, m.clip_id, CASE WHEN g.can_delete OR m.format = 'mp3' THEN m.path WHEN r.format IN ('flac', 'wav') AND i.path IS NOT NULL THEN left(m.path, length(m.path) - 4) || r.format ELSE left(m.path, length(m.path) - 4) || 'mp3' END AS path, m.path AS old_path
        FROM {merged} m JOIN {gate} g USING (account_id) LEFT JOIN {manifest} r ON r.account_id = m.account_id AND r.clip_id = m.clip_id LEFT JOIN (SELECT DISTINCT account_id, path FROM {inventory} WHERE exists AND size > 0) i ON i.account_id = r.account_id AND i.path = r.path""",
)
def h17(spark, sf_dir):
    d, _, m, _, i = plan_catalog.tables(spark, sf_dir)
    access = role(spark, sf_dir, "gate").select("account_id", F.col("can_delete").alias("available"))
    return want.lossless_fallback(plan_catalog.plan.aggregate_desired(d), m, i, access).select("account_id", "clip_id", "path", "old_path")


_ENTRIES = "SELECT m.account_id, playlist_id, pos, m.clip_id, m.title, m.duration, CASE WHEN c.ord % 3 <> 0 THEN 'a' || (c.ord % 50) || '/' || c.clip_id ELSE '' END AS path FROM {members} m JOIN {clips} c ON c.clip_id = m.clip_id AND c.account_id = m.account_id"


def entries(spark, sf_dir):
    rows = role(spark, sf_dir, "clips")
    return want.playlist_entries(role(spark, sf_dir, "members"), names(rows.where("ord % 3 <> 0")), rows)


@query("c07_playlist_entries", _ENTRIES)
def c07(spark, sf_dir):
    return entries(spark, sf_dir)


_LINE = "CASE WHEN path = '' THEN '# (not in library) ' || title || chr(10) ELSE '#EXTINF:' || CAST(floor(duration + 0.5) AS BIGINT) || ',' || title || chr(10) || path || chr(10) END"
M3U8_SQL = f"""SELECT p.account_id, p.playlist_id, coalesce(nullif({clean_sql('name')}, ''), 'playlist') || '.m3u8' AS path, '#EXTM3U' || chr(10) || '#PLAYLIST:' || name || chr(10) || coalesce(body, '') AS content FROM {{playlists}} p
    LEFT JOIN (SELECT account_id, playlist_id, string_agg({_LINE}, '' ORDER BY pos, {_LINE}) AS body FROM ({_ENTRIES}) GROUP BY ALL) b USING (account_id, playlist_id)"""


@query("e06_render_m3u8", M3U8_SQL)
def e06(spark, sf_dir):
    return want.render_m3u8(role(spark, sf_dir, "playlists"), entries(spark, sf_dir)).select("account_id", "playlist_id", "path", "content")


@query(
    "h18_rewrite_playlist_paths",
    """WITH w AS (SELECT account_id, conv_id, string_agg(text, chr(10) ORDER BY turn) AS content FROM (SELECT CAST(conv_id % 25 AS VARCHAR) AS account_id, conv_id, turn, 'p' || (turn % 5) AS text FROM conversations) GROUP BY ALL)
        SELECT account_id, conv_id, replace(replace(content, 'p1', 'new1'), 'p3', 'new3') AS content FROM w""",
)
def h18(spark, sf_dir):
    lines = role(spark, sf_dir, "conversations").select((F.col("conv_id") % 25).cast("string").alias("account_id"), F.col("conv_id").alias("playlist_id"), "turn", F.concat(F.lit("p"), (F.col("turn") % 5).cast("string")).alias("t"))
    lists = lines.groupBy("account_id", "playlist_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n").alias("content")).withColumn("hash", F.lit("h"))
    moved = lines.where("t in ('p1', 'p3')").select("account_id", F.col("t").alias("old_path"), F.replace("t", F.lit("p"), F.lit("new")).alias("path")).distinct()
    return want.rewrite_playlist_paths(lists, moved).select("account_id", F.col("playlist_id").alias("conv_id"), "content")


@query("f03_protected_playlists", "SELECT account_id, playlist_id FROM {playlists} WHERE p % 3 <> 0")
def f03(spark, sf_dir):
    rows = role(spark, sf_dir, "playlists")
    return want.protected_playlists(rows, rows.where("p % 3 = 0"))


@query(
    "h20_scoped_playlists",
    """SELECT DISTINCT account_id, CASE kind WHEN 'liked' THEN 'liked' ELSE 'area-' || area_ord END AS playlist_id, CASE kind WHEN 'liked' THEN 'Liked Songs' ELSE 'List ' || area_ord END AS name FROM (SELECT a.*, coalesce(n, 0) AS n FROM {areas} a LEFT JOIN (SELECT account_id, area_ord, count(*) AS n FROM {area_clips} GROUP BY ALL) USING (account_id, area_ord))
        WHERE kind <> 'library' AND complete AND NOT any_filtered AND NOT narrowed AND NOT (n = 0 AND mode = 'mirror')""",
)
def h20(spark, sf_dir):
    rows = statuses(spark, sf_dir)
    n = F.col("area_ord").cast("string")
    return want.scoped_playlists(rows.withColumns({"area_id": F.concat(F.lit("area-"), n), "name": F.concat(F.lit("List "), n)}))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE action IN ({', '.join(repr(a) for a in v)})) AS {k}" for k, v in reports.BUCKETS.items())


@query("d09_plan_summary", f"SELECT account_id, {_COUNTS}, count(*) AS total FROM ({AUDIO_SQL}) GROUP BY account_id")
def d09(spark, sf_dir):
    return reports.plan_summary(plan_catalog.h03(spark, sf_dir))


GUARD_SQL = """SELECT a.account_id, CASE WHEN deletes = 0 OR had = 0 THEN FALSE WHEN want = 0 THEN NOT (k % 2 = 0 AND k % 3 = 0) WHEN k % 5 = 0 AND k % 3 = 0 THEN FALSE ELSE had >= 8 AND deletes * 2 >= had END AS abort FROM {accounts} a JOIN (
        SELECT account_id, count(*) FILTER (WHERE ord % 7 <> 0) AS had, count(*) FILTER (WHERE ord % 7 <> 0 AND (ord % 3 = 0 OR CAST(account_id AS INTEGER) % 4 = 0)) AS deletes, count(*) FILTER (WHERE ord % 2 = 0 AND CAST(account_id AS INTEGER) % 8 <> 0) AS want FROM {clips} GROUP BY ALL) USING (account_id)"""


def guard_inputs(spark, sf_dir):
    """Accounts with what their run asked for, a plan of which some accounts' deletes look like a broken listing, and what is wanted and recorded."""
    rows, k = role(spark, sf_dir, "clips"), F.col("account_id").cast("int")
    accounts = role(spark, sf_dir, "accounts").select("account_id", (F.col("k") % 5).alias("min_newest"), (F.col("k") % 2 == 0).alias("explicit_zero"), (F.col("k") % 3 == 0).alias("yes")).join(rows, "account_id", "left_semi")
    had = rows.where("ord % 7 <> 0")
    plan = had.withColumn("action", F.when((F.col("ord") % 3 == 0) | (k % 4 == 0), "delete").otherwise("skip"))
    return accounts, plan, rows.where((F.col("ord") % 2 == 0) & (k % 8 != 0)), had


@query("d10_mass_delete_guard", GUARD_SQL)
def d10(spark, sf_dir):
    return reports.mass_delete_guard(*guard_inputs(spark, sf_dir))


@query(
    "d10_guarded_plan",
    f"""SELECT account_id, clip_id, CASE WHEN ord % 3 = 0 OR CAST(account_id AS INTEGER) % 4 = 0 THEN 'delete' ELSE 'skip' END AS action FROM {{clips}} JOIN ({GUARD_SQL}) USING (account_id) WHERE ord % 7 <> 0 AND NOT abort""",
)
def d10b(spark, sf_dir):
    accounts, plan, wanted, had = guard_inputs(spark, sf_dir)
    return reports.guarded(plan, reports.mass_delete_guard(accounts, plan, wanted, had)).select("account_id", "clip_id", "action")


_RUNS = "SELECT o_custkey AS a, max(o_orderkey % 101) AS x, count(*) FILTER (WHERE o_orderkey % 23 = 0) AS u, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS f, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS p FROM {orders} GROUP BY o_custkey"


@query(
    "d11_run_severity",
    f"""WITH r AS ({_RUNS}), c AS (SELECT CAST(a AS VARCHAR) AS account_id, CASE WHEN x = 100 THEN 9 WHEN x = 99 THEN 4 WHEN u > 0 THEN 5 WHEN f = 0 THEN 0 WHEN p = 0 THEN 6 ELSE 5 END AS code FROM r) SELECT account_id, code FROM c UNION ALL SELECT NULL, max(code) FROM c""",
)
def d11(spark, sf_dir):
    text = "SELECT CAST(a AS STRING) AS account_id, CASE x WHEN 100 THEN 'disk_full' WHEN 99 THEN 'auth_aborted' ELSE 'done' END AS status, u AS n_unverifiable, f AS n_failed, p AS n_progressed FROM (" + _RUNS + ")"
    return reports.run_severity(spark.sql(text, orders=role(spark, sf_dir, "orders")))


@query("d12_path_refcounts", "SELECT account_id, path, count(*) AS n FROM (SELECT account_id, path FROM {manifest} UNION ALL SELECT account_id, path FROM {manifest_slots} UNION ALL SELECT account_id, 'a' || (ord % 50) || '/folder.jpg' FROM {clips} WHERE image_url <> '' UNION ALL SELECT account_id, lower(name) FROM {playlists}) WHERE path <> '' GROUP BY ALL")
def d12(spark, sf_dir):
    lists = role(spark, sf_dir, "playlists").select("account_id", F.lower("name").alias("path"))
    albums = role(spark, sf_dir, "clips").where("image_url <> ''").select("account_id", F.concat(F.lit("a"), (F.col("ord") % 50).cast("string"), F.lit("/folder.jpg")).alias("path"))
    return reports.path_refcounts(role(spark, sf_dir, "manifest"), role(spark, sf_dir, "manifest_slots"), albums, lists)


@query(
    "d12_release_paths",
    """WITH held AS (SELECT account_id, path, count(*) + 1 - any_value(length(path)) % 2 AS n FROM {give_ups} WHERE length(path) % 7 <> 0 GROUP BY account_id, path), w AS (SELECT account_id, target AS path, min(seq) AS first FROM {give_ups} GROUP BY ALL),
        e AS (SELECT g.account_id, seq, g.path, move, coalesce(n, 0) - row_number() OVER (PARTITION BY g.account_id, g.path ORDER BY seq) AS after, coalesce(first < seq, FALSE) AS taken FROM {give_ups} g LEFT JOIN held USING (account_id, path) LEFT JOIN w USING (account_id, path))
        SELECT account_id, seq, path, move, CASE WHEN NOT move THEN 'write' WHEN after <= 0 AND NOT taken THEN 'rename' ELSE 'refetch' END AS outcome, NOT move AND after <= 0 AND NOT taken AS removed FROM e""",
)
def d12b(spark, sf_dir):
    events = role(spark, sf_dir, "give_ups")
    held = events.where(F.length("path") % 7 != 0).groupBy("account_id", "path").agg((F.count("*") + 1 - F.any_value(F.length("path")) % 2).alias("n"))
    return reports.release_paths(events.drop("target"), held, events.select("account_id", "seq", F.col("target").alias("path")))


@query("d13_plan_changes", f"SELECT account_id, bool_or(action <> 'skip') AS has_changes FROM ({AUDIO_SQL}) GROUP BY account_id")
def d13(spark, sf_dir):
    return reports.plan_changes(plan_catalog.h03(spark, sf_dir))


@query("d13_deletion_paths", f"SELECT account_id, clip_id, path FROM ({AUDIO_SQL}) WHERE action = 'delete'")
def d13b(spark, sf_dir):
    return reports.deletion_paths(plan_catalog.h03(spark, sf_dir))


@query(
    "c14_shared_sources",
    "SELECT account_id, source_url, count(*) AS n FROM (SELECT account_id, CASE WHEN ord % 3 = 0 THEN '' ELSE 'u' || (ord % 40) END AS source_url FROM {clips} WHERE ord % 5 = 3) WHERE source_url <> '' GROUP BY ALL HAVING count(*) > 1",
)
def c14(spark, sf_dir):
    p = aimed(spark, sf_dir)[0].join(role(spark, sf_dir, "clips").select("account_id", "clip_id", "ord"), ["account_id", "clip_id"])
    return reports.shared_sources(p.withColumn("source_url", F.when(F.col("ord") % 3 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("ord") % 40).cast("string")))))


@query("c15_failure_rows", "SELECT account_id, clip_id, 'transient' AS class, 'x' AS reason, CASE WHEN ord % 2 = 0 THEN title ELSE '' END AS title, 'https://www.example.org/song/' || clip_id AS url FROM {clips} WHERE ord % 5 = 0")
def c15(spark, sf_dir):
    rows = role(spark, sf_dir, "clips")
    return reports.failure_rows(rows.where("ord % 5 = 0").select("account_id", "clip_id", F.lit("transient").alias("class"), F.lit("x").alias("reason")), rows.where("ord % 2 = 0"))


@query("a16_audit_rows", f"SELECT 't' AS at, account_id, clip_id, action, '' AS slot_kind, path FROM ({AUDIO_SQL}) WHERE action IN ('delete', 'rename') AND (account_id, clip_id) NOT IN (SELECT (account_id, clip_id) FROM {{clips}} WHERE ord % 4 = 0)")
def a16(spark, sf_dir):
    p = plan_catalog.plan.plan_audio(plan_catalog.inputs(spark, sf_dir))
    return reports.audit_rows(p, role(spark, sf_dir, "clips").where("ord % 4 = 0"), "t").drop("from_path")


@query(
    "a14_library_index",
    """SELECT m.account_id, m.clip_id, m.path, m.format, m.size, CASE WHEN c.ord % 4 <> 0 AND c.title <> '' THEN c.title WHEN c.ord % 3 = 0 THEN 'node ' || c.title ELSE 'Untitled' END AS title, CASE WHEN c.ord % 4 <> 0 THEN coalesce(nullif(display_name, ''), 'Unknown Artist') END AS artist,
        CASE WHEN c.ord % 4 <> 0 THEN nullif(handle, '') END AS handle, CASE WHEN c.ord % 2 = 0 THEN tags ELSE '' END AS album, CASE WHEN c.ord % 5 = 0 AND tags <> '' THEN tags ELSE m.clip_id END AS root_id, CASE WHEN c.ord % 3 = 0 THEN created_at END AS created_at,
        CASE WHEN c.ord % 4 <> 0 THEN duration END AS duration, CASE WHEN c.ord % 4 <> 0 THEN tags END AS tags FROM {manifest} m JOIN {clips} c ON c.clip_id = m.clip_id AND c.account_id = m.account_id""",
)
def a14(spark, sf_dir):
    rows = role(spark, sf_dir, "clips")
    node = rows.where("ord % 3 = 0").withColumn("title", F.concat(F.lit("node "), "title"))
    return reports.library_index(role(spark, sf_dir, "manifest").drop("ord"), node, rows.where("ord % 5 = 0").withColumn("root_id", F.col("tags")), rows.where("ord % 4 <> 0"), rows.where("ord % 2 = 0").withColumn("album", F.col("tags")))


def cut_sql(x: str, size: int) -> str:
    return f"CASE WHEN length({x}) <= {size} THEN {x} ELSE left({x}, {size - 1}) || '…' END"


_TITLED = "CASE WHEN trim(title) = '' THEN 'Untitled' ELSE title END"
_LISTING = f"""SELECT account_id, clip_id, concat_ws(chr(9), clip_id, printf('%.1fs', duration), {cut_sql(_TITLED, 48)}, tags) AS line FROM {{clips}}"""
_JSON = ", ".join(f"'{k}', " + {"id": "clip_id", "title": _TITLED, "has_vocal": "FALSE"}.get(k, f"nullif({k}, '')" if k in reports.NULLABLE else k) for k in reports.LISTED)


@query("a15_export_listing", _LISTING)
def a15(spark, sf_dir):
    return reports.export_listing(role(spark, sf_dir, "clips")).drop("json")


@query("a15_export_json", f"SELECT account_id, clip_id, CAST(json_object({_JSON}) AS VARCHAR) AS json FROM {{clips}}")
def a15b(spark, sf_dir):
    return reports.export_listing(role(spark, sf_dir, "clips")).drop("line")


_KIND = "CASE slot_kind WHEN 'cover_jpg' THEN 'cover.jpg' WHEN 'details_txt' THEN 'details.txt' WHEN 'folder_mp4' THEN 'cover.mp4' WHEN 'cover_webp' THEN 'cover.webp' ELSE slot_kind END"


@query(
    "a19_plan_report",
    f"""WITH r AS (SELECT p.*, row_number() OVER (PARTITION BY p.account_id ORDER BY p.clip_id) AS seq, left(p.clip_id, 8) AS id, CASE WHEN p.ord % 3 = 0 THEN '  [FAILED]' ELSE '' END AS f, {cut_sql(_TITLED, 40)} AS t, {_KIND} AS kind
            FROM {{report_plan}} p JOIN {{clips}} c ON c.account_id = p.account_id AND c.clip_id = p.clip_id)
        SELECT account_id, CAST(seq AS INTEGER) AS seq, CASE action WHEN 'download' THEN '  download  ' || id || '  ' || t || '  ' || path || f WHEN 'reformat' THEN '  reformat  ' || id || '  ' || t || '  -> ' || format || ' ' || path || f
            WHEN 'retag' THEN '  tag       ' || id || '  ' || t || '  tags updated' || f WHEN 'rename' THEN '  rename    ' || from_path || ' -> ' || path WHEN 'delete' THEN '  delete    ' || id || '  ' || path || '  removed (absent from source)' || f
            WHEN 'skip' THEN '  skip      ' || id || '  already up to date' WHEN 'unverifiable' THEN '  verify    ' || id || '  ' || path || '  ' || {cut_sql('reason', 80)} || f WHEN 'verify_artifact' THEN '  skip      ' || id || '  ' || kind || ' verified at ' || path
            WHEN 'verify_audio' THEN '  skip      ' || id || '  audio metadata verified' WHEN 'write_artifact' THEN '  artifact  ' || id || '  ' || kind || '  -> ' || path || f WHEN 'move_artifact' THEN '  artifact  ' || id || '  ' || kind || '  ' || from_path || ' -> ' || path || f
            WHEN 'delete_artifact' THEN '  artifact  ' || id || '  ' || kind || '  removed ' || path || f WHEN 'write_stem' THEN '  stem      ' || id || '  ' || slot_key || '  -> ' || path || f WHEN 'move_stem' THEN '  stem      ' || id || '  ' || slot_key || '  ' || from_path || ' -> ' || path || f
            ELSE '  stem      ' || id || '  ' || slot_key || '  removed ' || path || f END AS line FROM r""",
)
def a19(spark, sf_dir):
    """Every action of the plan as a line; failed clips are marked."""
    rows = role(spark, sf_dir, "clips")
    return reports.plan_report(plan_catalog.plan.order_plan(role(spark, sf_dir, "report_plan")), rows.where("ord % 3 = 0"), rows)


def _lines(pairs, values):
    return " || ".join(f"chr(10) || '  {label:<11} ' || lpad(CAST({values.get(n, n)} AS VARCHAR), CAST(greatest(4, length(CAST({values.get(n, n)} AS VARCHAR))) AS INTEGER), ' ')" for label, n in pairs)


@query("a19_dry_summary", f"SELECT account_id, 'Dry run: ' || account_id || ' (no changes made)' || {_lines(reports.PENDING, {})} AS text FROM (SELECT account_id, {_COUNTS}, count(*) AS total FROM {{report_plan}} GROUP BY account_id)")
def a19b(spark, sf_dir):
    return reports.dry_summary(role(spark, sf_dir, "report_plan"))


_RAN = {n: f"count(*) FILTER (WHERE o_orderkey % 9 = {k})" for k, (_, n) in enumerate(reports.DONE[:-1])}
_ALL = "count(*) FILTER (WHERE o_orderkey % 9 < 8)"
_SECS = "CAST(sum(o_orderkey % 400) AS DOUBLE) / 4"


@query(
    "a19_run_summary",
    f"""SELECT account_id, CASE x WHEN 0 THEN 'Sync aborted: ' || account_id || ' (disk full, run stopped early)' WHEN 1 THEN 'Sync aborted: ' || account_id || ' (authentication failed, run stopped early)' ELSE 'Sync complete: ' || account_id END
        || {_lines(reports.DONE, {})} || chr(10) || 'Duration: ' || printf('%.1fs', secs) AS text
        FROM (SELECT CAST(o_custkey AS VARCHAR) AS account_id, o_custkey % 7 AS x, {', '.join(f'{v} AS {k}' for k, v in _RAN.items())}, {_ALL} AS total, {_SECS} AS secs FROM orders GROUP BY o_custkey)""",
)
def a19c(spark, sf_dir):
    o = F.col("o_orderkey")
    runs = role(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(*(F.count_if(o % 9 == k).alias(n) for k, (_, n) in enumerate(reports.DONE[:-1])), (F.sum(o % 400).cast("double") / 4).alias("seconds"))
    status = F.when(F.col("k") % 7 == 0, "disk_full").when(F.col("k") % 7 == 1, "auth_aborted").otherwise("completed")
    return reports.run_summary(runs.withColumns({"account_id": F.col("k").cast("string"), "status": status}), "Sync")


def _blocks(head: str, more: str, end: str, source: str) -> str:
    return f"""WITH p AS ({source}), r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY path) AS k, count(*) OVER (PARTITION BY account_id) AS n FROM p)
        SELECT account_id, {head} || string_agg(CASE WHEN k <= 20 THEN '  ' || path || chr(10) ELSE '' END, '' ORDER BY k) || CASE WHEN any_value(n) > 20 THEN {more} ELSE '' END || {end} AS text FROM r GROUP BY account_id"""


@query(
    "a19_orphan_report",
    _blocks(
        "'note: ' || any_value(n) || ' untracked audio file(s) on disk, not touched (moved or renamed by hand, or from an older layout):' || chr(10)", "'  ... and ' || (any_value(n) - 20) || ' more' || chr(10)",
        "'  Move each into place or delete it; a re-sync re-downloads any a clip still needs.'", "SELECT account_id, clip_id || '.mp3' AS path FROM {clips} WHERE CAST(account_id AS INTEGER) % 2 = 0 OR ord % 60 = 7",
    ),
)
def a19d(spark, sf_dir):
    rows = role(spark, sf_dir, "clips").where("CAST(account_id AS INTEGER) % 2 = 0 OR ord % 60 = 7")
    return reports.orphan_report(rows.select("account_id", F.concat("clip_id", F.lit(".mp3")).alias("path")))


@query(
    "a19_delete_prompt",
    _blocks(
        "'sync will delete ' || any_value(n) || ' local file(s) that are no longer in the source:' || chr(10)", "'  ... and ' || (any_value(n) - 20) || ' more (run with -v to see the full list)' || chr(10)", "chr(10) || 'Proceed?'",
        "SELECT account_id, path FROM {report_plan} WHERE action IN ('delete', 'delete_artifact', 'delete_stem')",
    ),
)
def a19e(spark, sf_dir):
    return reports.delete_prompt(reports.deletion_paths(role(spark, sf_dir, "report_plan")))


@query(
    "c04_orphan_files",
    r"""WITH tracked AS (SELECT account_id, lower(path) AS key FROM {manifest} UNION SELECT account_id, lower(path) FROM {manifest_slots}),
        found AS (SELECT DISTINCT account_id, CASE WHEN length(path) % 2 = 0 THEN path ELSE 'loose/' || path END AS path FROM {inventory} WHERE exists)
        SELECT account_id, path FROM found WHERE regexp_matches(lower(path), '\.(flac|mp3|wav|m4a)$') AND (account_id, lower(path)) NOT IN (SELECT (account_id, key) FROM tracked)""",
)
def c04(spark, sf_dir):
    found = role(spark, sf_dir, "inventory").withColumn("path", F.when(F.length("path") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("loose/"), "path")))
    return reports.orphan_files(found, role(spark, sf_dir, "manifest"), role(spark, sf_dir, "manifest_slots"))
