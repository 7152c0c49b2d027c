"""Queries of the lyric operators, with their DuckDB SQL. A conversation is a clip, a turn a line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lyrics
from .roles import role, with_roles
from .scalars import with_context

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_roles(sql)
        return f

    return add


_LINES = """SELECT DISTINCT ON (conv_id, turn) CAST(conv_id % 25 AS VARCHAR) AS account_id, CAST(conv_id AS VARCHAR) AS clip_id, turn AS line_no, CASE turn % 5 WHEN 0 THEN '[Chorus]' WHEN 1 THEN ' ' ELSE text || ' ' END AS text, turn * 2.515::DOUBLE AS start_s,
    CASE WHEN turn % 5 = 0 THEN [] ELSE list_transform(string_split(text, ' '), lambda w: w) END AS w FROM conversations ORDER BY conv_id, turn, text"""
_EMIT = "list_filter(w, lambda x: trim(x, ' ' || chr(10) || chr(9)) <> '')"
_TRIM = "trim({x}, ' ' || chr(10) || chr(9) || chr(13))"
_TEXT = f"CASE WHEN {_TRIM.replace('{x}', 'text')} <> '' THEN {_TRIM.replace('{x}', 'text')} ELSE array_to_string(list_transform({_EMIT}, lambda x: {_TRIM.replace('{x}', 'x')}), ' ') END"
L_SQL = f"SELECT *, {_TEXT} AS shown, turn_label AS label FROM (SELECT *, line_no % 5 = 0 AS turn_label FROM ({_LINES}))"


def lines(spark, sf_dir):
    t = role(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    n = F.col("turn") % 5
    start = F.col("turn") * F.lit(2.515)
    words = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("text"), start.alias("start_s")))
    return t.select(
        (F.col("conv_id") % 25).cast("string").alias("account_id"), F.col("conv_id").cast("string").alias("clip_id"), F.col("turn").alias("line_no"), F.when(n == 0, "[Chorus]").when(n == 1, " ").otherwise(F.concat("text", F.lit(" "))).alias("text"),
        start.alias("start_s"), F.when(n == 0, F.array().cast("array<struct<text:string,start_s:double>>")).otherwise(words).alias("words"),
    )


@query("i01_line_text", f"SELECT account_id, clip_id, line_no, shown, label FROM ({L_SQL})")
def i01(spark, sf_dir):
    return lines(spark, sf_dir).select("account_id", "clip_id", "line_no", lyrics.line_text().alias("shown"), lyrics.is_section_label().alias("label"))


@query("i02_plain_text", f"SELECT account_id, clip_id, string_agg(rtrim(text, ' ' || chr(10) || chr(9) || chr(13)), chr(10) ORDER BY line_no) AS text FROM ({_LINES}) GROUP BY ALL")
def i02(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return lyrics.plain_text(rows, rows.select("account_id", "clip_id", F.col("line_no").alias("word_no"), F.col("text").alias("word")))


@query(
    "i05_plain_lyrics",
    f"""SELECT account_id, clip_id, best || chr(10) AS text FROM (SELECT account_id, clip_id, CASE WHEN {_TRIM.replace('{x}', 'lyrics')} <> '' THEN r{_TRIM.replace('{x}', 'lyrics')} WHEN ord % 4 <> 3 THEN nullif(r{_TRIM.replace('{x}', 'title')}, '') END AS best FROM {{clips}})
        WHERE best IS NOT NULL""",
)
def i05b(spark, sf_dir):
    """Lyrics of their own, else aligned ones (here the titles, for three clips in four), else none."""
    rows = role(spark, sf_dir, "clips")
    return lyrics.plain_lyrics(rows, rows.where("ord % 4 <> 3").select("account_id", "clip_id", F.concat("title", F.lit("  ")).alias("text")))


_CS = "CAST(round(start_s * 100) AS BIGINT)"
_STAMP = f"lpad(CAST({_CS} // 6000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({_CS} // 100) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({_CS} % 100 AS VARCHAR), 2, '0')"


@query("i03_lrc_body", f"SELECT account_id, clip_id, string_agg('[' || {_STAMP} || ']' || shown || chr(10), '' ORDER BY line_no) AS body FROM ({L_SQL}) WHERE NOT label GROUP BY ALL")
def i03(spark, sf_dir):
    return lyrics.lrc_body(lines(spark, sf_dir))


_WORDS = f"array_to_string(list_transform({_EMIT}, lambda x: '<' || {_STAMP} || '>' || {_TRIM.replace('{x}', 'x')}), ' ')"


@query(
    "i03_lrc_body_by_word",
    f"SELECT account_id, clip_id, string_agg('[' || {_STAMP} || ']' || CASE WHEN len({_EMIT}) > 0 THEN {_WORDS} ELSE shown END || chr(10), '' ORDER BY line_no) AS body FROM ({L_SQL}) WHERE NOT label GROUP BY ALL",
)
def i03b(spark, sf_dir):
    return lyrics.lrc_body(lines(spark, sf_dir), "word")


@query(
    "i04_timed_entries",
    f"SELECT account_id, clip_id, line_no, 0 AS word_no, CAST(round(start_s * 1000) AS BIGINT) AS ms, CASE WHEN row_number() OVER (PARTITION BY account_id, clip_id ORDER BY line_no) = 1 THEN '' ELSE chr(10) END || shown AS text FROM ({L_SQL}) WHERE NOT label AND shown <> ''",
)
def i04(spark, sf_dir):
    return lyrics.timed_entries(lines(spark, sf_dir))


@query(
    "i05_lrc_document",
    """SELECT account_id, clip_id, CASE WHEN title <> '' THEN '[ti:' || title || ']' || chr(10) ELSE '' END || '[ar:' || CASE WHEN display_name = '' THEN 'Unknown Artist' ELSE display_name END || ']' || chr(10)
        || CASE WHEN trim(gpt_description_prompt) <> '' AND gpt_description_prompt <> title THEN '[al:' || gpt_description_prompt || ']' || chr(10) WHEN title <> '' THEN '[al:' || title || ']' || chr(10) ELSE '' END
        || CASE WHEN duration > 0 THEN '[length:' || CAST(floor(duration + 0.5) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(floor(duration + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ']' || chr(10) ELSE '' END || '[re:mirrorplan]' || chr(10)
        || CASE WHEN ord % 4 = 0 THEN '[00:01.00]x' || chr(10) ELSE lyrics || chr(10) END AS document FROM {clips} WHERE ord % 4 = 0 OR trim(lyrics) <> ''""",
)
def i05(spark, sf_dir):
    rows = with_context(spark, sf_dir)
    return lyrics.lrc_document(rows, rows.where("ord % 4 = 0").select("account_id", "clip_id", F.lit("[00:01.00]x\n").alias("body")))


NOW = 10_000_000
_CHECKS = """SELECT account_id, clip_id, ord, CASE WHEN ord % 5 <> 0 THEN CASE WHEN ord % 7 = 0 THEN 0 ELSE 1 END END AS version, CASE WHEN ord % 6 = 0 THEN 0 ELSE 1 END AS timed_version, CASE WHEN ord % 8 = 0 THEN 'word' ELSE 'line' END AS timing, ord % 3 = 0 AS empty, ord % 2 = 0 AS timed,
    CASE WHEN ord % 4 = 0 THEN 10000000 - 14 * 86400 ELSE 10000000 - 14 * 86400 - 1 END AS checked, CASE WHEN ord % 10 = 0 THEN 'h' ELSE '' END AS plain_hash, CASE WHEN ord % 9 = 0 THEN 'h' ELSE '' END AS timed_hash FROM {manifest}"""


def checked(rows):
    o = F.col("ord")
    return rows.withColumns(
        {"check_version": F.when(o % 5 != 0, F.when(o % 7 == 0, 0).otherwise(1)), "check_timed_version": F.when(o % 6 == 0, 0).otherwise(1), "check_timing": F.when(o % 8 == 0, "word").otherwise("line"), "check_empty": o % 3 == 0, "check_timed": o % 2 == 0,
         "checked_unix": F.when(o % 4 == 0, NOW - 14 * 86400).otherwise(NOW - 14 * 86400 - 1).cast("bigint"), "embedded_lyrics_hash": F.when(o % 10 == 0, "h").otherwise(""), "embedded_timed_lyrics_hash": F.when(o % 9 == 0, "h").otherwise("")}
    )


@query(
    "i06_lyric_targets",
    f"""WITH c AS ({_CHECKS}), d AS (SELECT m.account_id, m.clip_id, m.ord % 2 = 0 AS blank, m.format AS f, r.format AS rf, c.clip_id IS NOT NULL AS m, version, timed_version, timing, empty, timed, 10000000 - checked > 14 * 86400 AS old, plain_hash, timed_hash,
            m.ord % 3 <> 0 AS lrc, m.ord % 4 <> 0 AS txt, m.ord % 5 < 3 AS s_lrc, m.ord % 7 < 4 AS s_txt, m.ord % 11 = 0 AS moved
            FROM {{merged}} m LEFT JOIN c ON c.account_id = m.account_id AND c.clip_id = m.clip_id LEFT JOIN {{manifest}} r ON r.account_id = m.account_id AND r.clip_id = m.clip_id),
        e AS (SELECT *, timed_version <> 1 OR timing <> 'line' AS stale FROM d)
        SELECT DISTINCT account_id, clip_id FROM e WHERE CASE WHEN NOT lrc THEN FALSE WHEN NOT m OR version IS NULL OR version <> 1 OR stale THEN TRUE WHEN empty THEN old WHEN NOT s_lrc OR moved THEN TRUE WHEN NOT timed THEN old ELSE FALSE END
            OR CASE WHEN NOT txt THEN FALSE WHEN NOT m OR version IS NULL OR version <> 1 THEN TRUE WHEN empty THEN old WHEN NOT s_txt OR moved THEN TRUE WHEN NOT timed THEN old ELSE FALSE END
            OR CASE WHEN NOT blank THEN FALSE WHEN NOT m OR rf <> f THEN TRUE WHEN plain_hash <> '' THEN FALSE WHEN coalesce(empty AND version = 1, FALSE) THEN old ELSE TRUE END
            OR CASE WHEN f NOT IN ('mp3', 'wav') OR NOT lrc THEN FALSE WHEN NOT m OR rf <> f OR version IS NULL OR stale THEN TRUE ELSE timed_hash = '' AND timed END""",
)
def i06(spark, sf_dir):
    d, o = role(spark, sf_dir, "merged").withColumn("lyrics_blank", F.col("ord") % 2 == 0), F.col("ord")
    want = d.select("account_id", "clip_id", F.explode(F.array_compact(F.array(F.when(o % 3 != 0, F.lit("lrc")), F.when(o % 4 != 0, F.lit("lyrics_txt"))))).alias("kind"), F.lit("p").alias("path"))
    path = F.when(o % 11 == 0, "q").otherwise("p")
    have = d.select("account_id", "clip_id", F.explode(F.array_compact(F.array(F.when(o % 5 < 3, F.lit("lrc")), F.when(o % 7 < 4, F.lit("lyrics_txt"))))).alias("kind"), path.alias("path"))
    return lyrics.lyric_targets(d, want, checked(role(spark, sf_dir, "manifest")), have, NOW)


@query(
    "i07_apply_lyrics",
    """SELECT m.account_id, m.clip_id, CASE WHEN m.ord % 2 = 0 AND m.ord % 4 = 0 THEN sha256('content' || chr(1) || 'plain') WHEN r.ord % 10 = 0 THEN 'h' ELSE '' END AS embedded_lyrics_hash,
        NOT coalesce(r.format <> m.format AND m.ord % 2 = 0 AND r.ord % 10 = 0 AND m.ord % 4 <> 0, FALSE) AS lyrics_reencode_safe FROM {merged} m LEFT JOIN {manifest} r ON r.account_id = m.account_id AND r.clip_id = m.clip_id""",
)
def i07(spark, sf_dir):
    return applied(spark, sf_dir)[0].select("account_id", "clip_id", "embedded_lyrics_hash", "lyrics_reencode_safe")


def applied(spark, sf_dir):
    d, m = role(spark, sf_dir, "merged").withColumn("lyrics_blank", F.col("ord") % 2 == 0), checked(role(spark, sf_dir, "manifest"))
    m = m.withColumn("embedded_timed_lyrics_hash", F.lit(""))
    slots = d.where("ord % 3 <> 0").select("account_id", "clip_id", F.lit("lyrics_txt").alias("kind"), F.lit("p").alias("path"), F.lit("x").alias("hash"), F.lit(None).cast("string").alias("content"))
    fetched = d.where("ord % 4 < 2").select("account_id", "clip_id", F.when(F.col("ord") % 4 == 0, "plain").alias("plain"), F.lit(None).cast("string").alias("lrc"), F.lit(None).cast("string").alias("timed_hash"))
    return lyrics.apply_lyrics(d, slots, m, role(spark, sf_dir, "manifest_slots"), fetched)


@query(
    "i07_apply_lyrics_slots",
    """SELECT m.account_id, m.clip_id, 'lyrics_txt' AS kind, CASE WHEN m.ord % 4 = 0 THEN sha256('content' || chr(1) || 'plain') ELSE coalesce(s.source_hash, 'x') END AS hash, CASE WHEN m.ord % 4 = 0 THEN 'plain' END AS content
        FROM {merged} m LEFT JOIN {manifest_slots} s ON s.account_id = m.account_id AND s.clip_id = m.clip_id AND s.kind = 'lyrics_txt' WHERE m.ord % 3 <> 0 AND (m.ord % 4 = 0 OR s.source_hash IS NOT NULL OR m.ord % 4 >= 2)""",
)
def i07b(spark, sf_dir):
    return applied(spark, sf_dir)[1].select("account_id", "clip_id", "kind", "hash", "content")


@query(
    "i08_record_checks",
    f"""SELECT account_id, clip_id, CASE WHEN ok THEN 1 ELSE version END AS check_version, CASE WHEN ok THEN 10000000 ELSE checked END AS checked_unix FROM (SELECT *, ord % 2 = 0 AND (ord % 3 = 0 OR ord % 4 = 0) AS ok FROM ({_CHECKS}))""",
)
def i08(spark, sf_dir):
    m, o = checked(role(spark, sf_dir, "manifest")), F.col("ord")
    pending = m.where("ord % 2 = 0").select("account_id", "clip_id", F.lit(False).alias("empty"), F.lit(True).alias("timed"), F.when(o % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("lrc"), F.lit("lyrics_txt"))).alias("slots"))
    landed = m.select("account_id", "clip_id", F.explode(F.when(o % 4 == 0, F.array(F.lit("lrc"), F.lit("lyrics_txt"))).otherwise(F.array(F.lit("lrc")))).alias("kind"))
    return lyrics.record_checks(m, pending, landed, NOW).select("account_id", "clip_id", "check_version", "checked_unix")


@query("i09_lookup_completeness", "SELECT account_id, count(*) FILTER (WHERE ord % 50 = 7) AS n_missing, count(*) FILTER (WHERE ord % 50 = 7) = 0 AS complete FROM {clips} GROUP BY account_id")
def i09(spark, sf_dir):
    rows = role(spark, sf_dir, "clips")
    return lyrics.lookup_completeness(rows, rows.where("ord % 50 <> 7"))


@query(
    "h15_tag_differences",
    "SELECT account_id, clip_id, concat_ws(',', CASE WHEN title <> trim(title) THEN 'title' END, CASE WHEN ord % 3 = 0 THEN 'genre' END) AS fields FROM {clips}",
)
def h15(spark, sf_dir):
    tags = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    seen = tags("title", F.array("title"), "genre", F.when(F.col("ord") % 3 == 0, F.array("tags", "tags")).otherwise(F.array("tags", F.lit(""))), "note", F.array(F.lit("")))
    want = tags("title", F.array(F.trim("title")), "genre", F.array("tags"))
    return role(spark, sf_dir, "clips").select("account_id", "clip_id", F.array_join(lyrics.tag_differences(seen, want, ["title", "genre", "note"]), ",").alias("fields"))


@query(
    "h16_observed_manifest",
    f"""SELECT c.account_id, c.clip_id, CASE WHEN d.clip_id IS NOT NULL AND version IS NOT NULL THEN 0 ELSE version END AS check_version FROM ({_CHECKS}) c LEFT JOIN (SELECT DISTINCT s.account_id, s.clip_id FROM {{manifest_slots}} s
        JOIN {{inventory}} i ON i.account_id = s.account_id AND i.path = s.path WHERE kind = 'lyrics_txt' AND (NOT exists OR size = 0 OR coalesce(s.content_hash <> i.content_hash, FALSE))) d ON d.account_id = c.account_id AND d.clip_id = c.clip_id""",
)
def h16(spark, sf_dir):
    return lyrics.observed_manifest(checked(role(spark, sf_dir, "manifest")), role(spark, sf_dir, "manifest_slots"), role(spark, sf_dir, "inventory")).select("account_id", "clip_id", "check_version")
