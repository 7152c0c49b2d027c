"""Queries of naming, selection and authority operators, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming
from ..operators import authority, select
from .roles import role, with_roles
from .scalars import CREATED_SQL, clips, with_context  # noqa: F401

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_roles(sql)
        return f

    return add


def clean_sql(x: str, size: str = "80", ascii_only: bool = False) -> str:
    """SQL of a sanitised component."""
    if ascii_only:
        folded, plain = "".join(naming.FOLDED.values()), "".join(k * len(v) for k, v in naming.FOLDED.items())
        x = f"translate({x}, '{folded}', '{plain}')"
        for one, two in naming.PAIRS.items():
            x = f"replace({x}, '{one}', '{two}')"
        x = rf"regexp_replace({x}, '[^\x00-\x7F]', ' ', 'g')"
    x = rf"regexp_replace({x}, '[<>:\"/\\|?*\x00-\x1F\x7F-\x{{9F}}]', ' ', 'g')"
    x = rf"regexp_replace({x}, '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+', ' ', 'g')"
    x = f"trim(left(trim({x}, ' .'), greatest(1, {size})), ' .')"
    return rf"regexp_replace({x}, '(?i)^{naming.DEVICES}(\.|$)', concat(regexp_extract({x}, '(?i)^({naming.DEVICES})', 1), '_\1'))"


@query(
    "b14_sanitise_component",
    f"""SELECT doc_id, {clean_sql("w")} AS plain, {clean_sql("w", "12")} AS short, {clean_sql("w", "40", True)} AS folded
        FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '. ' || text || ' ..' WHEN 2 THEN 'a<b>:c|' || text WHEN 3 THEN 'con.' || text ELSE 'Lpt' || CAST(doc_id % 10 AS VARCHAR) || '.' || text END AS w FROM documents)""",
)
def b14(spark, sf_dir):
    d = F.col("doc_id") % 5
    w = (
        F.when(d == 0, F.col("text")).when(d == 1, F.concat(F.lit(". "), "text", F.lit(" .."))).when(d == 2, F.concat(F.lit("a<b>:c|"), "text"))
        .when(d == 3, F.concat(F.lit("con."), "text")).otherwise(F.concat(F.lit("Lpt"), (F.col("doc_id") % 10).cast("string"), F.lit("."), "text"))
    )
    rows = role(spark, sf_dir, "documents").select("doc_id", w.alias("w"))
    return rows.select(
        "doc_id", naming.sanitise_component("w").alias("plain"), naming.sanitise_component("w", size=12).alias("short"), naming.sanitise_component("w", "ascii", 40).alias("folded")
    )


@query(
    "b15_names",
    f"""SELECT account_id, clip_id, CASE WHEN trim(display_name) <> '' THEN trim(display_name) WHEN trim(handle) <> '' THEN trim(handle) ELSE 'Unknown Creator' END AS creator,
        CASE WHEN trim(title) = '' OR lower(trim(title)) = 'untitled' THEN 'Untitled' ELSE trim(title) END AS name, coalesce(nullif({clean_sql("prompt")}, ''), 'playlist') AS list FROM {{clips}}""",
)
def b15(spark, sf_dir):
    return role(spark, sf_dir, "clips").select("account_id", "clip_id", naming.creator_name().alias("creator"), naming.title_name().alias("name"), naming.sanitise_name("prompt").alias("list"))


def suffix_sql(base: str, suffix: str, size: int = 80) -> str:
    mark = f"concat(' [', {suffix}, ']')"
    top = f"greatest({size}, length({mark}) + 1)"
    cut = f"left(rtrim({clean_sql(base, top)}), CAST({top} - length({mark}) AS BIGINT))"
    return f"CASE WHEN ends_with({base}, {mark}) THEN {clean_sql(base, str(size))} ELSE {clean_sql(f'concat({cut}, {mark})', top)} END"


@query(
    "b16_append_suffix",
    f"""SELECT account_id, clip_id, {suffix_sql("title", "clip_id")} AS long, {suffix_sql("title", "left(clip_id, 4)", 12)} AS cut, {suffix_sql("concat(title, ' [', clip_id, ']')", "clip_id")} AS once FROM {{clips}}""",
)
def b16(spark, sf_dir):
    whole = F.concat("title", F.lit(" ["), "clip_id", F.lit("]"))
    return role(spark, sf_dir, "clips").select(
        "account_id", "clip_id", naming.append_suffix("title", "clip_id").alias("long"), naming.append_suffix("title", F.left("clip_id", F.lit(4)), size=12).alias("cut"), naming.append_suffix(whole, "clip_id").alias("once")
    )


_CREATOR = "CASE WHEN trim(display_name) <> '' THEN trim(display_name) WHEN trim(handle) <> '' THEN trim(handle) ELSE 'Unknown Creator' END"
TITLE_SQL = "CASE WHEN trim(title) = '' OR lower(trim(title)) = 'untitled' THEN 'Untitled' ELSE trim(title) END"
#: Path of the default template, before any collision; columns al (the album's component), root_id, trk.
PATH_SQL = f"""SELECT account_id, clip_id, concat_ws('/', nullif(creator, ''), nullif(al, ''), CASE WHEN ends_with(leaf, tail) THEN
        {suffix_sql("left(leaf, length(leaf) - length(tail))", "left(clip_id, 8)")} ELSE {clean_sql("leaf")} END) AS path
    FROM (SELECT *, concat(' [', left(clip_id, 8), ']') AS tail, concat(CASE WHEN trk > 0 THEN lpad(CAST(trk AS VARCHAR), 2, '0') || ' - ' ELSE '' END, creator, '-', name, ' [', left(clip_id, 8), ']') AS leaf
        FROM (SELECT *, {clean_sql(_CREATOR)} AS creator, {clean_sql(TITLE_SQL)} AS name FROM named))"""


@query(
    "b17_render_template",
    f"WITH named AS (SELECT account_id, clip_id, display_name, handle, title, {clean_sql('gpt_description_prompt')} AS al, CAST(ord % 4 AS INTEGER) AS trk FROM {{clips}}) {PATH_SQL}",
)
def b17(spark, sf_dir):
    rows = with_context(spark, sf_dir)
    v = naming.placeholder_values(naming.sanitise_component("gpt_description_prompt"))
    return rows.select("account_id", "clip_id", naming.render_template(v, [v["id8"], v["root_id8"]]).alias("path"))


@query(
    "b18_paths",
    r"""SELECT page_id, CASE WHEN contains(url, '/') THEN regexp_extract(url, '(?s)^(.*)/[^/]*$', 1) ELSE '' END AS dir, regexp_extract(url, '[^/]*$') AS file, concat_ws('/', nullif(regexp_extract(url, '(?s)^(.*)/[^/]*$', 1), ''), 'x.jpg') AS sibling,
        CASE WHEN ends_with(url, '.html') THEN left(url, length(url) - 5) END AS base, array_to_string(list_filter(string_split(url, '/'), lambda p: p NOT IN ('', '.', '..')), '/') AS relative,
        coalesce(nullif(left(lower(regexp_replace(regexp_replace(url, '^\.+', ''), '[^A-Za-z0-9]', '', 'g')), 8), ''), 'mp3') AS ext,
        'new.stems/' || regexp_extract(url, '[^/]*$') AS moved FROM pages""",
)
def b18(spark, sf_dir):
    old = F.concat(F.lit("a/b.stems/"), naming.file_name("url"))
    return role(spark, sf_dir, "pages").select(
        "page_id", naming.parent_dir("url").alias("dir"), naming.file_name("url").alias("file"), naming.set_file_name("url", F.lit("x.jpg")).alias("sibling"), naming.audio_base("url", F.lit("html")).alias("base"),
        naming.relative_path("url").alias("relative"), naming.clean_extension("url").alias("ext"), naming.relocated_stem_path(F.lit("new"), old).alias("moved"),
    )


@query("b19_canonical_path_key", "SELECT doc_id, lower(nfc_normalize(CASE WHEN doc_id % 2 = 0 THEN replace(text, 'é', 'e' || chr(769)) ELSE text END)) AS key FROM documents")
def b19(spark, sf_dir):
    mixed = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("é"), F.lit("é"))).otherwise(F.col("text"))
    return role(spark, sf_dir, "documents").select("doc_id", naming.canonical_path_key(mixed).alias("key"))


@query(
    "b26_layered_settings",
    """SELECT account_id, CASE WHEN k % 2 = 0 THEN 'flac' WHEN k % 3 = 0 THEN 'wav' ELSE 'mp3' END AS format, CASE WHEN k % 5 = 0 THEN 'x' WHEN k % 7 = 0 THEN '99' ELSE '4' END AS concurrency,
        CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'concurrency' ELSE '' END AS invalid FROM {accounts}""",
)
def b26(spark, sf_dir):
    a = role(spark, sf_dir, "accounts")
    layer = lambda tier, key, value, where: a.where(where).select("account_id", F.lit(tier).alias("tier"), F.lit(key).alias("key"), F.lit(value).alias("value"))
    rows = layer(6, "format", "mp3", "true").union(layer(1, "format", "flac", "k % 2 = 0")).union(layer(3, "format", "wav", "k % 3 = 0")).union(layer(2, "format", None, "true"))
    rows = rows.union(layer(6, "concurrency", "4", "true")).union(layer(0, "concurrency", "x", "k % 5 = 0")).union(layer(1, "concurrency", "99", "k % 7 = 0"))
    return select.layered_settings(rows, ["format", "concurrency"], {"concurrency": (1, 16)})


@query(
    "c05_resolve_leads",
    """WITH wanted AS (SELECT DISTINCT account_id, entry FROM (SELECT account_id, CASE ord % 3 WHEN 0 THEN upper(left(clip_id, 8)) WHEN 1 THEN clip_id ELSE left(clip_id, 6) || 'zz' END AS entry FROM {clips})),
        hits AS (SELECT w.account_id, w.entry, count(DISTINCT c.clip_id) AS n, min(c.clip_id) AS clip_id FROM wanted w LEFT JOIN {clips} c ON c.account_id = w.account_id AND starts_with(lower(c.clip_id), lower(w.entry)) GROUP BY ALL)
        SELECT account_id, entry, CASE n WHEN 0 THEN 'unmatched' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN clip_id END AS clip_id FROM hits""",
)
def c05(spark, sf_dir):
    rows = role(spark, sf_dir, "clips")
    o, i = F.col("ord") % 3, F.col("clip_id")
    entry = F.when(o == 0, F.upper(F.left(i, F.lit(8)))).when(o == 1, i).otherwise(F.concat(F.left(i, F.lit(6)), F.lit("zz")))
    return select.resolve_leads(rows, rows.select("account_id", F.concat(F.lit(" "), entry).alias("entry")))


@query(
    "c06_resolve_playlist_refs",
    """WITH refs AS (SELECT DISTINCT account_id, ref FROM (SELECT account_id, CASE p % 4 WHEN 0 THEN name WHEN 1 THEN playlist_id WHEN 2 THEN upper(name) ELSE name || '?' END AS ref FROM {playlists})),
        a AS (SELECT account_id, ref, 1 AS tier, playlist_id FROM refs JOIN {playlists} USING (account_id) WHERE playlist_id = ref UNION ALL
            SELECT account_id, ref, 2, playlist_id FROM refs JOIN {playlists} USING (account_id) WHERE name = ref UNION ALL
            SELECT account_id, ref, 3, playlist_id FROM refs JOIN {playlists} USING (account_id) WHERE lower(name) = lower(ref)),
        b AS (SELECT * FROM (SELECT account_id, ref, tier, count(*) AS n, min(playlist_id) AS playlist_id FROM a GROUP BY account_id, ref, tier) QUALIFY row_number() OVER (PARTITION BY account_id, ref ORDER BY tier) = 1)
        SELECT account_id, ref, CASE WHEN n IS NULL THEN 'not found' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN playlist_id END AS playlist_id FROM refs LEFT JOIN b USING (account_id, ref)""",
)
def c06(spark, sf_dir):
    lists = role(spark, sf_dir, "playlists")
    p, n = F.col("p") % 4, F.col("name")
    ref = F.when(p == 0, n).when(p == 1, F.col("playlist_id")).when(p == 2, F.upper(n)).otherwise(F.concat(n, F.lit("?")))
    return select.resolve_playlist_refs(lists.select("account_id", ref.alias("ref")), lists)


# Each customer's destination as it is in the end; the query spells it with dots, case, repeated separators and composition of its own.
_ROOTS = """SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 211 = 0 THEN '/' WHEN c_custkey % 17 = 0 THEN '//m/x' || (c_custkey % 40) || '/é' || CASE WHEN c_custkey % 3 = 0 THEN '/in' ELSE '' END WHEN c_custkey % 23 = 0 THEN '../m/' || (c_custkey % 40) || CASE WHEN c_custkey % 2 = 0 THEN '/x' ELSE '' END
    ELSE '//m/' || (c_custkey % 40) || CASE WHEN c_custkey % 3 = 0 THEN '/sub/' || (c_custkey % 7) WHEN c_custkey % 3 = 1 THEN '0' ELSE '' END END AS root FROM customer"""


def _spelled(spark, sf_dir):
    k = F.col("c_custkey")
    n = lambda m: (k % m).cast("string")
    tail = F.when(k % 3 == 0, F.concat(F.lit("/Sub//"), n(7))).when(k % 3 == 1, "0/./").otherwise("")
    top = F.when(k % 5 == 0, "/M/").when(k % 5 == 1, "/m/a/../").when(k % 5 == 2, "/../m/./b/c/../../").otherwise("//m/")
    accented = F.concat(F.lit("/m/X"), n(40), F.when(k % 2 == 0, "/\u00e9").otherwise("/E\u0301"), F.when(k % 3 == 0, "/in/").otherwise(""))
    relative = F.concat(F.when(k % 3 == 0, "../m/").otherwise("./q/../../M/"), n(40), F.when(k % 2 == 0, "/x").otherwise("/."))
    root = F.when(k % 211 == 0, "/./..").when(k % 17 == 0, accented).when(k % 23 == 0, relative).otherwise(F.concat(top, n(40), tail))
    return role(spark, sf_dir, "customer").select(k.cast("string").alias("account_id"), root.alias("root"))


@query(
    "c16_overlapping_roots",
    f"""WITH r AS ({_ROOTS}) SELECT least(a.k, b.k) AS account_a, greatest(a.k, b.k) AS account_b
        FROM r a JOIN r b ON a.k <> b.k AND (starts_with(a.root || '/', b.root || '/') OR b.root = '/' AND starts_with(a.root, '/')) GROUP BY ALL""",
)
def c16(spark, sf_dir):
    return select.overlapping_roots(_spelled(spark, sf_dir))


@query(
    "c16_root_conflicts",
    f"""WITH r AS ({_ROOTS}), p AS (SELECT a.k AS account_id, b.k AS other, a.root = b.root AS same, a.root <> b.root AND (starts_with(a.root || '/', b.root || '/') OR b.root = '/' AND starts_with(a.root, '/')) AS above,
            a.root <> b.root AND (starts_with(b.root || '/', a.root || '/') OR a.root = '/' AND starts_with(b.root, '/')) AS below FROM r a JOIN r b ON a.k <> b.k)
        SELECT account_id, count(*) FILTER (same) AS n_same, count(*) FILTER (above) AS n_above, count(*) FILTER (below) AS n_below, coalesce(min(other) FILTER (same), min(other) FILTER (above), min(other) FILTER (below)) AS example
        FROM p WHERE same OR above OR below GROUP BY account_id""",
)
def c16b(spark, sf_dir):
    return select.root_conflicts(_spelled(spark, sf_dir))


_LABELS = "SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) WHEN c_custkey % 3 = 1 THEN replace(lower(c_name), '#', '-') || '-x' ELSE 'acc' || CASE WHEN c_custkey % 7 < 3 THEN '-' ELSE '_' END || CAST(c_custkey % 250 AS STRING) END AS label FROM {customer}"


@query("c16_label_prefixes", f"WITH l AS ({_LABELS}), p AS (SELECT label, replace(upper(label), '-', '_') AS prefix FROM l) SELECT label, prefix, count(*) OVER (PARTITION BY prefix) AS n FROM p QUALIFY n > 1")
def c16c(spark, sf_dir):
    return select.label_prefixes(spark.sql(_LABELS, customer=role(spark, sf_dir, "customer")))


@query(
    "b26_blank_templates",
    """SELECT account_id, CASE WHEN k % 2 = 0 THEN 'own' WHEN k % 3 = 0 THEN ' ' ELSE 'base' END AS naming_template, CASE WHEN k % 3 = 0 THEN 'naming_template' ELSE '' END AS invalid FROM {accounts}""",
)
def b26b(spark, sf_dir):
    """A blank template is refused at any tier, also where another one decides."""
    a = role(spark, sf_dir, "accounts")
    layer = lambda tier, value, where: a.where(where).select("account_id", F.lit(tier).alias("tier"), F.lit("naming_template").alias("key"), F.lit(value).alias("value"))
    return select.layered_settings(layer(6, "base", "true").union(layer(1, "own", "k % 2 = 0")).union(layer(3, " ", "k % 3 = 0")), ["naming_template"])


_TS = CREATED_SQL


def select_sql(threshold: str, limit: int, floor: int) -> str:
    return f"""WITH d AS (SELECT * FROM (SELECT account_id, clip_id, ord % 900 AS ord, created_at FROM {{clips}} UNION ALL SELECT account_id, clip_id, ord % 900 + 5000, 'later' FROM {{clips}} WHERE ord % 3 = 0)
            QUALIFY row_number() OVER (PARTITION BY account_id, clip_id ORDER BY ord) = 1),
        t AS (SELECT *, {_TS} AS ts, {threshold} AS cut FROM d),
        k AS (SELECT *, cut IS NULL OR ts IS NULL OR ts > cut AS keep, row_number() OVER (PARTITION BY account_id ORDER BY coalesce(ts, 0) DESC, ord, clip_id) AS rk FROM t),
        f AS (SELECT *, count(*) FILTER (WHERE keep) OVER (PARTITION BY account_id) AS n FROM k),
        g AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY coalesce(ts, 0) DESC, ord, clip_id) AS rk2 FROM f WHERE keep OR (cut IS NOT NULL AND n < {floor} AND rk <= {floor}))
        SELECT account_id, clip_id FROM g WHERE rk2 <= CASE WHEN cut IS NULL THEN {limit} ELSE greatest({limit}, {floor}) END"""


def _ordered(spark, sf_dir):
    rows = role(spark, sf_dir, "clips").select("account_id", "clip_id", F.struct(F.col("ord") % 900, "clip_id").alias("ord"), "created_at", F.col("ord").alias("o"))
    later = rows.where("o % 3 = 0").withColumn("ord", F.struct((F.col("o") % 900 + 5000), "clip_id")).withColumn("created_at", F.lit("later"))
    return rows.unionByName(later)


@query("e01_select_recent", select_sql("883612800 - 30000000", 20, 5))
def e01(spark, sf_dir):
    return select.select_clips(_ordered(spark, sf_dir), limit=20, since=30_000_000, min_newest=5, now=883_612_800).select("account_id", "clip_id")


@query("e01_select_last_run", select_sql("CASE WHEN CAST(account_id AS INTEGER) % 3 <> 0 THEN 1600000000 + CAST(account_id AS BIGINT) END", 7, 9))
def e01b(spark, sf_dir):
    stamps = role(spark, sf_dir, "accounts").where("k % 3 <> 0").select("account_id", (F.col("k") + 1_600_000_000).cast("bigint").alias("last_run"))
    return select.select_clips(_ordered(spark, sf_dir), limit=7, since="last-run", min_newest=9, last_run=stamps).select("account_id", "clip_id")


@query(
    "e02_track_numbers",
    """WITH r AS (SELECT account_id, clip_id, created_at, ord, CASE WHEN cover_clip_id = '' THEN left(clip_id, 6) ELSE handle END AS root FROM {clips}),
        n AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY account_id, root) AS total FROM r WINDOW w AS (PARTITION BY account_id, root ORDER BY created_at, clip_id)),
        f AS (SELECT *, min(CASE WHEN ord % 5 = 0 THEN n END) OVER (PARTITION BY account_id, root) AS lead FROM n)
        SELECT account_id, clip_id, CAST(CASE WHEN n = lead THEN 1 WHEN n < lead THEN n + 1 ELSE n END AS INTEGER) AS track, CAST(total AS INTEGER) AS total FROM f WHERE total > 1""",
)
def e02(spark, sf_dir):
    rows = role(spark, sf_dir, "clips")
    root = F.when(F.col("cover_clip_id") == "", F.left("clip_id", F.lit(6))).otherwise(F.col("handle"))
    return select.assign_track_numbers(rows.select("account_id", "clip_id", "created_at", root.alias("root_id")), rows.where("ord % 5 = 0"))


@query("e05_dedupe_first", "SELECT account_id, clip_id, area_ord, pos FROM {area_clips} WHERE clip_id <> '' QUALIFY row_number() OVER (PARTITION BY account_id, clip_id ORDER BY area_ord DESC, pos) = 1")
def e05(spark, sf_dir):
    return select.dedupe_first(role(spark, sf_dir, "area_clips"), ["account_id", "clip_id"], [F.desc("area_ord"), "pos"]).select("account_id", "clip_id", "area_ord", "pos")


@query("f01_union_areas", "SELECT account_id, clip_id, area_ord, title FROM {area_clips} QUALIFY row_number() OVER (PARTITION BY account_id, clip_id ORDER BY area_ord, pos) = 1")
def f01(spark, sf_dir):
    return authority.union_areas(role(spark, sf_dir, "area_clips")).select("account_id", "clip_id", "area_ord", "title")


STATUS_SQL = """SELECT account_id, area_ord, kind, mode, coalesce(n, 0) AS n_clips, complete AND NOT any_filtered AND NOT narrowed AS authoritative,
    complete AND NOT any_filtered AND NOT narrowed AND NOT (coalesce(n, 0) = 0 AND mode = 'mirror') AS fully_enumerated
    FROM {areas} LEFT JOIN (SELECT account_id, area_ord, count(*) AS n FROM {area_clips} GROUP BY ALL) USING (account_id, area_ord)"""


def statuses(spark, sf_dir):
    rows = authority.area_status(role(spark, sf_dir, "areas"), role(spark, sf_dir, "area_clips"))
    return rows.select("account_id", "area_ord", "kind", "mode", "n_clips", "authoritative", "fully_enumerated")


@query("d02_area_status", STATUS_SQL)
def d02(spark, sf_dir):
    return statuses(spark, sf_dir)


GATE_SQL = f"SELECT a.account_id, coalesce(bool_and(fully_enumerated) AND bool_or(mode = 'mirror'), FALSE) AS can_delete FROM {{accounts}} a LEFT JOIN ({STATUS_SQL}) s ON s.account_id = a.account_id GROUP BY ALL"


@query("d01_deletion_allowed", GATE_SQL)
def d01(spark, sf_dir):
    return authority.deletion_allowed(role(spark, sf_dir, "accounts"), statuses(spark, sf_dir))


@query(
    "d03_run_authority",
    f"""SELECT account_id, can_delete, library_authoritative, playlists_enumerated, library_authoritative OR can_delete AS adoption_enumerated, NOT can_delete AND NOT library_authoritative AS may_narrow FROM (
        SELECT a.account_id, coalesce(bool_and(fully_enumerated) AND bool_or(mode = 'mirror'), FALSE) AS can_delete, coalesce(bool_or(kind = 'library' AND fully_enumerated), FALSE) AS library_authoritative,
        coalesce(bool_and(CASE WHEN kind <> 'library' THEN fully_enumerated END), TRUE) AS playlists_enumerated FROM {{accounts}} a LEFT JOIN ({STATUS_SQL}) s ON s.account_id = a.account_id GROUP BY ALL)""",
)
def d03(spark, sf_dir):
    return authority.run_authority(role(spark, sf_dir, "accounts"), statuses(spark, sf_dir))


@query(
    "d04_modes_by_clip",
    "SELECT account_id, clip_id, concat_ws(',', CASE WHEN bool_or(mode = 'mirror') THEN 'mirror' END, CASE WHEN bool_or(mode = 'copy') THEN 'copy' END) AS modes FROM {area_clips} JOIN {areas} USING (account_id, area_ord) GROUP BY ALL",
)
def d04(spark, sf_dir):
    return authority.modes_by_clip(role(spark, sf_dir, "areas"), role(spark, sf_dir, "area_clips")).withColumn("modes", F.array_join("modes", ","))


@query(
    "c08_adoption",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'pin_fresh' WHEN n IS NULL AND c_custkey % 4 <> 0 AND c_custkey % 9 = 0 THEN 'skip_pin' WHEN c_custkey % 9 = 0 THEN 'skip_pin'
        WHEN coalesce(n, 0) > 0 THEN 'pin_adopt' WHEN c_custkey % 2 = 0 THEN 'adopt_forced' ELSE 'abort' END AS decision
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 GROUP BY o_custkey) ON o_custkey = c_custkey
        WHERE c_custkey % 4 = 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)""",
)
def c08(spark, sf_dir):
    o = role(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("account_id"), F.col("o_orderkey").cast("string").alias("clip_id"), "o_orderkey", "o_custkey")
    a = role(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("account_id"), (F.col("c_custkey") % 9 != 0).alias("enumerated"), (F.col("c_custkey") % 2 == 0).alias("allow_change"), "c_custkey")
    owned = o.where("o_orderkey % 2 = 0 and o_custkey % 4 <> 0")
    rows = authority.adoption(a.join(owned.select("account_id").distinct().union(a.where("c_custkey % 4 = 0").select("account_id")).distinct(), "account_id", "left_semi"), o.where("o_orderkey % 3 = 0"), owned)
    return rows.select(F.col("account_id").cast("bigint").alias("c_custkey"), "decision")


@query("c12_area_overrides", "SELECT account_id, playlist_id, CASE WHEN p % 3 = 0 THEN 'copy' ELSE 'mirror' END AS mode FROM {playlists}")
def c12(spark, sf_dir):
    lists = role(spark, sf_dir, "playlists")
    return authority.area_overrides(lists, lists.where("p % 3 = 0").withColumn("mode", F.lit("copy"))).select("account_id", "playlist_id", "mode")


@query(
    "b24_update_pins",
    """SELECT CAST(c_custkey AS VARCHAR) AS account_id, CASE WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_name WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN c_name ELSE 'someone' END AS user_id,
        CASE WHEN c_custkey % 3 = 2 AND c_custkey % 5 <> 0 THEN 'old' WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 1 OR c_custkey % 2 = 0 THEN lower(c_name) ELSE 'old' END AS display_name FROM customer
        WHERE NOT (c_custkey % 5 = 0 AND c_custkey % 3 = 2)""",
)
def b24b(spark, sf_dir):
    k = F.col("c_custkey")
    rows = role(spark, sf_dir, "customer")
    runs = rows.where(k % 3 != 2).select(k.cast("string").alias("account_id"), F.col("c_name").alias("authed_id"), F.lit(None).cast("string").alias("configured_id"), (k % 2 == 0).alias("allow_change"), F.lower("c_name").alias("display_name"))
    pins = rows.where(k % 5 != 0).select(k.cast("string").alias("account_id"), F.when(k % 3 == 1, F.col("c_name")).otherwise("someone").alias("user_id"), F.lit("old").alias("display_name"))
    return authority.update_pins(pins, runs)


@query(
    "h19_resolve_areas",
    """WITH asked AS (SELECT account_id, kind, area_id, CASE WHEN area_ord = 3 THEN NULL ELSE mode END AS mode FROM {areas} WHERE k % 5 = 0 AND area_ord IN (1, 3)),
        conf AS (SELECT account_id, kind, area_id, CASE WHEN area_ord = 0 AND k % 3 = 0 THEN 'off' WHEN area_ord = 2 THEN 'off' ELSE mode END AS mode FROM {areas} WHERE k % 2 = 0 AND (area_ord <> 0 OR k % 4 <> 0)),
        r AS (SELECT account_id, kind, area_id, coalesce(mode, 'copy') AS mode, FALSE AS unfiltered FROM asked
            UNION ALL SELECT account_id, kind, area_id, mode, kind = 'library' FROM conf WHERE account_id NOT IN (SELECT account_id FROM asked)
            UNION ALL SELECT account_id, 'library', '', CASE WHEN k % 3 = 0 THEN 'mirror' ELSE 'copy' END, FALSE FROM {accounts} WHERE account_id NOT IN (SELECT account_id FROM asked UNION SELECT account_id FROM conf))
        SELECT *, FALSE AS protector FROM r WHERE mode <> 'off'
        UNION ALL SELECT account_id, 'library', '', 'copy', TRUE, TRUE FROM r GROUP BY account_id HAVING bool_or(mode = 'mirror') AND NOT bool_or(kind = 'library')""",
)
def h19(spark, sf_dir):
    a, n = role(spark, sf_dir, "areas"), F.col("area_ord")
    asked = a.where("k % 5 = 0 and area_ord in (1, 3)").withColumn("mode", F.when(n != 3, F.col("mode")))
    conf = a.where("k % 2 = 0 and (area_ord <> 0 or k % 4 <> 0)").withColumn("mode", F.when((n == 2) | ((n == 0) & (F.col("k") % 3 == 0)), "off").otherwise(F.col("mode")))
    accounts = role(spark, sf_dir, "accounts").withColumn("verb_mode", F.when(F.col("k") % 3 == 0, "mirror").otherwise("copy"))
    return authority.resolve_areas(accounts, asked, conf)
