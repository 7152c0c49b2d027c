"""Queries of the lineage operators, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clips as fn
from ..functions import naming
from ..operators import lineage, select
from ..tables import written
from .library import PATH_SQL, TITLE_SQL, clean_sql, suffix_sql
from .roles import role, with_roles
from .scalars import EDGE_SQL, PARENTS_SQL, clips, norm

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_roles(sql)
        return f

    return add


EDGES_SQL = f"""SELECT account_id, clip_id AS child_id, parent_id, edge AS edge_type, 'primary' AS role, 0 AS ordinal, source_field FROM ({PARENTS_SQL}) WHERE parent_id IS NOT NULL
    UNION ALL SELECT account_id, clip_id, {norm('concat_id2')}, 'stitch', 'secondary', 1, 'concat_history' FROM {{clips}} WHERE {EDGE_SQL} = 'stitch' AND concat_id <> '' AND concat_id2 <> ''
    UNION ALL SELECT c.account_id, c.clip_id, {norm('override_future_clip_id')}, 'section_replace', 'secondary', 1, 'override_future_clip_id' FROM {{clips}} c JOIN ({PARENTS_SQL}) p ON p.clip_id = c.clip_id AND p.account_id = c.account_id
        WHERE p.edge = 'section_replace' AND {norm('override_future_clip_id')} IS NOT NULL AND p.parent_id IS DISTINCT FROM {norm('override_future_clip_id')}"""
_SLUG = r"CASE WHEN trim(clip_attribution_type) = '' THEN 'attribution' ELSE lower(regexp_replace(trim(clip_attribution_type), '\s+', '_', 'g')) END"
ATTRIBUTION_SQL = f"""SELECT account_id, child_id, parent_id, edge_type, 'secondary' AS role, CAST(row_number() OVER (PARTITION BY account_id, child_id ORDER BY n) - 1 AS INTEGER) AS ordinal, 'clip_roots' AS source_field, same_owner FROM (
    SELECT account_id, clip_id AS child_id, attributed_id AS parent_id, {_SLUG} AS edge_type, trim(handle) <> '' AND trim(handle) = trim(attributed_handle) AS same_owner, 0 AS n FROM {{clips}} WHERE attributed_id <> ''
    UNION ALL SELECT account_id, clip_id, {norm('concat_id')}, {_SLUG}, trim(handle) <> '', 1 FROM {{clips}} WHERE concat_id <> '')"""


@query("g01_lineage_edges", EDGES_SQL)
def g01(spark, sf_dir):
    return lineage.lineage_edges(clips(spark, sf_dir))


@query("g02_attribution_edges", ATTRIBUTION_SQL)
def g02(spark, sf_dir):
    return lineage.attribution_edges(clips(spark, sf_dir))


_BRIDGES_SQL = "SELECT account_id, 'gone-' || ord AS child_id, clip_id AS parent_id FROM {clips} WHERE ord % 90 = 0"
ALL_SQL = f"""SELECT account_id, child_id, parent_id, edge_type, role, ordinal, max(source_field) AS source_field FROM ({EDGES_SQL} UNION ALL SELECT account_id, child_id, parent_id, edge_type, role, ordinal, source_field FROM ({ATTRIBUTION_SQL})
    UNION ALL SELECT account_id, child_id, parent_id, 'derived', 'primary', 0, 'parent_endpoint' FROM ({_BRIDGES_SQL})) GROUP BY account_id, child_id, parent_id, edge_type, role, ordinal"""


def bridges(rows):
    return rows.where("ord % 90 = 0").select("account_id", F.concat(F.lit("gone-"), F.col("ord").cast("string")).alias("child_id"), F.col("clip_id").alias("parent_id"))


@query("f04_all_edges", ALL_SQL)
def f04(spark, sf_dir):
    rows = clips(spark, sf_dir)
    return lineage.all_edges(rows, bridges(rows))


@query("e08_order_edges", f"SELECT * FROM ({ALL_SQL}) ORDER BY account_id, child_id, ordinal, parent_id, edge_type, role")
def e08(spark, sf_dir):
    return lineage.order_edges(f04(spark, sf_dir))


LOOKUP_SQL = f"""SELECT account_id, clip_id, parent_id FROM ({PARENTS_SQL}) WHERE clip_id IN (SELECT clip_id FROM {{clips}} WHERE ord % 4 <> 0)
    UNION ALL SELECT account_id, clip_id, clip_id || '-old' FROM {{clips}} WHERE ord % 4 = 0 AND ord % 8 = 0
    UNION ALL SELECT account_id, 'gone-' || ord, clip_id FROM {{clips}} WHERE ord % 90 = 0"""


def lookup(spark, sf_dir):
    rows = clips(spark, sf_dir)
    archive = rows.where("ord % 8 = 0 or ord % 3 = 0 and ord % 4 <> 0").select("account_id", F.col("clip_id").alias("child_id"), F.concat("clip_id", F.lit("-old")).alias("parent_id"))
    return lineage.parent_lookup(rows.where("ord % 4 <> 0"), archive, bridges(rows).union(archive.withColumn("parent_id", F.lit("never"))))


@query("c02_parent_lookup", LOOKUP_SQL)
def c02(spark, sf_dir):
    return lookup(spark, sf_dir)


MISSING_SQL = f"""SELECT DISTINCT account_id, parent_id AS clip_id FROM ({LOOKUP_SQL}) l WHERE parent_id IS NOT NULL
    AND (account_id, parent_id) NOT IN (SELECT (account_id, clip_id) FROM ({LOOKUP_SQL}) UNION ALL SELECT (account_id, clip_id) FROM {{clips}} WHERE ord % 5 = 0)"""


@query("c03_missing_ancestors", MISSING_SQL)
def c03(spark, sf_dir):
    return lineage.missing_ancestors(lookup(spark, sf_dir), role(spark, sf_dir, "clips").where("ord % 5 = 0"))


@query(
    "g04_ancestor_requests",
    f"""WITH want AS (SELECT account_id, clip_id, min(tier) AS tier FROM (SELECT account_id, clip_id, 0 AS tier FROM ({MISSING_SQL}) UNION ALL SELECT account_id, parent_id, 1 FROM ({ATTRIBUTION_SQL}) WHERE same_owner
        AND (account_id, parent_id) NOT IN (SELECT (account_id, clip_id) FROM ({LOOKUP_SQL}) UNION ALL SELECT (account_id, clip_id) FROM {{clips}} WHERE ord % 5 = 0)) GROUP BY account_id, clip_id)
        SELECT account_id, clip_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY tier, clip_id) AS INTEGER) AS place FROM want QUALIFY place <= 150""",
)
def g04(spark, sf_dir):
    rows = clips(spark, sf_dir)
    return lineage.ancestor_requests(lookup(spark, sf_dir), rows.where("ord % 5 = 0"), lineage.attribution_edges(rows), budget=150)


#: Roots by the previous order of the same customer, which the edited pointer holds.
ROOTS_SQL = """SELECT account_id, clip_id, CASE WHEN cust % 11 = 0 THEN 'gone-' || cust WHEN cust % 7 = 0 AND n > 1 THEN least ELSE first END AS root_id,
    CASE WHEN cust % 11 = 0 THEN 'external' WHEN cust % 7 = 0 AND n > 1 THEN 'cycle' ELSE 'resolved' END AS status FROM (
        SELECT c.account_id, c.clip_id, o_custkey AS cust, count(*) OVER w AS n, min(c.clip_id) OVER w AS least, first_value(c.clip_id) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first
        FROM {clips} c JOIN {orders} ON o_orderkey = ord WINDOW w AS (PARTITION BY o_custkey))"""


def roots(spark, sf_dir, rows=None):
    rows = role(spark, sf_dir, "clips") if rows is None else rows
    return lineage.resolve_roots(rows.select("account_id", "clip_id", fn.normalise_id("edited_clip_id").alias("parent_id")))


@query("g03_resolve_roots", ROOTS_SQL)
def g03(spark, sf_dir):
    return roots(spark, sf_dir)


@query(
    "g03_deep_chain",
    """SELECT 'all' AS account_id, CAST(event_id AS VARCHAR) AS clip_id, CAST(first_value(event_id) OVER (PARTITION BY user_id // 4 ORDER BY ts, event_id) AS VARCHAR) AS root_id, 'resolved' AS status FROM events""",
)
def g03_deep(spark, sf_dir):
    text = "SELECT 'all' AS account_id, CAST(event_id AS STRING) AS clip_id, CAST(lag(event_id) OVER (PARTITION BY user_id DIV 4 ORDER BY ts, event_id) AS STRING) AS parent_id FROM {e}"
    return lineage.resolve_roots(spark.sql(text, e=role(spark, sf_dir, "events")))


def nodes(rows):
    return rows.where("ord % 6 <> 0").select(
        "account_id", "clip_id", F.concat(F.lit("old "), "title").alias("title"), "created_at", "clip_type", "task", F.lit(False).alias("is_trashed"), F.lit("t0").alias("first_seen_at"), F.lit("t0").alias("last_seen_at")
    )


@query(
    "g05_update_nodes",
    """SELECT account_id, clip_id, CASE WHEN ord % 4 = 1 THEN 'old ' || title ELSE title END AS title, CASE WHEN ord % 4 = 1 THEN FALSE ELSE is_trashed END AS is_trashed, CASE WHEN ord % 6 <> 0 THEN 't0' ELSE 't1' END AS first_seen_at,
        CASE WHEN ord % 4 = 1 THEN 't0' ELSE 't1' END AS last_seen_at FROM {clips} WHERE ord % 4 <> 1 OR ord % 6 <> 0""",
)
def g05(spark, sf_dir):
    rows = role(spark, sf_dir, "clips")
    return lineage.update_nodes(nodes(rows), rows.where("ord % 4 <> 1"), "t1").select("account_id", "clip_id", "title", "is_trashed", "first_seen_at", "last_seen_at")


@query(
    "g06_update_edges",
    f"""SELECT account_id, child_id, parent_id, edge_type, role, ordinal, CASE WHEN new THEN source_field ELSE 'before' END AS source_field, CASE WHEN new THEN 'active' ELSE 'lost' END AS status, CASE WHEN old THEN 't0' ELSE 't1' END AS first_seen_at,
        CASE WHEN new THEN 't1' ELSE 't0' END AS last_seen_at FROM (SELECT *, length(child_id) % 2 = 0 OR left(child_id, 1) = 'c' AND CAST(substr(child_id, 2, 7) AS BIGINT) % 3 <> 0 AS new, left(child_id, 1) = 'c' AND CAST(substr(child_id, 2, 7) AS BIGINT) % 2 = 0 AS old FROM ({EDGES_SQL})) WHERE new OR old""",
)
def g06(spark, sf_dir):
    edges = lineage.lineage_edges(clips(spark, sf_dir))
    c, number = F.left("child_id", F.lit(1)) == "c", F.substring("child_id", 2, 7).cast("bigint")
    new = edges.where((F.length("child_id") % 2 == 0) | (c & (number % 3 != 0)))
    old = edges.where(c & (number % 2 == 0)).withColumns({"source_field": F.lit("before"), "status": F.lit("lost"), "first_seen_at": F.lit("t0"), "last_seen_at": F.lit("t0")})
    return lineage.update_edges(old, new, "t1")


@query(
    "g07_update_roots",
    """SELECT account_id, clip_id, CASE WHEN keep THEN 'was' ELSE 'is' END AS root_id, CASE WHEN keep THEN o ELSE n END AS status, CASE WHEN keep THEN 't0' ELSE 't1' END AS computed_at FROM (
        SELECT *, n IS NULL OR (o = 'resolved' AND n <> 'resolved') IS TRUE AS keep FROM (SELECT account_id, clip_id, CASE ord % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'external' END AS o, CASE ord % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'cycle' WHEN 2 THEN 'external' END AS n FROM {clips}) WHERE o IS NOT NULL OR n IS NOT NULL)""",
)
def g07(spark, sf_dir):
    rows, o = role(spark, sf_dir, "clips"), F.col("ord")
    old = rows.where(o % 3 != 2).select("account_id", "clip_id", F.lit("was").alias("root_id"), F.when(o % 3 == 0, "resolved").otherwise("external").alias("status"), F.lit("t0").alias("computed_at"))
    new = rows.where(o % 4 != 3).select("account_id", "clip_id", F.lit("is").alias("root_id"), F.when(o % 4 == 0, "resolved").when(o % 4 == 1, "cycle").otherwise("external").alias("status"))
    return lineage.update_roots(old, new, "t1")


@query("g08_archived_parents", f"SELECT account_id, child_id, max(parent_id) AS parent_id FROM ({ALL_SQL}) WHERE role = 'primary' AND ordinal = 0 GROUP BY account_id, child_id")
def g08(spark, sf_dir):
    return lineage.archived_parents(f04(spark, sf_dir).withColumn("status", F.lit("active")))


EFFECTIVE_SQL = f"""SELECT i.account_id, i.root_id, CASE WHEN i.root_id LIKE '%7-a' THEN 'Pinned' WHEN c.clip_id IS NULL THEN '' ELSE 'old ' || title END AS title
    FROM (SELECT DISTINCT account_id, root_id FROM ({ROOTS_SQL})) i LEFT JOIN (SELECT * FROM {{clips}} WHERE ord % 6 <> 0) c ON c.account_id = i.account_id AND c.clip_id = i.root_id"""


def overrides(found):
    pinned = found.where("root_id like '%7-a'").select("account_id", "root_id", F.lit("Pinned").alias("name"))
    return pinned.union(found.where("root_id like '%3-a'").select("account_id", "root_id", F.lit(" ").alias("name"))).distinct()


@query("d06_effective_titles", EFFECTIVE_SQL)
def d06(spark, sf_dir):
    found = roots(spark, sf_dir)
    return lineage.effective_titles(found, nodes(role(spark, sf_dir, "clips")), overrides(found))


COLLIDING_SQL = f"SELECT account_id, trim(title) AS title FROM ({EFFECTIVE_SQL}) WHERE trim(title) <> '' GROUP BY account_id, trim(title) HAVING count(*) > 1"


@query("d06_colliding_root_titles", COLLIDING_SQL)
def d06b(spark, sf_dir):
    found = roots(spark, sf_dir)
    return lineage.colliding_root_titles(found, nodes(role(spark, sf_dir, "clips")), overrides(found))


@query("d07_colliding_clip_ids", "SELECT account_id, clip_id FROM {clips} QUALIFY count(*) OVER (PARTITION BY account_id, lower(left(clip_id, 8))) > 1")
def d07(spark, sf_dir):
    return naming.colliding_clip_ids(role(spark, sf_dir, "clips"))


CONTEXTS_SQL = f"""SELECT c.account_id, c.clip_id, r.root_id, CASE WHEN r.root_id LIKE '%7-a' THEN 'Pinned' WHEN n.clip_id IS NOT NULL THEN 'old ' || n.title ELSE c.title END AS root_title, coalesce(n.created_at, c.created_at) AS root_date,
    coalesce(p.parent_id, '') AS parent_id, CASE WHEN p.parent_id IS NOT NULL THEN p.edge END AS edge_type, r.status AS lineage_status
    FROM {{clips}} c JOIN ({ROOTS_SQL}) r USING (account_id, clip_id) JOIN ({PARENTS_SQL}) p USING (account_id, clip_id) LEFT JOIN (SELECT * FROM {{clips}} WHERE ord % 6 <> 0) n ON n.account_id = c.account_id AND n.clip_id = r.root_id"""


def contexts(spark, sf_dir):
    rows, found = clips(spark, sf_dir), roots(spark, sf_dir)
    return lineage.lineage_context(rows, found, nodes(rows), overrides(found))


@query("g09_lineage_context", CONTEXTS_SQL)
def g09(spark, sf_dir):
    return contexts(spark, sf_dir).select("account_id", "clip_id", "root_id", "root_title", "root_date", "parent_id", "edge_type", "lineage_status")


_RAW = f"CASE WHEN trim(root_title) <> '' AND root_title <> {TITLE_SQL} THEN root_title ELSE {TITLE_SQL} END"
_FILE = "regexp_extract(path, '[^/]*$')"
_LONGER = f"concat_ws('/', nullif(regexp_extract(path, '(?s)^(.*)/[^/]*$', 1), ''), {suffix_sql(_FILE, 'clip_id')})"
NAMES_SQL = f"""WITH ctx AS MATERIALIZED ({CONTEXTS_SQL}), col AS MATERIALIZED ({COLLIDING_SQL}),
    n AS (SELECT x.account_id, x.clip_id, c.ord % 5 = 0 AS lead, row_number() OVER (PARTITION BY x.account_id, root_id ORDER BY c.created_at, x.clip_id) AS n, count(*) OVER (PARTITION BY x.account_id, root_id) AS total, root_id FROM ctx x JOIN {{clips}} c USING (account_id, clip_id)),
    tr AS (SELECT account_id, clip_id, CASE WHEN total = 1 THEN 0 WHEN n = first THEN 1 WHEN n < first THEN n + 1 ELSE n END AS trk FROM (SELECT *, min(CASE WHEN lead THEN n END) OVER (PARTITION BY account_id, root_id) AS first FROM n)),
    raw AS MATERIALIZED (SELECT c.account_id, c.clip_id, display_name, handle, title, root_id, coalesce(trk, 0) AS trk, {_RAW} AS raw FROM {{clips}} c JOIN ctx USING (account_id, clip_id) LEFT JOIN tr USING (account_id, clip_id)),
    named AS MATERIALIZED (SELECT r.*, CASE WHEN col.title IS NOT NULL THEN {suffix_sql(clean_sql('raw'), 'left(root_id, 8)')} ELSE {clean_sql('raw')} END AS al FROM raw r LEFT JOIN col ON col.account_id = r.account_id AND col.title = trim(raw)),
    shared AS (SELECT account_id, clip_id FROM {{clips}} QUALIFY count(*) OVER (PARTITION BY account_id, lower(left(clip_id, 8))) > 1),
    one AS MATERIALIZED ({PATH_SQL}), two AS MATERIALIZED (SELECT account_id, clip_id, CASE WHEN (account_id, clip_id) IN (SELECT (account_id, clip_id) FROM shared) THEN {_LONGER} ELSE path END AS path FROM one),
    three AS MATERIALIZED (SELECT account_id, clip_id, CASE WHEN count(*) OVER (PARTITION BY account_id, path) > 1 THEN {_LONGER} ELSE path END AS path FROM two)
    SELECT account_id, clip_id, CASE WHEN count(*) OVER (PARTITION BY account_id, lower(nfc_normalize(path))) > 1 THEN {_LONGER} ELSE path END AS path FROM three"""


#: What names and lineage read of a clip.
NAMED = ("title", "created_at", "display_name", "handle", *fn.POINTING)


@query("e03_render_names", NAMES_SQL)
def e03(spark, sf_dir):
    rows = written(clips(spark, sf_dir).select("account_id", "clip_id", "ord", *NAMED), "role")
    found = roots(spark, sf_dir, rows)
    past = nodes(rows)
    context = lineage.lineage_context(rows, found, past, overrides(found))
    tracks = select.assign_track_numbers(context.select("account_id", "clip_id", "root_id", "created_at"), rows.where("ord % 5 = 0")).withColumnRenamed("total", "track_total")
    context = context.join(tracks, ["account_id", "clip_id"], "left")
    return naming.render_names(context, lineage.colliding_root_titles(found, past, overrides(found)), naming.colliding_clip_ids(rows))
