"""Edges between clips, their roots, and the archive that remembers both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clips import edge_type, normalise_id, normalise_slug, present, primary_parent, same_owner, strip
from ..tables import discard, written

EDGE_KEY = ["account_id", "child_id", "parent_id", "edge_type", "role", "ordinal"]


def parents(clips: DataFrame) -> DataFrame:
    """(account_id, clip_id, parent_id, edge, source_field) of every clip, null where it has no parent."""
    return clips.select("account_id", "clip_id", primary_parent().alias("p")).select("account_id", "clip_id", "p.parent_id", "p.edge", "p.source_field")


def lineage_edges(clips: DataFrame) -> DataFrame:
    """Structural edges: the primary one, further segments of a stitch, the later half of a replaced section."""
    rows = clips.select("account_id", F.col("clip_id").alias("child_id"), edge_type().alias("edge_type"), primary_parent().alias("p"), "concat_history", "override_future_clip_id").where("edge_type is not null")
    edge = lambda parent, role, ordinal, field: [
        "account_id", "child_id", parent.alias("parent_id"), "edge_type", F.lit(role).alias("role"), ordinal.cast("int").alias("ordinal"), field.alias("source_field")
    ]
    primary = rows.where("p is not null").select(*edge(F.col("p.parent_id"), "primary", F.lit(0), F.col("p.source_field")))
    parts = rows.where("edge_type = 'stitch'").select("account_id", "child_id", "edge_type", F.posexplode("concat_history").alias("n", "e")).where("n > 0")
    parts = parts.select(*edge(normalise_id("e.id"), "secondary", F.col("n"), F.lit("concat_history"))).where("parent_id is not null")
    later = rows.where("edge_type = 'section_replace'").withColumn("f", normalise_id("override_future_clip_id"))
    later = later.where("f is not null and (p is null or p.parent_id <> f)").select(*edge(F.col("f"), "secondary", F.lit(1), F.lit("override_future_clip_id")))
    return primary.unionByName(parts).unionByName(later)


def attribution_edges(clips: DataFrame) -> DataFrame:
    """One secondary edge per usable attributed root, numbered among those, with same_owner."""
    usable = F.filter("clip_roots", lambda r: normalise_id(r["id"]).isNotNull())
    rows = clips.select("account_id", F.col("clip_id").alias("child_id"), "handle", "clip_attribution_type", F.posexplode(usable).alias("ordinal", "r"))
    return rows.select(
        "account_id", "child_id", normalise_id("r.id").alias("parent_id"), normalise_slug("clip_attribution_type").alias("edge_type"), F.lit("secondary").alias("role"),
        F.col("ordinal").cast("int").alias("ordinal"), F.lit("clip_roots").alias("source_field"), same_owner("handle", "r.handle").alias("same_owner"),
    )


def all_edges(clips: DataFrame, bridges: DataFrame | None = None) -> DataFrame:
    """Structural, attribution and bridge (account_id, child_id, parent_id) edges, each key once."""
    rows = lineage_edges(clips).unionByName(attribution_edges(clips).drop("same_owner"))
    if bridges is not None:
        rows = rows.unionByName(
            bridges.select("account_id", "child_id", "parent_id", F.lit("derived").alias("edge_type"), F.lit("primary").alias("role"), F.lit(0).alias("ordinal"), F.lit("parent_endpoint").alias("source_field"))
        )
    return rows.groupBy(*EDGE_KEY).agg(F.max("source_field").alias("source_field"))


def order_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("account_id", "child_id", "ordinal", "parent_id", "edge_type", "role")


def parent_lookup(clips: DataFrame, archive: DataFrame, bridges: DataFrame) -> DataFrame:
    """(account_id, clip_id, parent_id): the live clip decides, also that there is none; else the archived
    parent (account_id, child_id, parent_id), else the bridge."""
    live = parents(clips).select("account_id", "clip_id", "parent_id", F.lit(0).alias("rank"))
    old = lambda df, n: df.select("account_id", F.col("child_id").alias("clip_id"), "parent_id", F.lit(n).alias("rank"))
    rows = live.unionByName(old(archive, 1)).unionByName(old(bridges, 2))
    return rows.groupBy("account_id", "clip_id").agg(F.min_by(F.struct("parent_id"), F.struct("rank", F.coalesce("parent_id", F.lit("")))).alias("p")).select("account_id", "clip_id", "p.parent_id")


def missing_ancestors(lookup: DataFrame, nodes: DataFrame) -> DataFrame:
    """(account_id, clip_id): parents that no table knows."""
    known = lookup.select("account_id", "clip_id").union(nodes.select("account_id", "clip_id"))
    wanted = lookup.where("parent_id is not null").select("account_id", F.col("parent_id").alias("clip_id")).distinct()
    return wanted.join(known, ["account_id", "clip_id"], "left_anti")


def ancestor_requests(lookup: DataFrame, nodes: DataFrame, attribution: DataFrame, budget: int = 200) -> DataFrame:
    """(account_id, clip_id, place): what to ask for, missing parents first, then roots attributed to the same
    owner, by id, at most `budget` per account."""
    blocked = missing_ancestors(lookup, nodes).withColumn("tier", F.lit(0))
    known = lookup.select("account_id", "clip_id").union(nodes.select("account_id", "clip_id"))
    seeds = attribution.where("same_owner").select("account_id", F.col("parent_id").alias("clip_id")).distinct()
    seeds = seeds.join(known, ["account_id", "clip_id"], "left_anti").withColumn("tier", F.lit(1))
    rows = blocked.unionByName(seeds).groupBy("account_id", "clip_id").agg(F.min("tier").alias("tier"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("account_id").orderBy("tier", "clip_id")))
    return rows.where(F.col("place") <= budget).select("account_id", "clip_id", "place")


def resolve_roots(lookup: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """(account_id, clip_id, parent_id) -> (account_id, clip_id, root_id, status), for chains of any depth.

    resolved: the ancestor without a parent; external: the first ancestor that is no row; cycle: the
    smallest id of the cycle that the chain runs into. settled: (account_id, clip_id, root_id, status) of clips that are
    no rows here and whose roots stand; chains that reach one take its root.

    Pointer doubling on the open rows alone: in each round rows whose target was finished in the round before finish, then
    the others meet each other and jump as far as their target does. After that no open row points at one that
    finished earlier than this round, so finished rows are never read again. A chain of n takes log2(n) rounds.
    """
    known = lookup.select("account_id", F.col("clip_id").alias("parent_id"), F.lit("open").alias("k_status"), F.lit(None).cast("string").alias("k_root"))
    if settled is not None:
        asked = lookup.select("account_id", "parent_id").distinct()
        known = known.unionByName(settled.select("account_id", F.col("clip_id").alias("parent_id"), F.col("status").alias("k_status"), F.col("root_id").alias("k_root")).join(asked, ["account_id", "parent_id"], "left_semi"))
    stands, inner = F.col("k_root").isNotNull(), F.coalesce(F.col("k_status") == "open", F.lit(False))
    rows = lookup.join(known, ["account_id", "parent_id"], "left").select(
        "account_id",
        "clip_id",
        F.when(inner, F.col("parent_id")).alias("jump"),
        F.when(F.col("parent_id").isNull(), F.col("clip_id")).when(stands, F.col("k_root")).when(~inner, F.col("parent_id")).alias("root_id"),
        F.when(F.col("parent_id").isNull(), "resolved").when(stands, F.col("k_status")).when(~inner, "external").alias("status"),
        F.when(inner, F.col("parent_id")).alias("least"),
    )
    rows = written(rows, "roots")
    ends = lambda df: df.select("account_id", F.col("clip_id").alias("jump"), F.col("root_id").alias("t_root"), F.col("status").alias("t_status"))
    took = [F.coalesce("root_id", "t_root").alias("root_id"), F.coalesce("status", "t_status").alias("status")]
    left, last, made, done = rows.where("root_id is null"), rows.where("root_id is not null"), [rows], [rows.where("root_id is not null")]
    many, targets = rows.where("root_id is null").count(), None
    while many:
        first = written(left.join(ends(last), ["account_id", "jump"], "left").select("account_id", "clip_id", "jump", *took, "least"), "roots")
        rest = first.where("root_id is null")
        onward = rest.select("account_id", F.col("clip_id").alias("jump"), F.col("jump").alias("t_jump"), F.col("least").alias("t_least"), F.lit(None).cast("string").alias("t_root"), F.lit(None).cast("string").alias("t_status"))
        onward = onward.unionByName(ends(first.where("root_id is not null")), allowMissingColumns=True)
        second = rest.join(onward, ["account_id", "jump"]).select("account_id", "clip_id", F.col("t_jump").alias("jump"), *took, F.least("least", "t_least").alias("least"), (F.col("t_least") < F.col("least")).alias("moved"))
        second = written(second, "roots")
        last = first.where("root_id is not null").unionByName(second.where("root_id is not null").drop("moved"))
        left = second.where("root_id is null")
        done.append(last)
        made += [first, second]
        before = many
        many, *now = left.agg(F.count("*"), F.count_distinct("account_id", "jump"), F.count_if("moved")).first()
        if many == before:
            # None finished, so all that is left runs into cycles. Once jumps have no fewer targets than in the round before,
            # all of them lie on cycles; once no least id changes, each has seen all that it can reach.
            if now == [targets, 0]:
                break
            targets = now[0]
    # what still jumps runs in a cycle, and the row that it points at has seen all of it
    seen = left.select("account_id", F.col("clip_id").alias("jump"), F.col("least").alias("t_least"))
    cycles = left.join(seen, ["account_id", "jump"]).select("account_id", "clip_id", F.col("t_least").alias("root_id"), F.lit("cycle").alias("status"))
    found = written(reduce(DataFrame.unionByName, [d.select("account_id", "clip_id", "root_id", "status") for d in done], cycles), "roots")
    discard(*made)
    return found


# --- the archive: snapshots, each made by a full outer join with the one before -------------------


def update_nodes(previous: DataFrame, clips: DataFrame, now: str) -> DataFrame:
    """Nodes (account_id, clip_id, title, created_at, clip_type, task, is_trashed, first_seen_at, last_seen_at);
    clips that are listed are refreshed, none is dropped."""
    fields = ["title", "created_at", "clip_type", "task", "is_trashed"]
    new = clips.select("account_id", "clip_id", *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_new"))
    rows = previous.join(new, ["account_id", "clip_id"], "full_outer")
    take = lambda f: F.when(F.col("_new"), F.col(f"_{f}")).otherwise(F.col(f)).alias(f)
    return rows.select(
        "account_id", "clip_id", *map(take, fields), F.coalesce("first_seen_at", F.lit(now)).alias("first_seen_at"), F.when(F.col("_new"), F.lit(now)).otherwise(F.col("last_seen_at")).alias("last_seen_at")
    )


def update_edges(previous: DataFrame, edges: DataFrame, now: str) -> DataFrame:
    """Edges by their five-part key: seen ones become active and refreshed, others stay as they were."""
    new = edges.select(*EDGE_KEY, F.col("source_field").alias("_field"), F.lit(True).alias("_new"))
    rows = previous.join(new, EDGE_KEY, "full_outer")
    take = lambda a, b: F.when(F.col("_new"), a).otherwise(F.col(b)).alias(b)
    return rows.select(
        *EDGE_KEY, take(F.col("_field"), "source_field"), take(F.lit("active"), "status"), F.coalesce("first_seen_at", F.lit(now)).alias("first_seen_at"), take(F.lit(now), "last_seen_at")
    )


def update_roots(previous: DataFrame, roots: DataFrame, now: str) -> DataFrame:
    """(account_id, clip_id, root_id, status, computed_at): a resolved root is only replaced by a resolved one."""
    new = roots.select("account_id", "clip_id", F.struct("root_id", "status", F.lit(now).alias("computed_at")).alias("n"))
    old = previous.select("account_id", "clip_id", F.struct("root_id", "status", "computed_at").alias("o"))
    rows = old.join(new, ["account_id", "clip_id"], "full_outer")
    keep = F.col("n").isNull() | ((F.col("o.status") == "resolved") & (F.col("n.status") != "resolved"))
    return rows.select("account_id", "clip_id", F.when(F.coalesce(keep, F.lit(False)), F.col("o")).otherwise(F.col("n")).alias("r")).select("account_id", "clip_id", "r.*")


def archived_parents(edges: DataFrame) -> DataFrame:
    """(account_id, child_id, parent_id) of active primary edges; of several the greatest parent."""
    return edges.where("role = 'primary' and ordinal = 0 and status = 'active'").groupBy("account_id", "child_id").agg(F.max("parent_id").alias("parent_id"))


def _effective(roots: DataFrame, nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """(account_id, root_id, title, root_date) of distinct roots; title is the override's where it is not blank."""
    ids = roots.where("root_id <> ''").select("account_id", "root_id").distinct()
    known = nodes.select("account_id", F.col("clip_id").alias("root_id"), F.col("title").alias("_title"), F.col("created_at").alias("root_date"))
    names = overrides.where(strip("name") != "").select("account_id", "root_id", "name")
    rows = ids.join(known, ["account_id", "root_id"], "left").join(names, ["account_id", "root_id"], "left")
    return rows.select("account_id", "root_id", F.coalesce("name", "_title").alias("title"), "root_date")


def effective_titles(roots: DataFrame, nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    return _effective(roots, nodes, overrides).select("account_id", "root_id", F.coalesce("title", F.lit("")).alias("title"))


def colliding_root_titles(roots: DataFrame, nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """(account_id, title): trimmed titles that several roots have."""
    rows = effective_titles(roots, nodes, overrides).withColumn("title", strip("title")).where("title <> ''")
    return rows.groupBy("account_id", "title").agg(F.count("*").alias("n")).where("n > 1").select("account_id", "title")


def lineage_context(clips: DataFrame, roots: DataFrame, nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """clips with root_id, root_title, root_date, parent_id, edge_type and status."""
    cached = roots.select("account_id", "clip_id", present("root_id").alias("_root"), F.col("status").alias("_status"))
    rows = clips.join(cached, ["account_id", "clip_id"], "left").withColumn("root_id", F.coalesce("_root", "clip_id"))
    # roots that are no cached root take their node's title without an override
    titles = _effective(roots, nodes, overrides).withColumnsRenamed({"title": "_root_title", "root_date": "_root_date"})
    own = nodes.select("account_id", F.col("clip_id").alias("root_id"), F.col("title").alias("_node_title"), F.col("created_at").alias("_node_date"))
    rows = rows.join(titles, ["account_id", "root_id"], "left").join(own, ["account_id", "root_id"], "left").withColumn("_p", primary_parent())
    extra = {
        "root_title": F.coalesce("_root_title", "_node_title", "title"),
        "root_date": F.coalesce("_root_date", "_node_date", "created_at"),
        "parent_id": F.coalesce("_p.parent_id", F.lit("")),
        "edge_type": F.col("_p.edge"),
        "lineage_status": F.coalesce("_status", F.lit("resolved")),
    }
    return rows.withColumns(extra).drop("_root", "_status", "_root_title", "_root_date", "_node_title", "_node_date", "_p")


