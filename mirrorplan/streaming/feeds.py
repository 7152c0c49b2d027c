"""Landed feed pages as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.clips import POINTING
from ..operators import lineage
from ..sources import state
from ..sources.ingest import clip_columns, decode_feed_pages, feed_completeness, items
from ..tables import discard, written

PAGES = "account_id string, walk string, page int, landed_at timestamp, payload string"
STATUS = "account_id string, walk string, page int, landed_at timestamp, has_more boolean, next_cursor string, any_filtered boolean, n_clips int"
REJECTS = "account_id string, walk string, page int, landed_at timestamp, reason string, payload string"
WALKS = "account_id string, walk string, complete boolean, any_filtered boolean, n_pages bigint, n_rejected bigint, completed_in bigint"
LEDGER = {"pages": STATUS, "rejects": REJECTS, "walks": WALKS}
NODES = "account_id string, clip_id string, title string, created_at string, clip_type string, task string, is_trashed boolean, first_seen_at string, last_seen_at string"
EDGES = "account_id string, child_id string, parent_id string, edge_type string, role string, ordinal int, source_field string, status string, first_seen_at string, last_seen_at string"
TREE = "account_id string, clip_id string, parent_id string, root_id string, status string"
ROOTS = "account_id string, clip_id string, root_id string, status string, computed_at string"
#: The columns of a clip that fold_batch() reads.
FOLDED = ("account_id", "clip_id", "landed_at", "title", "created_at", "is_trashed", "handle", "clip_roots", "clip_attribution_type", *POINTING)
LAPSING = "account_id string, clip_id string"
LINEAGE = {"nodes": NODES, "edges": EDGES, "tree": TREE, "roots": ROOTS}


def stream_pages(spark: SparkSession, landing: str, files_per_trigger: int = 1000) -> DataFrame:
    """The JSON page files that land in a folder, as a stream. walk: which listing a page belongs to, if there are several."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).json(landing)


def stream_feed(spark: SparkSession, landing: str, files_per_trigger: int = 1000) -> DataFrame:
    """Clips of the JSON page files that land in a folder, as a stream. Pages that do not parse have none; stream_walks() keeps those."""
    pages = stream_pages(spark, landing, files_per_trigger)
    rows = pages.select("account_id", "landed_at", F.explode(items(F.try_parse_json("payload"), "$.clips")).alias("_c"))
    return rows.select("account_id", "landed_at", *(x.alias(k) for k, x in clip_columns(F.col("_c")).items())).where("clip_id <> ''")


def stream_first_seen(clips: DataFrame, within: str = "1 day") -> DataFrame:
    """Each clip of an account once, for notifications. Rows behind the watermark are dropped, so this is never
    a base for deletes."""
    return clips.withWatermark("landed_at", within).dropDuplicatesWithinWatermark(["account_id", "clip_id"])


def append_stream(clips: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """All that has landed so far, appended to a Parquet table."""
    return clips.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_pages(batch: DataFrame, path: str, number: int) -> state.Version:
    """Take a batch of pages into the ledger of listing walks under path: what each page says, pages that do not parse, and how far each walk is.

    Pages may come in any order and more than once; of one page the last landed that parses counts. A walk's pages chain
    as far as their numbers run from 0 without a gap, so a page that has not come yet, or that was damaged, holds the walk
    open, whatever later pages say. complete and any_filtered of the chained pages are those of feed_completeness().
    n_rejected counts pages of a walk that never came in order; completed_in is the batch that first saw it complete. Only
    the account buckets of the batch's pages are read and written; the batch number is published with them, so a
    batch that is run again changes nothing.
    """
    spark, walk = batch.sparkSession, ["account_id", "walk"]
    base = state.current(spark, path)
    if base.note.get("batch", -1) >= number:
        return base
    rows = written(batch.withColumn("walk", F.coalesce("walk", F.lit(""))), "pages")
    buckets = state.buckets_of(rows)
    pages, rejects, walks = (state.table(spark, path, base, n, s, buckets) for n, s in LEDGER.items())
    v = F.try_parse_json("payload")
    reason = F.when(v.isNull(), "not JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "no object")
    judged = rows.withColumn("reason", reason)
    bad = judged.where("reason is not null").select(*(c.split()[0] for c in REJECTS.split(", ")))
    good = decode_feed_pages(judged.where("reason is null").drop("reason"))[1]
    fields = [c.split()[0] for c in STATUS.split(", ")][3:]
    pages = pages.unionByName(good).groupBy(*walk, "page").agg(F.max_by(F.struct(*fields), "landed_at").alias("s")).select(*walk, "page", "s.*")
    pages, rejects = written(pages, "pages"), written(rejects.unionByName(bad), "rejects")

    rank = F.row_number().over(Window.partitionBy(*walk).orderBy("page"))
    chained = pages.withColumn("_at", rank - 1).where("_at = page").drop("_at")
    found = feed_completeness(chained, walk)
    lost = rejects.select(*walk, "page").distinct().join(pages, [*walk, "page"], "left_anti").groupBy(*walk).agg(F.count("*").alias("n_rejected"))
    seen = pages.groupBy(*walk).agg(F.count("*").alias("n_pages")).join(lost, walk, "full_outer").join(found, walk, "left").join(walks.select(*walk, "completed_in"), walk, "left")
    complete = F.coalesce("complete", F.lit(False))
    walks = seen.select(
        *walk, complete.alias("complete"), F.coalesce("any_filtered", F.lit(False)).alias("any_filtered"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"),
        F.coalesce("completed_in", F.when(complete, F.lit(number))).cast("bigint").alias("completed_in"),
    )
    version = state.commit(spark, path, base, {"pages": pages, "rejects": rejects, "walks": walks}, LEDGER, buckets, {"batch": number})
    discard(rows, pages, rejects)
    return version


def stream_walks(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the ledger of listing walks under path as pages land."""

    def fold(batch: DataFrame, number: int) -> None:
        fold_pages(batch, path, number)

    return pages.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ledger(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Pages, rejects and walks as the last batch left them."""
    version = state.current(spark, path)
    return {name: state.table(spark, path, version, name, schema) for name, schema in LEDGER.items()}


def fold_batch(batch: DataFrame, path: str, number: int) -> state.Version:
    """Fold clips (with landed_at) into the lineage tables under path; only the account buckets that they touch are read and written.

    Tables: nodes, edges, roots, and tree (account_id, clip_id, parent_id, root_id, status): the parent that each clip now
    has, and where its chain ends. A listed clip has its own parent; once it is listed no more the greatest archived one
    counts, so clips for which these differ are kept as `lapsing` until the next batch. Clips whose parent changed, and
    new ones, change the roots of nothing but the trees that they stand in: all rows whose chain ended where theirs
    did, or at the new clip while it was unknown. Those are found by one semi-join on the stored end, not level by level,
    and resolved anew; all others keep their roots. computed_at is when a clip's root was last worked out.

    The batch number is published with the tables, by one pointer: a batch that is run again changes nothing, and a crash
    before that leaves the tables as they were. Two folds at once: one of them raises StaleState.
    """
    spark = batch.sparkSession
    base = state.current(spark, path)
    if base.note.get("batch", -1) >= number:
        return base
    now, key = f"batch-{number}", ["account_id", "clip_id"]
    latest = batch.groupBy(*key).agg(F.max_by(F.struct(*[c for c in batch.columns if c in FOLDED and c not in key]), "landed_at").alias("r")).select(*key, "r.*")
    latest = written(latest, "batch")
    lapsing = state.table(spark, path, base, "lapsing", LAPSING)
    buckets = state.buckets_of(latest.select("account_id").union(lapsing.select("account_id")))
    nodes, edges, tree, roots = (state.table(spark, path, base, n, s, buckets) for n, s in LINEAGE.items())
    edges = written(lineage.update_edges(edges, lineage.all_edges(latest), now), "edges")
    archived = lineage.archived_parents(edges).withColumnRenamed("child_id", "clip_id")

    live = written(lineage.parents(latest).select(*key, "parent_id"), "live")
    old = lapsing.join(live, key, "left_anti").join(archived, key, "left")
    before = tree.select(*key, F.col("parent_id").alias("_was"), F.col("root_id").alias("_root"), F.lit(True).alias("_known"))
    changed = live.unionByName(old).join(before, key, "left").where(F.col("_known").isNull() | ~F.col("parent_id").eqNullSafe(F.col("_was")))
    changed = written(changed, "changed")
    marks = changed.select("account_id", F.coalesce("_root", "clip_id").alias("root_id")).distinct()
    others = tree.join(marks, ["account_id", "root_id"], "left_semi").join(changed, key, "left_anti").select(*key, "parent_id")
    lookup = written(changed.select(*key, "parent_id").unionByName(others), "lookup")
    kept = tree.join(lookup, key, "left_anti")
    found = lineage.resolve_roots(lookup, kept)

    tables = {
        "nodes": lineage.update_nodes(nodes, latest, now), "edges": edges, "tree": kept.unionByName(lookup.join(found, key)), "roots": lineage.update_roots(roots, found, now),
        "lapsing": live.join(archived.withColumnRenamed("parent_id", "_archived"), key, "left").where(~F.col("parent_id").eqNullSafe(F.col("_archived"))).select(*key),
    }
    version = state.commit(spark, path, base, tables, LINEAGE, buckets, {"batch": number})
    discard(latest, live, edges, changed, lookup, found)
    return version


def stream_lineage(clips: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fold each batch of a stream of clips into the lineage tables under path."""

    def fold(batch: DataFrame, number: int) -> None:
        fold_batch(batch, path, number)

    clips = clips.select(*(c for c in clips.columns if c in FOLDED))  # a batch is made with all the columns of its stream, read or not
    return clips.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_lineage(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nodes, edges, tree and roots as the last batch left them."""
    version = state.current(spark, path)
    return {name: state.table(spark, path, version, name, schema) for name, schema in LINEAGE.items()}
