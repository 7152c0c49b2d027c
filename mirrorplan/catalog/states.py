"""Queries that write to the shared folder and read back: recorded state, folders of files, streams. With their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import state
from ..streaming import feeds
from ..tables import shared_dir, written
from .lineage import ALL_SQL, ROOTS_SQL, f04
from .payloads import PAGES_SQL, feed_pages
from .roles import clips_once, role, with_roles

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_roles(sql)
        return f

    return add


def folder(spark) -> str:
    return f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"


MANIFEST = "account_id string, clip_id string, path string, format string, size bigint, preserve boolean"


@query("a12_state_round_trip", "SELECT account_id, clip_id, path, format, size, preserve FROM {manifest}")
def a12(spark, sf_dir):
    """Half of the manifest, then what was read together with the other half, as the next version."""
    rows, at = role(spark, sf_dir, "manifest").select("account_id", "clip_id", "path", "format", "size", "preserve", "ord"), folder(spark)
    for half in (0, 1):
        state.write_state(state.read_state(spark, at, MANIFEST).union(rows.where(F.col("ord") % 2 == half).drop("ord")), at)
    return state.read_state(spark, at, MANIFEST)


_EDGES = "account_id string, child_id string, parent_id string, edge_type string, role string, ordinal int"


@query("a13_lineage_round_trip", f"SELECT account_id, child_id, parent_id, edge_type, role, CAST(ordinal AS INTEGER) AS ordinal FROM ({ALL_SQL}) WHERE CAST(account_id AS INTEGER) % 3 = 1")
def a13(spark, sf_dir):
    """Edges and clips written by account buckets; the edges of a third of the accounts read back, from their buckets only."""
    at = folder(spark)
    state.write_lineage({"edges": f04(spark, sf_dir), "nodes": role(spark, sf_dir, "clips").select("account_id", "clip_id")}, at)
    accounts = [str(k) for k in range(25) if k % 3 == 1]
    return state.read_lineage(spark, at, {"edges": _EDGES, "roots": "account_id string"}, accounts)["edges"]


@query(
    "a17_scan_inventory",
    """SELECT account_id, o_half = 1 AS audio, sum(strlen(clip_id) + 1)::BIGINT AS n_bytes, o_half = 0 AS hashed, FALSE AS unreadable FROM (SELECT account_id, clip_id, ord % 2 AS o_half FROM {clips}) GROUP BY ALL""",
)
def a17(spark, sf_dir):
    """A folder for each account with its ids as lines, half of them in files named as audio; then the folder's listing."""
    rows, at = role(spark, sf_dir, "clips"), folder(spark)
    for half, extension in ((0, "txt"), (1, "mp3")):
        part = rows.where(F.col("ord") % 2 == half).select("clip_id", F.col("account_id").alias("account"))
        part.write.mode("append").partitionBy("account").option("extension", extension).csv(f"{at}/files")
    found = state.scan_inventory(spark, f"{at}/files", "").where("path not like '%_SUCCESS'")
    account = F.regexp_extract("path", "account=([^/]*)/", 1)
    return found.groupBy(account.alias("account_id"), "audio").agg(F.sum("size").alias("n_bytes"), F.bool_and(F.col("content_hash").isNotNull()).alias("hashed"), F.bool_or("unreadable").alias("unreadable"))


@query("a18_last_run", "SELECT account_id, CAST(CASE WHEN k % 2 = 0 THEN 200 ELSE 100 END AS BIGINT) AS last_run FROM {accounts} WHERE k % 3 <> 0 OR k % 2 = 0")
def a18(spark, sf_dir):
    at, accounts, schema = folder(spark), role(spark, sf_dir, "accounts"), "account_id string, last_run bigint"
    for now, done in ((100, "k % 3 <> 0"), (200, "k % 2 = 0")):
        state.write_state(state.stamp_runs(state.read_state(spark, at, schema), accounts.where(done), now), at)
    return state.read_state(spark, at, schema)


def landed(spark, pages, at: str | None = None, later: int = 0) -> str:
    """A folder of gzipped page files, each line a page of an account; `later` hours after the first. Pages say the same names over and over."""
    at = at or f"{folder(spark)}/landing"
    stamp = F.timestamp_seconds(F.col("page") * 60 + 1_700_000_000 + 3600 * later)
    pages.select("account_id", "page", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("landed_at"), "payload").write.mode("append").option("compression", "gzip").json(at)
    return at


@query("s01_stream_feed", "SELECT account_id, clip_id, CASE WHEN ord % 6 = 0 THEN 'unknown' ELSE status END AS status, edited_clip_id FROM {clips} WHERE ord % 47 <> 0")
def s01(spark, sf_dir):
    clips = feeds.stream_feed(spark, landed(spark, feed_pages(spark, sf_dir))).select("account_id", "clip_id", "status", "edited_clip_id")
    return appended(spark, clips)


def appended(spark, stream):
    at = folder(spark)
    feeds.append_stream(stream, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("s02_stream_first_seen", "SELECT DISTINCT account_id, clip_id FROM {clips} WHERE ord % 47 <> 0")
def s02(spark, sf_dir):
    """Every page lands twice; each clip comes once."""
    pages = feed_pages(spark, sf_dir)
    clips = feeds.stream_feed(spark, landed(spark, pages.union(pages)))
    return appended(spark, feeds.stream_first_seen(clips.select("account_id", "clip_id", "landed_at"), "3650 days").select("account_id", "clip_id"))


@query(
    "s01_stream_completeness",
    f"""WITH p AS ({PAGES_SQL}), w AS (SELECT account_id, count(*) AS pages, bool_or(good < n) AS lost, min_by(good < n, page) AS first_lost, count(*) FILTER (WHERE page % 3 = 0) AS n_damaged FROM p GROUP BY account_id), k AS (SELECT *, CAST(account_id AS INTEGER) AS a FROM w)
        SELECT account_id, a % 3 <> 0 AND NOT (a % 5 = 4 AND pages > 1) AS complete, CASE WHEN a % 5 = 4 THEN first_lost ELSE lost END AS any_filtered, pages AS n_pages, n_damaged, 0 AS n_rejected, CASE WHEN a % 3 <> 0 AND NOT (a % 5 = 4 AND pages > 1) THEN 2 END AS completed_in FROM k""",
)
def s01b(spark, sf_dir):
    """Each account's pages land in three batches, later ones first; in the second the pages still missing come damaged."""
    pages, at, n = written(feed_pages(spark, sf_dir), "pages"), folder(spark), F.col("page") % 3
    damaged = pages.where(n == 0).withColumn("payload", F.left("payload", (F.length("payload") - 1)))
    for batch, rows in enumerate((pages.where(n == 2), pages.where(n == 1).unionByName(damaged), pages.where(n == 0))):
        source = landed(spark, rows, f"{at}/landing", batch)
        feeds.stream_walks(feeds.stream_pages(spark, source), f"{at}/ledger", f"{at}/checkpoint").awaitTermination()
    ledger = feeds.read_ledger(spark, f"{at}/ledger")
    counted = ledger["rejects"].groupBy("account_id").agg(F.count("*").alias("n_damaged"))
    return ledger["walks"].drop("walk").join(counted, "account_id")


def _clip_pages(rows, edited, page):
    """Each clip as a page of one; its edited pointer is the only link."""
    meta = F.struct(edited.alias("edited_clip_id"))
    body = F.to_json(F.struct(F.array(F.struct(F.col("clip_id").alias("id"), "title", meta.alias("metadata"))).alias("clips")))
    return rows.select("account_id", F.lit(page).alias("page"), body.alias("payload"))


# Roots are monotonic: what the second batch resolved at an orphan stays where the truth is no resolved root.
_ORPHAN = "last_value(CASE WHEN ord % 5 = 2 THEN c.clip_id END IGNORE NULLS) OVER"
_FOLDED = f"""SELECT account_id, clip_id, CASE WHEN status = 'resolved' OR orphan IS NULL THEN root_id ELSE orphan END AS root_id, CASE WHEN orphan IS NULL THEN status ELSE 'resolved' END AS status FROM ({ROOTS_SQL}) JOIN (
    SELECT account_id, clip_id, CASE WHEN cust % 11 <> 0 AND cust % 7 = 0 THEN coalesce(before, around) ELSE before END AS orphan FROM (
        SELECT c.account_id, c.clip_id, o_custkey AS cust, {_ORPHAN} (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before,
            {_ORPHAN} (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS around FROM {{clips}} c JOIN {{orders}} ON o_orderkey = ord)) USING (account_id, clip_id)"""


@query("s03_stream_lineage", _FOLDED)
def s03(spark, sf_dir):
    """Three batches: every clip, every fifth one made an orphan, the truth about those again."""
    rows, at = clips_once(spark, sf_dir, "account_id", "clip_id", "ord", "title", "edited_clip_id")["clips"], folder(spark)
    some = rows.where("ord % 5 = 2")
    for batch, pages in enumerate((_clip_pages(rows, F.col("edited_clip_id"), 0), _clip_pages(some, F.lit(""), 1), _clip_pages(some, F.col("edited_clip_id"), 2))):
        source = landed(spark, pages, f"{at}/landing", batch)
        feeds.stream_lineage(feeds.stream_feed(spark, source), f"{at}/state", f"{at}/checkpoint").awaitTermination()
    return feeds.read_lineage(spark, f"{at}/state")["roots"].select("account_id", "clip_id", "root_id", "status")
