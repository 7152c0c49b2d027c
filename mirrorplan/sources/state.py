"""Recorded state as versioned Parquet snapshots, and the files that are there.

Plain Parquet has no MERGE: what changes is written beside the old files, then one small pointer file, named by its number,
makes the new set of tables current at once. A reader sees whole versions only, and no folder that is read is ever written
to. A writer names the version that it read, and fails if another has been published since: the pointer file takes its
place by a rename that does not overwrite. That is exclusive on HDFS; a local disk checks first and then renames, and
object stores without a conditional rename do no better, so there one writer at a time is up to the caller.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

BUCKETS = 64
_BUCKET = "_account_bucket"
_ONE = "table"
AUDIO = r"\.(flac|mp3|wav|m4a)$"


class StaleState(RuntimeError):
    """Another version was published after the one that a writer had read."""


class Version(NamedTuple):
    """number: 0 before the first. tables: a folder of each table, or its folder for each account bucket that has rows."""

    number: int
    tables: dict[str, str | dict[str, str]]
    note: dict


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, fs = _hadoop(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def current(spark: SparkSession, path: str) -> Version:
    """The newest version of the tables under path. One that cannot be read is an error, never an empty state."""
    numbers = [int(n) for n in _names(spark, f"{path}/versions") if n.isdigit()]
    if not numbers:
        return Version(0, {}, {})
    at, fs = _hadoop(spark, f"{path}/versions/{max(numbers)}")
    stream = fs.open(at)
    try:
        body = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(max(numbers), body["tables"], body["note"])


def _publish(spark: SparkSession, path: str, version: Version) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    draft, fs = _hadoop(spark, f"{path}/versions/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"tables": version.tables, "note": version.note}).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{version.number}")
    overwrite_nothing = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(final), overwrite_nothing)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        raise StaleState(f"version {version.number} of {path} was published by another writer") from None


def _bucket() -> F.Column:
    return F.pmod(F.xxhash64("account_id"), F.lit(BUCKETS)).cast("int").alias(_BUCKET)


def buckets_of(accounts: DataFrame) -> list[int]:
    """The buckets, at most BUCKETS of them, that hold these accounts (account_id)."""
    return sorted(r[0] for r in accounts.select(_bucket()).distinct().collect())


def commit(spark: SparkSession, path: str, base: Version, tables: dict[str, DataFrame], bucketed: Iterable[str] = (), buckets: list[int] | None = None, note: dict | None = None) -> Version:
    """Publish tables as the version after base, all at once; those that are not given stay as they are.

    bucketed tables lie in folders by account bucket. buckets: they hold the rows of these buckets only, and all other
    buckets keep their folders. A failure or a StaleState before the end leaves base current.
    """
    folder, places = f"v{base.number + 1}-{uuid.uuid4().hex}", dict(base.tables)
    for name, df in tables.items():
        at = f"{folder}/{name}"
        if name not in bucketed:
            df.write.parquet(f"{path}/{at}")
            places[name] = at
            continue
        # few files to a bucket, and a bucket with many rows is written by several tasks
        df.select("*", _bucket()).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/{at}")
        old = base.tables.get(name, {}) if buckets is not None else {}
        kept = {k: v for k, v in old.items() if int(k) not in buckets} if old else {}
        places[name] = kept | {n.split("=")[1]: f"{at}/{n}" for n in _names(spark, f"{path}/{at}") if n.startswith(f"{_BUCKET}=")}
    version = Version(base.number + 1, places, base.note | (note or {}))
    _publish(spark, path, version)
    return version


def table(spark: SparkSession, path: str, version: Version, name: str, schema: T.StructType | str, buckets: list[int] | None = None) -> DataFrame:
    """A table of a version; one that it does not have is empty. buckets: the rows of these alone are read, if it lies in buckets."""
    at = version.tables.get(name)
    folders = [at] if isinstance(at, str) else [v for k, v in (at or {}).items() if buckets is None or int(k) in buckets]
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def read_state(spark: SparkSession, path: str, schema: T.StructType | str, accounts: list[str] | None = None) -> DataFrame:
    """The current version of a state table; none yet: empty. accounts: only their rows, of a table in buckets from their buckets alone."""
    return _of_accounts(spark, path, current(spark, path), _ONE, schema, accounts)


def _of_accounts(spark: SparkSession, path: str, version: Version, name: str, schema: T.StructType | str, accounts: list[str] | None) -> DataFrame:
    if accounts is None:
        return table(spark, path, version, name, schema)
    named = spark.createDataFrame([(a,) for a in accounts], "account_id string")
    return table(spark, path, version, name, schema, buckets_of(named)).where(F.col("account_id").isin(*accounts))


def write_state(df: DataFrame, path: str, by_account: bool = False, base: int | None = None) -> int:
    """Write df as the next version of the table under path, in folders by account bucket if asked; returns its number.

    base: the number of the version that df was made from; StaleState if that is no longer the current one. Without it
    df follows whatever is current when it is published.
    """
    spark = df.sparkSession
    while True:
        now = current(spark, path)
        if base is not None and now.number != base:
            raise StaleState(f"{path} is at version {now.number}, not {base}")
        try:
            return commit(spark, path, now, {_ONE: df}, [_ONE] if by_account else []).number
        except StaleState:
            if base is not None:
                raise


def write_lineage(tables: dict[str, DataFrame], path: str, base: Version | None = None) -> Version:
    """Nodes, edges, roots, albums, playlists and owners in account buckets, current all at once. base: the version that they were made from, if any."""
    spark = next(iter(tables.values())).sparkSession
    return commit(spark, path, current(spark, path) if base is None else base, tables, [n for n, df in tables.items() if "account_id" in df.columns])


def read_lineage(spark: SparkSession, path: str, schemas: dict[str, str], accounts: list[str] | None = None) -> dict[str, DataFrame]:
    version = current(spark, path)
    return {name: _of_accounts(spark, path, version, name, schema, accounts) for name, schema in schemas.items()}


def stamp_runs(previous: DataFrame, finished: DataFrame, now: int) -> DataFrame:
    """(account_id, last_run): finished accounts take the stamp now, others keep theirs."""
    rows = previous.join(finished.select("account_id", F.lit(True).alias("_done")).distinct(), "account_id", "full_outer")
    return rows.select("account_id", F.when(F.col("_done"), F.lit(now)).otherwise(F.col("last_run")).cast("bigint").alias("last_run"))


def scan_inventory(spark: SparkSession, root: str, account_id: str) -> DataFrame:
    """Files under root: path below it, size, whether they are audio, a content hash of the others, and unreadable.

    Audio is never read: without its content only the listing is. A file that is listed but whose content cannot
    be read is unreadable, not missing. Empty files are listed, with size 0, which the planner treats as missing.
    """
    uri = files.folder_uri(spark, root)
    listed = files.list_files(spark, uri).withColumn("audio", F.lower("path").rlike(AUDIO))
    rows = listed.join(files.content_hashes(spark, uri, listed.where("not audio")), "path", "left")
    unreadable = ~F.col("audio") & F.col("content_hash").isNull()
    return rows.select(F.lit(account_id).alias("account_id"), "path", F.lit(True).alias("exists"), "size", "content_hash", "audio", unreadable.alias("unreadable"))


def probe(manifest_paths: DataFrame, found: DataFrame) -> DataFrame:
    """Recorded (account_id, path) with what was found there; a path without a file does not exist and has size 0."""
    rows = manifest_paths.distinct().join(found, ["account_id", "path"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select("account_id", "path", flag("exists"), F.coalesce("size", F.lit(0)).alias("size"), "content_hash", flag("unreadable"))


def unpack_verified(x: str) -> dict[str, F.Column]:
    """source_hash and content_hash of a packed 'verified:<source>:<content>' or 'verified-art:…' hash; others are bare sources."""
    packed = F.regexp_like(F.col(x), F.lit(r"^verified(-art)?:[^:]*:"))
    parts = F.regexp_extract(x, r"^verified(?:-art)?:([^:]*):(.*)$", 1), F.regexp_extract(x, r"^verified(?:-art)?:([^:]*):(.*)$", 2)
    return {"source_hash": F.when(packed, parts[0]).otherwise(F.col(x)), "content_hash": F.when(packed, parts[1])}
