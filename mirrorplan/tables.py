"""Tables written in the folder that driver and executors share, to end a long lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, with its file system's name; where it is unset, one machine takes a folder of its own and a cluster is an error."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-mirrorplan-"))
        known = sc.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(known.rstrip("/"))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs meanwhile go as it ends, on all executors, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again. No shuffle files are left behind it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that written() made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard_named(df: DataFrame, *names: str) -> None:
    """discard() of those tables that df is read from which written() made under these names."""
    spark = df.sparkSession
    ours = re.compile(re.escape(shared_dir(spark)) + f"/({'|'.join(names)})-[0-9a-f]{{32}}")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if ours.fullmatch(path.toString()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, group: str, order: list[str | Column], name: str) -> DataFrame:
    """df with the place, from 1, of each row in its group by an order that leaves no ties that matter.

    Rows are dealt by ranges of group and order, sorted within each and written with their place there, and the ranges'
    counts are added up, so that no task holds a whole group.
    """
    keys = [f"_o{k}" for k in range(len(order))]
    rows = df.withColumns({k: F.col(o) if isinstance(o, str) else o for k, o in zip(keys, order, strict=True)})
    rows = rows.repartitionByRange(group, *keys).sortWithinPartitions(group, *keys).select(*df.columns, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_id"))
    rows = written(rows, "ranges")
    counts = rows.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_start"))
    rows = rows.join(starts, [group, "_range"])
    return rows.select(*df.columns, (F.col("_id") + F.col("_start")).cast("int").alias(name))
