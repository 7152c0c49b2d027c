"""Files under a folder, listed and hashed in tasks.

Spark's own file sources list no empty files and none whose name begins with an underscore, and hand over a file as one
row, at most 2 GB. So folders are listed level by level in tasks, and large files are read there in ranges.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written

#: How Arrow names the file systems that Hadoop knows under these schemes. Arrow has no others.
ARROW_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}
WHOLE_BYTES = 16 << 20  # a file up to this size is hashed as one row
RANGE_BYTES = 8 << 20  # what a task holds of a larger one
_ROWS = 10_000


def folder_uri(spark: SparkSession, root: str) -> str:
    """root with the name of its file system. One that does not exist is an error, not an empty folder, and so is one that tasks cannot open."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = fs.makeQualified(path).toString()
    if uri.split(":", 1)[0] not in ARROW_SCHEMES:
        raise ValueError(f"tasks cannot list {uri}; schemes: {', '.join(ARROW_SCHEMES)}")
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise FileNotFoundError(f"no folder: {uri}")
    return uri


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, _, rest = uri.partition(":")
    fs, base = pafs.FileSystem.from_uri(f"{ARROW_SCHEMES[scheme]}:{quote(rest if rest.startswith('//') else '//' + rest, safe='/:@')}")
    return fs, base.rstrip("/")


def _tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def list_files(spark: SparkSession, uri: str) -> DataFrame:
    """(path, size) of all files below a folder, empty ones too, but for those with a dot first in a part of their path.

    One round for each level of folders, whose folders are dealt out to tasks; a task holds the listing of one folder.
    A folder that goes away during the walk has no files.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = fs.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base or "/", allow_not_found=True))
                known = [f for f in found if f.type in (pafs.FileType.File, pafs.FileType.Directory) and not f.base_name.startswith(".")]
                for k in range(0, len(known), _ROWS):
                    part = known[k : k + _ROWS]
                    names = [f"{folder}/{f.base_name}" if folder else f.base_name for f in part]
                    folders = [f.type == pafs.FileType.Directory for f in part]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(folders, pa.bool_()), pa.array([f.size for f in part], pa.int64())], ["path", "folder", "size"])

    level, levels = spark.createDataFrame([("",)], "path string"), []
    while not level.isEmpty():
        levels.append(written(level.repartition(_tasks(spark)).mapInArrow(look, "path string, folder boolean, size bigint"), "listing"))
        level = levels[-1].where("folder").select("path")
    return reduce(DataFrame.union, (df.where("not folder").select("path", "size") for df in levels))


def content_hashes(spark: SparkSession, uri: str, files: DataFrame, whole_bytes: int = WHOLE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, size) of files below the folder -> (path, content_hash), hexadecimal SHA-256, null where the content cannot be read.

    Files of up to whole_bytes are read by Spark. Others go one by one through a task that holds range_bytes of them:
    a SHA-256 can only be taken in order, so a file is never shared out.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(uri)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                total = hashlib.sha256()
                try:
                    with fs.open_input_file(f"{base}/{path}") as f:
                        while part := f.read(range_bytes):
                            total.update(part)
                except OSError:
                    total = None
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([total and total.hexdigest()], pa.string())], ["path", "content_hash"])

    # Spark passes over empty files and names with an underscore first
    by_range = (F.col("size") > whole_bytes) | (F.col("size") == 0) | F.col("path").rlike("(^|/)_")
    ranged = files.where(by_range).select("path").repartition(_tasks(spark)).mapInArrow(digest, "path string, content_hash string")
    literal = re.sub(r"([{}\[\]*?\\])", r"\\\1", uri)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(literal)
    small = read.where(F.col("length") <= whole_bytes).select(F.substr("path", F.lit(len(uri.rstrip("/")) + 2)).alias("path"), F.sha2("content", 256).alias("content_hash"))
    small = files.where(~by_range).select("path").join(small, "path", "left")
    return small.select("path", "content_hash").union(ranged)
