"""WARC records in ZIP-packaged archives, written and read in Spark tasks.

An archive is a ZIP file of stored members: archive/data.warc.gz, one gzip member per record, and
indexes/index.cdx, one line per record with its offset and length. The reader fetches the end of the
file, parses the end record (ZIP64's, where there is one) and the central directory, finds the
members' data through their local headers, reads the index, and then range-reads runs of records. No
member is ever extracted.

Archives are named by the task attempt that wrote them, and only the names that finished tasks
return are read, so a lost executor or a second attempt leaves at most an unread file.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._state import materialise, shared_dir
from ._text import column

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 1000
#: WARC bytes after which a task begins another archive, and that one range read fetches, about.
ARCHIVE_BYTES = 16 << 20
RANGE_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_DATE = "1970-01-01T00:00:00Z"  # the pages carry no time of capture


# --- records ---------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit (HTTP headers only) if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, type, refers_to); the payload of a response is verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest, kind = int(_headers(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['warc-record-id']}: payload does not match its digest")
    number = lambda key: int(n) if (n := fields.get(key, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return number("warc-record-id"), size, digest, kind, number("warc-refers-to")


# --- archives ----------------------------------------------------------------------------------


def write_archive(f, records: list[bytes], force_zip64: bool = False) -> None:
    """A ZIP of stored members: the records, each gzipped, and their index."""
    data, index, at = [], [], 0
    for n, r in enumerate(records):
        z = gzip.compress(r, 6, mtime=0)
        data.append(z)
        index.append(f"{n} " + json.dumps({"offset": at, "length": len(z)}) + "\n")
        at += len(z)
    with zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
        for name, parts in ((DATA, data), (INDEX, [x.encode() for x in index])):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=force_zip64) as member:
                for p in parts:
                    member.write(p)


def _zip64(extra: bytes, values: list[tuple[int, int]]) -> list[int]:
    """Values whose 32- or 16-bit field is full come, in order, from the ZIP64 extra field."""
    at, found = 0, b""
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            found = extra[at + 4 : at + 4 + size]
        at += 4 + size
    out, at = [], 0
    for value, full in values:
        if value == full:
            value = int.from_bytes(found[at : at + 8], "little")
            at += 8
        out.append(value)
    return out


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (first byte of its data, bytes) of the stored members, from the central directory.

    f: anything with read_at(bytes, offset). Members under a compression or encryption raise.
    """
    tail_at = max(0, size - (1 << 16) - 22 - 20)
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    entries, _, dir_size, dir_at = struct.unpack_from("<HHII", tail, end + 8)[0], None, *struct.unpack_from("<II", tail, end + 12)
    where = tail.rfind(b"PK\6\7", 0, end)
    if where == end - 20 and where >= 0:
        at = struct.unpack_from("<Q", tail, where + 8)[0]
        big = f.read_at(56, at)
        if big[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory where its locator says")
        entries, dir_size, dir_at = struct.unpack_from("<QQQ", big, 32)
    directory, at, found = f.read_at(dir_size, dir_at), 0, {}
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        plain, packed, local = _zip64(extra, [(plain, 0xFFFFFFFF), (packed, 0xFFFFFFFF), (local, 0xFFFFFFFF)])
        if method or flags & 1:
            raise ValueError(f"member {name} is not stored plainly")
        head = f.read_at(30, local)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        found[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
        at += 46 + n_name + n_extra + n_comment
    return found


def record_ranges(f, size: int) -> Iterator[tuple[int, list[int]]]:
    """(offset in the file, lengths of the records there) of runs of about RANGE_BYTES, from the index."""
    found = members(f, size)
    (data_at, data_size), (index_at, index_size) = found[DATA], found[INDEX]
    run_at, lengths, expected = data_at, [], 0
    for line in f.read_at(index_size, index_at).decode().splitlines():
        entry = json.loads(line.split(" ", 1)[1])
        if entry["offset"] != expected or expected + entry["length"] > data_size:
            raise ValueError("the index does not fit the records")
        expected += entry["length"]
        lengths.append(entry["length"])
        if sum(lengths) >= RANGE_BYTES:
            yield run_at, lengths
            run_at, lengths = data_at + expected, []
    if lengths:
        yield run_at, lengths


#: How Arrow names the file systems that Hadoop knows under these schemes. Arrow has no others.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}


def _qualified(spark: SparkSession, folder: str) -> str:
    """folder with the scheme of its file system, by Spark's own settings; one that tasks could not open is an error before anything is written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if (scheme := uri.split(":", 1)[0]) not in SCHEMES:
        raise ValueError(f"archives cannot be written to a {scheme} folder ({uri}); schemes: {', '.join(SCHEMES)}")
    return uri


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path there of a URI. Without a scheme it would be another disk on each executor, so that is an error."""
    scheme, _, rest = uri.partition(":")
    if scheme not in SCHEMES or not rest.startswith("/"):
        raise ValueError(f"no URI that Arrow can open: {uri}")
    return pafs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest if rest.startswith('//') else '//' + rest}")


# --- Spark jobs ---------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html) -> with payload digest and refers_to, null for responses.

    Of equal payloads of min_bytes or more the largest page_id is the response. Only payloads that
    occur twice are joined back; a payload that most pages share is one row of that side.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "size": F.octet_length("html")})
    again = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    again = again.where("n > 1 and keeper is not null").drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return rows.join(again, ["digest", "size"], "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, force_zip64: bool = False) -> DataFrame:
    """Write archives under folder (that all executors reach); returns (archive, records). Each html is one record and held whole, with its gzip."""
    folder = _qualified(pages.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)

        def flush(records: list[bytes]) -> pa.RecordBatch:
            name, packed = f"{uuid.uuid4().hex}.wacz", io.BytesIO()
            write_archive(packed, records, force_zip64)
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(packed.getbuffer())
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(records)], pa.int64())], ["archive", "records"])

        records, size = [], 0
        for batch in batches:
            cols = [column(batch, c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for row in zip(*cols, strict=True):
                page, url, html, digest, refers = (x.as_py() for x in row)
                records.append(record(page, url, html.encode(), digest, refers))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield flush(records)
                    records, size = [], 0
        if records:
            yield flush(records)

    return materialise(with_revisits(pages).mapInArrow(run, "archive string, records bigint"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """(archive) -> (page_id, payload_bytes, payload_digest, record_type, refers_to), one row per record."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in column(batch, "archive").to_pylist():
                fs, path = _open(uri)
                with fs.open_input_file(path) as f:
                    found = list(record_ranges(f, f.size()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(found)), pa.array([a for a, _ in found], pa.int64()), pa.array([n for _, n in found], pa.list_(pa.int64()))],
                    ["archive", "at", "lengths"],
                )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for uri, at, lengths in zip(*(column(batch, c).to_pylist() for c in ("archive", "at", "lengths")), strict=True):
                fs, path = _open(uri)
                with fs.open_input_file(path) as f:
                    raw, rows, begin = f.read_at(sum(lengths), at), [], 0
                for n in lengths:
                    rows.append(parse_record(zlib.decompress(raw[begin : begin + n], 31)))
                    begin += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    located = archives.select("archive").mapInArrow(ranges, "archive string, at bigint, lengths array<bigint>").repartition(n)
    return located.mapInArrow(records, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as archives and read the records back, one row per page row.

    A null html is an empty payload, a null url leaves out the target, a null page_id stays null and
    never is what others refer to. Rows that repeat the response's page_id are responses too. An empty
    table gives no archive and no row.
    """
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder))
