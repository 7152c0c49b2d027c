import hashlib
import io
import zipfile

import pytest

import __spark_entry__ as entry
from mirrorplan.llm import warc
from tests.llm.oracle import compare


class Bytes(io.BytesIO):
    reads = 0

    def read_at(self, n, at):
        self.reads += n
        return self.getvalue()[at : at + n]


def test_oracle(spark):
    assert compare(spark, entry, "op7_warc", "/root/testdata/sf0.01") == 250


@pytest.mark.parametrize("zip64", [False, True])
def test_archive_round_trip(zip64, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 300)
    records = [warc.record(i, None, b"x" * i * 50, hashlib.sha1(b"x" * i * 50).hexdigest(), None) for i in range(20)]
    f = Bytes()
    warc.write_archive(f, records, zip64)
    raw = f.getvalue()
    assert zipfile.ZipFile(io.BytesIO(raw)).testzip() is None
    back = []
    for at, lengths in warc.record_ranges(f, len(raw)):
        for n in lengths:
            back.append(warc.parse_record(warc.zlib.decompress(raw[at : at + n], 31)))
            at += n
    assert [(i, 50 * i, "response") for i in range(20)] == [(r[0], r[1], r[3]) for r in back]


def test_zip64_directory_and_comment():
    f = Bytes()
    with zipfile.ZipFile(f, "w") as z:  # enough members for a ZIP64 end record
        for k in range(66_000):
            z.writestr(f"m/{k}", b"ab" if k == 5 else b"")
        z.comment = b"PK\3\4 a comment"
    found = warc.members(f, len(f.getvalue()))
    assert len(found) == 66_000 and f.read_at(*reversed(found["m/5"])) == b"ab"
    with zipfile.ZipFile(g := Bytes(), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"aaaaaaaaaaaaaaaaaaa")
    with pytest.raises(ValueError):
        warc.members(g, len(g.getvalue()))
    with pytest.raises(ValueError):
        warc.members(Bytes(b"no zip"), 6)


def test_large_offsets_come_from_zip64_fields():
    extra = b"\x99\x99\x02\x00zz" + b"\x01\x00\x10\x00" + (5 << 32).to_bytes(8, "little") + (7 << 33).to_bytes(8, "little")
    full = 0xFFFFFFFF
    assert warc._zip64(extra, [(full, full), (12, full), (full, full)]) == [5 << 32, 12, 7 << 33]


def test_damaged_payload_is_found():
    good = warc.record(1, "http://x/ y\n", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parse_record(good) == (1, 3, hashlib.sha1(b"abc").hexdigest(), "response", None)
    with pytest.raises(ValueError):
        warc.parse_record(good.replace(b"abc", b"abd"))


def test_edges(spark, tmp_path):
    big, other = "é" * 600, "b" * 999
    rows = [(1, "u", big), (2, None, big), (9, "http://a\r\nWARC-Type: x", big), (3, "u", other), (4, "u", other), (5, "u", None), (6, "u", ""),
            (None, "u", big), (9, "u", big), (7, "u", "line\r\n\r\nline" * 200), (8, "u", "c" * 1000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'q' as digest", "0 as size")
    got = sorted(map(tuple, warc.round_trip(spark, df, f"file://{tmp_path}/w").collect()), key=str)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        refers = 9 if h == big and i != 9 else None
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if refers else "response", refers))
    assert got == sorted(want, key=str)
    assert warc.round_trip(spark, df.limit(0)).collect() == []
    many = warc.write(df, f"{tmp_path}/small", archive_bytes=1, force_zip64=True)
    assert many.count() == len(rows) and sorted(map(tuple, warc.read(many).collect()), key=str) == got


def test_folders_are_qualified(spark, tmp_path):
    """A folder without a scheme is one of the session's file system; what tasks cannot open is an error at once."""
    pages = spark.createDataFrame([(1, "http://a/", "x" * 2000)], "page_id bigint, url string, html string")
    archives = warc.write(pages, str(tmp_path / "plain"))
    assert all(r["archive"].startswith("file:/") for r in archives.collect()) and warc.read(archives).count() == 1
    with pytest.raises(ValueError, match="viewfs"):
        spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.here.link./x", f"file://{tmp_path}")
        warc.write(pages, "viewfs://here/x/out")
    for uri in ("/tmp/x", "viewfs://here/x", "relative"):
        with pytest.raises(ValueError):
            warc._open(uri)
    assert warc._open("file:/tmp/x")[1] == warc._open("file:///tmp/x")[1] == "/tmp/x"


def test_long_page(spark):
    """50 MB of html in one record, and its copy."""
    pages = spark.sql("SELECT id AS page_id, 'http://a/' AS url, repeat('<p>long</p>', 4600000) AS html FROM range(2)")
    got = {r["page_id"]: r for r in warc.round_trip(spark, pages).collect()}
    assert (got[0]["record_type"], got[0]["refers_to"], got[1]["record_type"]) == ("revisit", 1, "response") and got[0]["payload_bytes"] == got[1]["payload_bytes"] == 50_600_000
