import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mirrorplan.llm import urls
from mirrorplan.llm.queries import URL_RULES
from tests.llm.oracle import compare


def test_oracle(spark):
    assert compare(spark, entry, "op8_urls", "/root/testdata/sf0.01") == 250
    assert compare(spark, entry, "op8_urls", "/root/testdata/sf0.1") == 2500


def test_rules_and_parts(spark):
    cases = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "x://net": ("net", "", None, "allow"),
        "x://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
        "x://a.example.com/de/1": ("a.example.com", "/de/1", "example.com/de/", "block"),
        "x://w.org/fr/?a=/": ("w.org", "/fr/", "org/fr/", "allow"),
        "x://w.org?/fr/": ("w.org", "", None, "allow"),
        "x://h://y/z": ("h:", "//y/z", None, "allow"),
        "no scheme/net/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(98, None), (99, None), (None, "x://q.net/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 as host", "2 as bad")
    none = spark.createDataFrame([], "url string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, none, URL_RULES).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert got[98] == got[99] == ("", "", None, "allow") and got[None] == ("q.net", "/", "net/", "block")
    assert urls.judge(pages.limit(0), none, URL_RULES).collect() == []


def test_reputation(spark):
    pages, marks = [], []
    for k in range(40):
        pages += [(k, "http://bad.spam.zz/a"), (100 + k, f"http://good{k}.fine.yy/a"), (200 + k, f"http://u{k}.spam.zz/b")]
        marks += [("http://bad.spam.zz/a", 1), (f"http://good{k}.fine.yy/a", k % 10 == 0), (f"http://u{k}.spam.zz/b", 1)]
    pages += [(900, "http://new.spam.zz/"), (901, "http://new.fine.yy/"), (902, "http://good1.fine.yy/")]
    marks += [(None, 1), ("no host", 1), ("http://new.fine.yy/", None), ("http://new.fine.yy/", 7)]
    df = spark.createDataFrame(pages, "page_id bigint, url string")
    out = spark.createDataFrame([(a, None if b is None else int(b)) for a, b in marks], "url string, bad int").selectExpr("*", "'h' as host")
    got = {r.page_id: r.verdict for r in urls.judge(df, out, []).collect()}
    assert got[0] == got[900] == "block" and got[901] == got[902] == got[100] == "allow"
    left = urls.filter_pages(df, out, [])
    assert left.columns == df.columns and {r.page_id for r in left.collect()} == {i for i, v in got.items() if v == "allow"}


def test_method_decides(spark):
    """Without a rule both verdicts occur, on each side of a split the method has not seen."""
    for sf in ("sf0.01", "sf0.1"):
        rows = entry.queries()["op8_urls"](spark, f"/root/testdata/{sf}").where("rule is null").collect()
        assert {r.verdict for r in rows} == {"allow", "block"}
        named = [any(t in r.host.replace("-", ".").split(".") for t in urls.BAD_TERMS) for r in rows]
        assert all(n for r, n in zip(rows, named, strict=True) if r.verdict == "block")
        assert sum(r.verdict == "block" for r in rows) > 0.6 * sum(named)
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").withColumn("bad", urls.outcome(F.col("url"), F.col("html")))
    seen = F.expr("crc32(string(page_id)) % 5 <> 0")
    found = urls.judge(pages.where(~seen), pages.where(seen), []).join(pages.select("page_id", "bad"), "page_id").collect()
    caught = [r.bad for r in found if r.verdict == "block"]
    assert len(found) > 400 and sum(caught) == len(caught) > 0.5 * sum(r.bad for r in found)


@pytest.mark.parametrize("tail", urls.LONG_SUFFIXES)
def test_long_suffixes(spark, tail):
    """A registrant below a suffix of two labels is judged by its own hosts, in query and SQL."""
    rows = [(k, f"http://spam.bad.{tail}/{k}", "") for k in range(60)]
    rows += [(100 + k, f"http://h{k}.good{k}.{tail}/", "x") for k in range(60)] + [(200 + k, f"http://spam.h{k}.bad.{tail}/", None) for k in range(60)]
    rows += [(300, f"http://new.bad.{tail}/", ""), (301, f"http://new.other.{tail}/", ""), (302, f"http://{tail}/", ""), (303, None, "!!" * 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    with tempfile.TemporaryDirectory(prefix="spark-") as d:
        pages.write.parquet(f"{d}/pages.parquet")
        got = sorted(map(tuple, entry.queries()["op8_urls"](spark, d).collect()))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet/*.parquet'")
        assert got == sorted(con.execute(entry.oracle_sql()["op8_urls"]).fetchall())
    verdict = {r[0]: r[4] for r in got}
    assert verdict[0] == verdict[300] == "block" and verdict[301] == verdict[302] == verdict[303] == verdict[100] == "allow"
