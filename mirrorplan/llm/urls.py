"""URL filters: host reputation by empirical Bayes, below explicit rules.

Labelled pages give each host a count of good and of bad outcomes. A host's rate of bad pages is
shrunk towards its registered domain's, that towards its public suffix's, and that towards the rate
of all; the strength of each prior (its pseudo-count) is estimated from how much the units of that
level differ, by the beta-binomial's moments. A page is blocked if the lower posterior bound of its
host's bad rate passes `max_bad`. Hosts without labelled pages take the posterior of the level above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._state import discard, materialise

#: Suffixes of more than one label; all others have one.
LONG_SUFFIXES = ("co.uk", "org.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # host, path, verdict

#: Labels of a host, or parts of one between hyphens, that mark its pages as bad.
BAD_TERMS = ("ads", "adult", "bets", "casino", "pills", "spam")
#: A page shouts if it has one '!!' or more for so many characters of html.
SHOUT = 100


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first '://': host up to '/', '?' or '#', A-Z lowered; path up to '?' or '#'. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict (the longer host on a tie), null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def outcome(url: Column, html: Column) -> Column:
    """1 if the host has one of BAD_TERMS or the html shouts, else 0: a weak label where no one has marked pages.

    A null url or html counts as empty.
    """
    host, text = host_and_path(url)[0], F.coalesce(html, F.lit(""))
    shouts = F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("")))
    named = host.rlike(rf"(^|[.-])({'|'.join(BAD_TERMS)})([.-]|$)")
    return (named | ((shouts > 0) & (shouts * SHOUT >= F.length(text) * 2))).cast("bigint")


def _levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    part = lambda n: F.substring_index(host, ".", -n)
    long = part(2).isin(*LONG_SUFFIXES)
    return F.when(long, part(3)).otherwise(part(2)), F.when(long, part(2)).otherwise(part(1))


def _strength(units: DataFrame) -> float:
    """Pseudo-count of a level's prior, from units (n, bad, prior), by moments."""
    p = F.col("bad") / F.col("n")
    spread = F.col("n") * (p - F.col("prior")) * (p - F.col("prior")) / (F.col("prior") * (1 - F.col("prior")))
    row = units.agg(F.sum(spread).alias("s"), F.count("*").alias("k"), F.sum("n").alias("n")).first()
    if not row["k"] or row["n"] <= row["k"]:
        return 10.0
    rho = min(0.99, max(0.001, (row["s"] - row["k"]) / (row["n"] - row["k"])))
    return 1 / rho - 1


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """(host, bad 0/1) -> tables of posterior (a, b) by host, by domain and by suffix, and the rate of all.

    Counts are summed per host before anything else, so a host with most of the pages is one row, and each
    level is written once: outcomes are read by one job.
    """
    domain, suffix = _levels(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = materialise(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)

    def level(units: DataFrame, keys: list[str]) -> DataFrame:
        units = materialise(units, "units")
        k = _strength(units)
        a, b = F.col("bad") + k * F.col("prior"), F.col("n") - F.col("bad") + k * (1 - F.col("prior"))
        return units.select(*keys, a.alias("a"), b.alias("b"))

    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("prior")
    by_suffix = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("prior", F.lit(rate))
    by_suffix = level(by_suffix, ["suffix"])
    by_domain = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_domain = level(by_domain.join(by_suffix.select("suffix", mean), "suffix"), ["domain"])
    by_host = level(hosts.join(by_domain.select("domain", mean), "domain"), ["host"])
    discard(hosts)
    return by_host, by_domain, by_suffix, rate


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], max_bad: float = 0.5, z: float = 1.645) -> DataFrame:
    """(page_id, url), (url, bad) -> (page_id, host, path, rule, verdict), one row per page row.

    A null url, or one without '://', has an empty host and path, no rule, and is judged by the rate of
    all. Outcomes without a host or with a value other than 0 and 1 count for nothing; repeated ones each
    count. An empty table of outcomes blocks nothing but by rule; an empty table of pages gives no row.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    marks = outcomes.where("bad in (0, 1)").select(host.alias("host"), F.col("bad").cast("bigint").alias("bad"))
    by_host, by_domain, by_suffix, rate = reputation(marks.where("host <> ''"))
    domain, suffix = _levels(F.col("host"))

    def bad(a: Column, b: Column) -> Column:
        m = a / (a + b)
        return m - z * F.sqrt(m * (1 - m) / (a + b + 1)) > max_bad

    names = rows.select("host").distinct().withColumns({"domain": domain, "suffix": suffix})
    judged = (
        names.join(by_host.withColumnsRenamed({"a": "a1", "b": "b1"}), "host", "left")
        .join(by_domain.withColumnsRenamed({"a": "a2", "b": "b2"}), "domain", "left")
        .join(by_suffix.withColumnsRenamed({"a": "a3", "b": "b3"}), "suffix", "left")
        .select("host", bad(F.coalesce("a1", "a2", "a3", F.lit(rate)), F.coalesce("b1", "b2", "b3", F.lit(1 - rate))).alias("block"))
    )
    # written, so that its size is known and Spark can split a host with most of the pages
    judged = materialise(judged, "judged")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(judged, "host").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("block"), "block").otherwise("allow")).alias("verdict"),
    )


def filter_pages(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], max_bad: float = 0.5) -> DataFrame:
    """pages whose verdict is 'allow'; all columns stay. Rows that repeat a page_id stand or fall by it."""
    gone = judge(pages, outcomes, rules, max_bad).where("verdict = 'block'").select(F.col("page_id").alias("_url_gone")).distinct()
    return pages.join(gone, F.col("page_id") == F.col("_url_gone"), "left_anti")
