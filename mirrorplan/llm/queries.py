"""The registered query of each operator: its rows come through the operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, language, lines, packing, quality, secrets, simhash, substrings, topk, urls, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_report(_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(_table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table marks pages as bad, so every page's outcome is read from itself (urls.outcome)."""
    pages = _table(spark, sf_dir, "pages")
    outcomes = pages.select("url", urls.outcome(F.col("url"), F.col("html")).alias("bad"))
    return urls.judge(pages.select("page_id", "url"), outcomes, URL_RULES)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.score(docs, quality.train(docs, labels))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audits(*conversations.damaged(_table(spark, sf_dir, "conversations")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(_table(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lines": op1_lines,
    "op2_language": op2_language,
    "op3_substrings": op3_substrings,
    "op4_packing": op4_packing,
    "op5_topk": op5_topk,
    "op6_decontaminate": op6_decontaminate,
    "op7_warc": op7_warc,
    "op8_urls": op8_urls,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "op11_conversations": op11_conversations,
    "op12_whitening": op12_whitening,
    "op13_secrets": op13_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op1_lines": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS no
            FROM documents WHERE text IS NOT NULL
        ), firsts AS (
            SELECT line, min((doc_id, no)) AS place, length(line) AS n FROM lines WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY line
        ), long AS (SELECT * FROM firsts WHERE n >= 16),
        near AS (
            SELECT a.line FROM long a JOIN long b ON a.n = b.n AND left(a.line, a.n // 2) = left(b.line, b.n // 2) AND b.place < a.place
            WHERE len(list_filter(list_zip(string_split(a.line, ''), string_split(b.line, '')), lambda x: x[1] <> x[2])) <= 1
            UNION
            SELECT a.line FROM long a JOIN long b ON a.n = b.n AND right(a.line, a.n - a.n // 2) = right(b.line, b.n - b.n // 2) AND b.place < a.place
            WHERE len(list_filter(list_zip(string_split(a.line, ''), string_split(b.line, '')), lambda x: x[1] <> x[2])) <= 1
            UNION
            SELECT CASE WHEN s.place < l.place THEN l.line ELSE s.line END FROM long s JOIN long l
                ON l.n = s.n + 1 AND left(l.line, s.n // 2) = left(s.line, s.n // 2)
            WHERE len(list_filter(generate_series(0, s.n), lambda p: left(l.line, p) = left(s.line, p) AND substr(l.line, p + 2) = substr(s.line, p + 1))) > 0
            UNION
            SELECT CASE WHEN s.place < l.place THEN l.line ELSE s.line END FROM long s JOIN long l
                ON l.n = s.n + 1 AND right(l.line, s.n - s.n // 2) = right(s.line, s.n - s.n // 2)
            WHERE len(list_filter(generate_series(0, s.n), lambda p: left(l.line, p) = left(s.line, p) AND substr(l.line, p + 2) = substr(s.line, p + 1))) > 0
        ), kept AS (
            SELECT doc_id, no, l.line FROM lines l LEFT JOIN firsts f USING (line)
            WHERE f.line IS NULL OR (f.place = (doc_id, no) AND NOT EXISTS (SELECT 1 FROM near WHERE near.line = l.line))
        ), joined AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY no) AS text FROM kept GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
            CAST(coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(j.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(j.text, '')) AS kept_sha256
        FROM documents d LEFT JOIN joined j USING (doc_id)
    """,
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op6_decontaminate": r"""
        WITH low AS (
            SELECT doc_id, CAST(NULL AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, true AS is_doc FROM documents
            UNION ALL
            SELECT NULL, CAST(item_id AS VARCHAR), regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), false FROM benchmark
        ), items AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(generate_series(1, greatest(len(w) - 9, 1)),
                lambda i: array_to_string(w[i:i + 9], ' '))) AS win
            FROM low WHERE NOT is_doc AND len(w) > 0
        ), docs AS (SELECT doc_id, coalesce(w, []) AS w FROM low WHERE is_doc),
        places AS (
            SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS i,
                unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
            FROM docs, (SELECT DISTINCT n FROM items) WHERE len(w) >= n
        ), hits AS (SELECT doc_id, i, places.n, item_id FROM places JOIN items ON places.win = items.win AND places.n = items.n),
        covered AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
        ), named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
        d AS (SELECT page_id, payload_bytes, sha1(html) AS payload_digest FROM p),
        k AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN keeper <> page_id THEN keeper END AS refers_to
        FROM d LEFT JOIN k ON d.payload_digest = k.payload_digest AND payload_bytes >= 1000
    """,
    "op8_urls": r"""
        WITH cut AS (
            SELECT page_id, coalesce(html, '') AS html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
        ), rows AS (
            SELECT page_id, html, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts
        ), named AS (
            SELECT *, string_split(host, '.') AS l FROM rows
        ), ends AS (
            SELECT *, array_to_string(l[greatest(1, len(l) - 1):], '.') AS two, array_to_string(l[greatest(1, len(l) - 2):], '.') AS three,
                2 * length(html) AS wide, length(html) - length(replace(html, '!!', '')) AS shouts FROM named
        ), units AS (
            SELECT page_id, host, path, CASE WHEN long THEN three ELSE two END AS domain, CASE WHEN long THEN two ELSE l[len(l)] END AS suffix,
                regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)') OR (shouts > 0 AND shouts * 100 >= wide) AS bad
            FROM (SELECT *, two IN ('co.uk', 'org.uk', 'com.au', 'co.jp', 'com.br', 'co.in', 'co.nz', 'co.za') AS long FROM ends)
        ), hosts AS (
            SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*) AS n, count(*) FILTER (bad) AS bad
            FROM units WHERE host <> '' GROUP BY host
        ), whole AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1)::DOUBLE AS rate FROM hosts),
        s0 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, (SELECT rate FROM whole) AS prior FROM hosts GROUP BY suffix),
        sk AS (SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 10.0::DOUBLE ELSE 1 / least(0.99::DOUBLE, greatest(0.001::DOUBLE,
            (sum(n * (bad / n - prior) * (bad / n - prior) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)))) - 1 END AS k FROM s0),
        s1 AS (SELECT suffix, bad + k * prior AS a, n - bad + k * (1 - prior) AS b FROM s0, sk),
        d0 AS (SELECT domain, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(a / (a + b)) AS prior FROM hosts JOIN s1 USING (suffix) GROUP BY domain),
        dk AS (SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 10.0::DOUBLE ELSE 1 / least(0.99::DOUBLE, greatest(0.001::DOUBLE,
            (sum(n * (bad / n - prior) * (bad / n - prior) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)))) - 1 END AS k FROM d0),
        d1 AS (SELECT domain, bad + k * prior AS a, n - bad + k * (1 - prior) AS b FROM d0, dk),
        h0 AS (SELECT host, n::DOUBLE AS n, bad::DOUBLE AS bad, a / (a + b) AS prior FROM hosts JOIN d1 USING (domain)),
        hk AS (SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 10.0::DOUBLE ELSE 1 / least(0.99::DOUBLE, greatest(0.001::DOUBLE,
            (sum(n * (bad / n - prior) * (bad / n - prior) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)))) - 1 END AS k FROM h0),
        h1 AS (SELECT host, bad + k * prior AS a, n - bad + k * (1 - prior) AS b FROM h0, hk),
        judged AS (
            SELECT u.page_id, u.host, u.path, coalesce(h1.a, d1.a, s1.a, rate) AS a, coalesce(h1.b, d1.b, s1.b, 1 - rate) AS b
            FROM units u, whole LEFT JOIN h1 ON h1.host = u.host LEFT JOIN d1 ON d1.domain = u.domain LEFT JOIN s1 ON s1.suffix = u.suffix
        ), bound AS (
            SELECT *, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS low FROM judged
        )
        SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
            WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END END AS verdict
        FROM (SELECT *, CASE
            WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM bound)
    """,
}
