"""Line dedup by deletion neighbourhoods, with DataFrame functions alone.

A line repeats an earlier one if the two are equal, or, both having at least min_chars characters, are
within one edit (a character put in, left out or changed). Of such lines the earliest is kept: a line
goes if any line that stands earlier (smaller doc_id, then earlier in the text) repeats it, judged on
the input. Blank lines stay.

Lines within one edit become equal when the edited place is deleted. Deleting every single character
of every line would be as many variants as characters, so the neighbourhood is taken coarse to fine:
lines are keyed by what is left when one half is deleted; only lines that share such a key with another
line go on, to be keyed without one block of about sqrt(length) characters; and only within blocks of
lines that share that key too are the variants of every single character emitted. Each step keeps
every pair within one edit, so the result is that of the full neighbourhood. Each key is aggregated
to the earliest line of its group, never to pairs; the distance to that line is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._state import materialise

MIN_CHARS = 16
#: Shared keys that may be broadcast (16 MB); more are joined by shuffles of keys and places.
BROADCAST_KEYS = 1 << 20
_FIRST = -(1 << 63)  # a null doc_id stands before all others


def _key_columns() -> dict[str, Column]:
    """Order key of a document row: doc_id, then a hash of its text where rows repeat a doc_id."""
    return {"_line_doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_FIRST)), "_line_text": F.xxhash64("text")}


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> lines that are not blank: did, th, line_no, line, two hashes and the length."""
    keys = _key_columns()
    return (
        docs.where("text is not null")
        .select(keys["_line_doc"].alias("did"), keys["_line_text"].alias("th"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .where(F.col("line").rlike(r"\S"))
        .withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), "line"), "n": F.length("line")})
    )


def _half_keys(lines: DataFrame, min_chars: int) -> DataFrame:
    """Each line once for each half left out, in the classes of its length and of one character less."""
    keys = []
    for less in (0, 1):
        c = f"(n - {less})"
        half = f"(({c} + 1) div 2)"
        for i, rest in ((0, f"right(line, cast({c} - {half} as int))"), (1, f"left(line, cast({half} as int))")):
            keys.append(f"if({c} >= {min_chars}, xxhash64({c}, {i}, {rest}), null)")
    exploded = lines.where(F.col("n") >= min_chars).withColumn("key", F.explode(F.expr(f"array({', '.join(keys)})")))
    return exploded.where("key is not null")


def _shared(keyed: DataFrame, *keys: str) -> DataFrame:
    """Keys that at least two distinct lines have."""
    return keyed.groupBy(*keys).agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select(*keys)


def _candidates(docs: DataFrame, min_chars: int) -> DataFrame:
    """Distinct lines that share a half with another one: h1, h2, n, line, place of the first occurrence."""
    keyed = _half_keys(split_lines(docs), min_chars)
    shared = materialise(_shared(keyed, "key"), "halves")
    if shared.count() <= BROADCAST_KEYS:
        lines = keyed.join(F.broadcast(shared), "key", "left_semi")
    else:
        places = keyed.select("key", "did", "th", "line_no").join(shared, "key", "left_semi").groupBy("did", "th")
        wanted = places.agg(F.collect_set("line_no").alias("wanted"))
        keys = _key_columns()
        texts = docs.select("doc_id", "text", keys["_line_doc"].alias("did"), keys["_line_text"].alias("th")).join(wanted, ["did", "th"])
        lines = texts.select("did", "th", F.explode("wanted").alias("line_no"), F.split("text", "\n").alias("all")).select(
            "did", "th", "line_no", F.expr("get(all, line_no)").alias("line")
        )
        lines = lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), "line"), "n": F.length("line")})
    return lines.groupBy("h1", "h2", "n", "line").agg(F.min(F.struct("did", "th", "line_no")).alias("place"))


def _without_block(lines: DataFrame, min_chars: int) -> DataFrame:
    """Each line once for each block left out (k1, k2: the rest; mid: the block), by class c."""
    c = f"filter(array(n, n - 1), c -> c >= {min_chars})"
    block = "cast(greatest(16, ceil(sqrt(c))) as int)"
    return (
        lines.withColumn("c", F.explode(F.expr(c)))
        .withColumn("b", F.expr(block))
        .withColumn("i", F.explode(F.expr("sequence(0, cast((c - 1) div b as int))")))
        .withColumns({"head": F.expr("left(line, i * b)"), "tail": F.expr("right(line, greatest(0, c - (i + 1) * b))")})
        .withColumns({"k1": F.xxhash64("c", "i", "head", "tail"), "k2": F.xxhash64(F.lit("second"), "c", "i", "head", "tail")})
        .withColumn("mid", F.expr("substring(line, length(head) + 1, n - length(head) - length(tail))"))
        .select("h1", "h2", "n", "c", "k1", "k2", "mid", "place")
    )


def near_repeats(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct lines (h1, h2) of which an earlier line is exactly one edit away."""
    blocks = _without_block(materialise(_candidates(docs, min_chars), "lines"), min_chars)
    blocks = materialise(blocks.join(_shared(blocks, "k1", "k2"), ["k1", "k2"], "left_semi"), "blocks")
    # A line one longer than its class (d) meets the line of the class that it is when one character is
    # deleted (m); two lines of the class meet when the same place of both is deleted (s).
    size = F.length("mid")
    cut = "concat(left(mid, j), substring(mid, j + 2))"
    variant = F.when(
        F.col("n") > F.col("c"), F.expr(f"transform(sequence(0, length(mid) - 1), j -> struct('d' as role, 0 as at, {cut} as v))")
    ).otherwise(
        F.expr(
            f"concat(array(struct('m' as role, 0 as at, mid as v)), if(length(mid) > 0,"
            f" transform(sequence(0, greatest(0, length(mid) - 1)), j -> struct('s' as role, j + 1 as at, {cut} as v)), array()))"
        )
    )
    rows = blocks.where(size > 0).select("k1", "k2", "h1", "h2", "place", F.explode(variant).alias("x")).select(
        "k1", "k2", "h1", "h2", "place", "x.role", F.xxhash64("x.at", "x.v").alias("v1"), F.xxhash64(F.lit("second"), "x.at", "x.v").alias("v2")
    )
    key = ["k1", "k2", "v1", "v2"]
    longer = F.col("role") == "d"
    firsts = rows.groupBy(*key).agg(F.min(F.when(longer, F.col("place"))).alias("of_d"), F.min(F.when(~longer, F.col("place"))).alias("of_rest"))
    other = F.when(F.col("role") == "m", F.col("of_d")).otherwise(F.col("of_rest"))
    found = rows.join(firsts, key).withColumn("earlier", other).where("earlier < place").select("k1", "k2", "place", "earlier").distinct()
    mine = blocks.select("k1", "k2", "place", "h1", "h2", F.col("mid").alias("a"))
    theirs = blocks.select("k1", "k2", F.col("place").alias("earlier"), F.col("mid").alias("b"))
    verified = found.join(mine, ["k1", "k2", "place"]).join(theirs, ["k1", "k2", "earlier"])
    return verified.where(F.levenshtein("a", "b", 1) == 1).select("h1", "h2").distinct()


def kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(did, th, kept): the numbers of the lines that stay, blank ones aside, for documents with any."""
    first = split_lines(docs).groupBy("h1", "h2").agg(F.min(F.struct("did", "th", "line_no")).alias("place"))
    left = first.join(near_repeats(docs, min_chars), ["h1", "h2"], "left_anti").select("place.*")
    return left.groupBy("did", "th").agg(F.collect_list("line_no").alias("kept"))


def _stay(text: str) -> Column:
    blank = r"filter(sequence(0, size(_line_all) - 1), i -> not (_line_all[i] rlike '\\S'))"
    return F.expr(f"if({text} is null, array(), array_sort(array_union(coalesce(_line_kept, array()), {blank})))")


def dedup_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_lines, n_removed, kept_sha256), one row per row of docs.

    Lines end at '\\n' and are compared as they are. A null text has no line and the hash of ''. Rows
    that repeat a doc_id are ordered by a hash of their texts; rows that repeat both tie, and none of
    them counts as earlier. A null doc_id stands before all others. An empty table gives no row.
    """
    rows = _dedup(docs.select("doc_id", "text"), min_chars)
    return rows.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_line_all")).cast("bigint").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_line_all") - F.size("_line_stay")).cast("bigint").alias("n_removed"),
        F.sha2(F.coalesce("_line_new", F.lit("")), 256).alias("kept_sha256"),
    )


def _dedup(docs: DataFrame, min_chars: int) -> DataFrame:
    keys = _key_columns()
    kept = kept_lines(docs.select("doc_id", "text"), min_chars).withColumnsRenamed({"did": "_line_doc", "th": "_line_text", "kept": "_line_kept"})
    rows = docs.withColumns(keys).join(kept, ["_line_doc", "_line_text"], "left").withColumn("_line_all", F.split("text", "\n"))
    rows = rows.withColumn("_line_stay", _stay("text"))
    new = F.expr("if(text is null, null, array_join(transform(_line_stay, i -> _line_all[i]), '\n'))")
    return rows.withColumn("_line_new", new)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with repeated lines taken out of text; all columns stay.

    A document that had lines and loses them all goes; blank and null texts stay as they are.
    """
    rows = _dedup(docs, min_chars).where(r"text is null or not (text rlike '\\S') or _line_new rlike '\\S'")
    return rows.select(*(F.col("_line_new").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))
