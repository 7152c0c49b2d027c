"""Which clips a run takes: first occurrences, recency, limits, track numbers, references by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clips import parse_created, strip
from ..functions.naming import canonical_path_key
from ..tables import written


def dedupe_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key by an explicit order; rows whose last key is null or '' are dropped."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.where((F.col(keys[-1]) != "")).withColumn("_at", at).where("_at = 1").drop("_at")


def select_clips(clips: DataFrame, limit: int | None = None, since: int | str | None = None, min_newest: int = 1, now: int = 0, last_run: DataFrame | None = None) -> DataFrame:
    """Clips (with ord) of each account that the run takes, first occurrences only.

    since: seconds back from now, or 'last-run' (stamps from last_run (account_id, last_run); an account
    without one has no threshold). Clips without a usable date are kept. Under a threshold at least
    min_newest of the newest stay. limit keeps the newest; ties go to the smaller ord.
    """
    rows = dedupe_first(clips, ["account_id", "clip_id"], ["ord"]).withColumn("_ts", parse_created("created_at"))
    if since == "last-run":
        rows = rows.join(last_run.select("account_id", F.col("last_run").alias("_from")), "account_id", "left")
    else:
        rows = rows.withColumn("_from", F.lit(None if since is None else max(0, now - since)).cast("bigint"))
    newest = Window.partitionBy("account_id").orderBy(F.coalesce("_ts", F.lit(0)).desc(), "ord")
    passes = F.col("_from").isNull() | F.col("_ts").isNull() | (F.col("_ts") > F.col("_from"))
    rows = rows.withColumn("_keep", passes)
    kept = rows.where("_keep")
    if since is not None and min_newest > 0:
        # counts per account first; a rank with a fixed bound keeps few rows of each account
        short = rows.groupBy("account_id").agg(F.count_if("_keep").alias("_kept")).where(F.col("_kept") < min_newest).select("account_id")
        few = rows.join(short, "account_id", "left_semi").where("_from is not null").withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= min_newest)
        kept = kept.unionByName(few.where("not _keep").drop("_rank"))
    if limit is not None:
        size = F.when(F.col("_from").isNotNull(), max(limit, min_newest)).otherwise(limit)
        kept = kept.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= max(limit, min_newest)).where(F.col("_rank") <= size).drop("_rank")
    return kept.drop("_ts", "_from", "_keep")


def assign_track_numbers(clips: DataFrame, leads: DataFrame, number_singletons: bool = False) -> DataFrame:
    """(account_id, clip_id, root_id, created_at) -> (account_id, clip_id, track, total).

    Numbered by date and id within the root; the earliest lead of a root comes first.
    """
    root = F.when(F.col("root_id") == "", F.col("clip_id")).otherwise(F.coalesce("root_id", "clip_id"))
    rows = clips.select("account_id", "clip_id", "created_at", root.alias("_root"))
    rows = rows.join(leads.select("account_id", "clip_id", F.lit(True).alias("_lead")).distinct(), ["account_id", "clip_id"], "left")
    group = Window.partitionBy("account_id", "_root")
    rows = rows.withColumns({"_n": F.row_number().over(group.orderBy("created_at", "clip_id")), "total": F.count("*").over(group).cast("int")})
    rows = rows.withColumn("_first", F.min(F.when(F.col("_lead"), F.col("_n"))).over(group))
    track = F.when(F.col("_n") == F.col("_first"), 1).when(F.col("_n") < F.col("_first"), F.col("_n") + 1).otherwise(F.col("_n"))
    rows = rows if number_singletons else rows.where("total > 1")
    return rows.select("account_id", "clip_id", track.cast("int").alias("track"), "total")


def resolve_leads(clips: DataFrame, wanted: DataFrame) -> DataFrame:
    """(account_id, entry) -> (account_id, entry, outcome, clip_id): ids by a prefix, case aside, that only one clip has.

    Prefixes are looked up by hash: clips are keyed by their prefixes of the lengths that the account asks
    for, so the join stays an equi-join.
    """
    asked = wanted.select("account_id", strip("entry").alias("entry")).where("entry <> ''").distinct()
    sizes = asked.groupBy("account_id").agg(F.collect_set(F.length("entry")).alias("sizes"))
    keyed = clips.select("account_id", "clip_id").distinct().join(sizes, "account_id").withColumn("size", F.explode("sizes"))
    keyed = keyed.where(F.length("clip_id") >= F.col("size")).withColumn("key", F.lower(F.left("clip_id", F.col("size"))))
    found = keyed.groupBy("account_id", "key").agg(F.count("*").alias("n"), F.min("clip_id").alias("clip_id"))
    rows = asked.withColumn("key", F.lower("entry")).join(found, ["account_id", "key"], "left")
    outcome = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return rows.select("account_id", "entry", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("clip_id")).alias("clip_id"))


def resolve_playlist_refs(refs: DataFrame, playlists: DataFrame) -> DataFrame:
    """(account_id, ref) -> (account_id, ref, outcome, playlist_id): by id, else by exact name, else by name
    with ASCII case aside; several at the first tier that has any are ambiguous."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    keys = F.array(
        F.struct(F.lit(1).alias("tier"), F.col("playlist_id").alias("key")),
        F.struct(F.lit(2).alias("tier"), F.col("name").alias("key")),
        F.struct(F.lit(3).alias("tier"), F.translate("name", upper, lower).alias("key")),
    )
    named = playlists.select("account_id", "playlist_id", F.explode(keys).alias("k")).select("account_id", "playlist_id", "k.tier", "k.key")
    named = named.groupBy("account_id", "tier", "key").agg(F.count("*").alias("n"), F.min("playlist_id").alias("playlist_id"))
    asks = F.array(*(F.struct(F.lit(t).alias("tier"), (F.translate("ref", upper, lower) if t == 3 else F.col("ref")).alias("key")) for t in (1, 2, 3)))
    asked = refs.select("account_id", "ref").distinct().withColumn("k", F.explode(asks)).select("account_id", "ref", "k.tier", "k.key")
    rows = asked.join(named, ["account_id", "tier", "key"], "left")
    best = rows.groupBy("account_id", "ref").agg(F.min_by(F.struct("n", "playlist_id", "tier"), F.when(F.col("n").isNotNull(), F.col("tier"))).alias("b"))
    one = (F.col("b.n") == 1) | (F.col("b.tier") == 1)
    outcome = F.when(F.col("b.n").isNull(), "not found").when(one, "resolved").otherwise("ambiguous")
    return best.select("account_id", "ref", outcome.alias("outcome"), F.when(F.coalesce(one, F.lit(False)), F.col("b.playlist_id")).alias("playlist_id"))


def _stepped(so_far: Column, part: Column, absolute: Column) -> Column:
    """The components with one more taken in, as text alone says: '..' takes one back, above the top of an absolute root it is nothing."""
    can_pop = (F.size(so_far) > 0) & (F.coalesce(F.try_element_at(so_far, F.lit(-1)), F.lit("..")) != "..")
    back = F.when(can_pop, F.slice(so_far, F.lit(1), F.greatest(F.size(so_far) - 1, F.lit(0)))).when(absolute, so_far).otherwise(F.array_append(so_far, F.lit("..")))
    return F.when(part.isin("", "."), so_far).when(part == "..", back).otherwise(F.array_append(so_far, part))


def root_parts(root: str | Column) -> Column:
    """Components of a destination after '.', '..' and repeated separators, '/' first if it is absolute; case and composition folded."""
    root = F.col(root) if isinstance(root, str) else root
    absolute = F.startswith(root, F.lit("/"))
    parts = F.aggregate(F.split(root, "/"), F.array().cast("array<string>"), lambda so_far, part: _stepped(so_far, part, absolute))
    folded = F.split(canonical_path_key(F.array_join(parts, "/")), "/")
    return F.concat(F.when(absolute, F.array(F.lit("/"))).otherwise(F.array().cast("array<string>")), F.filter(folded, lambda p: p != ""))


def _above(parts: str) -> Column:
    """The keys of all components' beginnings, from none to all."""
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def overlapping_roots(accounts: DataFrame, chunk: int = 1024) -> DataFrame:
    """(account_id, root) -> (account_a, account_b): destinations that are one folder or lie in one another, component-wise.

    The accounts of each folder, and those below it, are put together in chunks of about `chunk` ids, and chunks are joined, so
    that what is shuffled grows with the accounts; pairs are made last, in even shares, and are not shuffled again. Only
    those of accounts with several roots can come twice, and are made distinct. Where many accounts may share a root,
    root_conflicts() says as much without pairs.
    """
    rows = accounts.select("account_id", root_parts("root").alias("parts")).withColumn("at", F.array_join("parts", "/")).where("at is not null").dropDuplicates(["account_id", "at"])
    several = rows.groupBy("account_id").agg((F.count("*") > 1).alias("several"))
    rows = written(rows.join(several, "account_id"), "folders")
    here = _chunked(rows, chunk)
    below = _chunked(rows.withColumn("at", F.explode(F.array_except(_above("parts"), F.array("at")))), chunk)
    side = lambda df, k: df.select("at", *(F.col(c).alias(f"{c}_{k}") for c in ("several", "block", "ids")))
    own = (F.col("block_a") == F.col("block_b")) & (F.col("several_a") == F.col("several_b"))
    same = side(here, "a").join(side(here, "b"), "at").where(F.struct("several_a", "block_a") <= F.struct("several_b", "block_b")).withColumn("own", own)
    met = same.unionByName(side(here, "a").join(side(below, "b"), "at").withColumn("own", F.lit(False)))
    once = _pairs_of(met.where("not several_a and not several_b"))
    return once.unionByName(_pairs_of(met.where("several_a or several_b")).distinct())


def _chunked(rows: DataFrame, chunk: int) -> DataFrame:
    """(at, several, block, ids): the accounts of each folder in lists of about `chunk`."""
    blocks = rows.groupBy("at", "several").agg(F.ceil(F.count("*") / chunk).alias("_n"))
    dealt = rows.select("at", "several", "account_id").join(blocks, ["at", "several"]).withColumn("block", F.pmod(F.xxhash64("account_id"), "_n"))
    return dealt.groupBy("at", "several", "block").agg(F.collect_list("account_id").alias("ids"))


def _pairs_of(met: DataFrame) -> DataFrame:
    """The pairs of accounts of chunks that meet; of a chunk with itself each once."""
    shares = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = met.select("own", "ids_a", "ids_b").repartition(shares).select("own", "ids_b", F.explode("ids_a").alias("x")).select("own", "x", F.explode("ids_b").alias("y"))
    rows = rows.where("x < y or not own and x <> y")
    return rows.select(F.least("x", "y").alias("account_a"), F.greatest("x", "y").alias("account_b"))


def root_conflicts(accounts: DataFrame) -> DataFrame:
    """(account_id, root) -> (account_id, n_same, n_above, n_below, example) of accounts whose root another one shares, holds or lies in.

    Counts per folder are joined, never pairs: a folder that all accounts share gives one row each. example: the
    smallest other account at the same folder, else above it, else below it. One row per account is expected.
    """
    rows = accounts.select("account_id", root_parts("root").alias("parts")).withColumn("at", F.array_join("parts", "/"))
    here = rows.groupBy("at").agg(F.count("*").alias("n"), F.min("account_id").alias("least"), F.any_value("parts").alias("parts"))
    beyond = here.select("n", "least", "at", F.explode(F.array_except(_above("parts"), F.array("at"))).alias("up"))
    below = beyond.groupBy(F.col("up").alias("at")).agg(F.sum("n").alias("n_below"), F.min("least").alias("least_below"))
    above = beyond.join(here.select(F.col("at").alias("up"), F.col("n").alias("_n"), F.col("least").alias("_least")), "up").groupBy("at").agg(F.sum("_n").alias("n_above"), F.min("_least").alias("least_above"))
    folders = here.drop("parts").join(above, "at", "left").join(below, "at", "left").na.fill(0, ["n_above", "n_below"]).where("n > 1 or n_above > 0 or n_below > 0")
    # the smallest other account at the folder: the least one's is the next, found among the others
    found = rows.select("account_id", "at").join(folders, "at")
    second = found.where("account_id <> least").groupBy("at").agg(F.min("account_id").alias("second"))
    same = F.when(F.col("n") > 1, F.when(F.col("account_id") == F.col("least"), F.col("second")).otherwise(F.col("least")))
    return found.join(second, "at", "left").select("account_id", (F.col("n") - 1).alias("n_same"), "n_above", "n_below", F.coalesce(same, "least_above", "least_below").alias("example"))


def label_prefixes(labels: DataFrame) -> DataFrame:
    """(label) -> (label, prefix, n): account labels that end up with the same environment prefix (ASCII capitals, '-' as '_'), and how many do."""
    upper = F.translate("label", "abcdefghijklmnopqrstuvwxyz-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ_")
    rows = labels.select("label", upper.alias("prefix")).distinct()
    return rows.join(rows.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"), "prefix").select("label", "prefix", "n")


def layered_settings(layers: DataFrame, keys: list[str], ranges: dict[str, tuple[int, int]] | None = None, never_blank: tuple[str, ...] = ("naming_template",)) -> DataFrame:
    """(account_id, tier, key, value) -> one row per account, each key's value of the lowest tier that has one.

    `invalid` lists keys whose value is no integer within its range, and keys of never_blank that any tier, also one that
    does not decide, sets to white space.
    """
    of = lambda k: F.col("key") == k
    blank = [k for k in keys if k in never_blank]
    rows = layers.where(F.col("value").isNotNull()).groupBy("account_id").agg(
        *(F.min_by("value", F.when(of(k), F.col("tier"))).alias(k) for k in keys), *(F.bool_or(of(k) & (strip("value") == "")).alias(f"_blank_{k}") for k in blank)
    )
    bad = [
        F.when(F.col(k).isNotNull() & ~F.coalesce(F.expr(f"try_cast(`{k}` AS bigint)").between(lo, hi), F.lit(False)), F.lit(k))
        for k, (lo, hi) in (ranges or {}).items()
    ]
    bad += [F.when(F.col(f"_blank_{k}"), F.lit(k)) for k in blank]
    return rows.withColumn("invalid", F.concat_ws(",", *bad) if bad else F.lit("")).drop(*(f"_blank_{k}" for k in blank))
