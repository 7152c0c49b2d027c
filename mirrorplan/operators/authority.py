"""What a run may trust and therefore delete: listings, modes, owners, guards.

Guards are data: each returns a row per account, and plans are cut down by joins, so one bad account
never stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clips import owner_gate
from .select import dedupe_first


def any_true(x: Column) -> Column:
    return F.coalesce(F.bool_or(x), F.lit(False))


def all_true(x: Column) -> Column:
    """Whether all are true; false for no rows at all."""
    return F.coalesce(F.bool_and(x), F.lit(False))


def area_status(areas: DataFrame, area_clips: DataFrame, force_copy: bool = False) -> DataFrame:
    """Areas with authoritative, n_clips, final mode and fully_enumerated."""
    counts = area_clips.groupBy("account_id", "area_ord").agg(F.count("*").alias("n_clips"))
    mode = F.lit("copy") if force_copy else F.col("mode")
    authoritative = F.col("complete") & ~F.col("any_filtered") & ~F.col("narrowed")
    rows = areas.join(counts, ["account_id", "area_ord"], "left").withColumns({"n_clips": F.coalesce("n_clips", F.lit(0)), "mode": mode, "authoritative": authoritative})
    return rows.withColumn("fully_enumerated", F.col("authoritative") & ~((F.col("n_clips") == 0) & (F.col("mode") == "mirror")))


def deletion_allowed(accounts: DataFrame, statuses: DataFrame) -> DataFrame:
    """(account_id, can_delete): every source fully enumerated and one of them a mirror; none at all: false."""
    gate = statuses.groupBy("account_id").agg((all_true(F.col("fully_enumerated")) & any_true(F.col("mode") == "mirror")).alias("can_delete"))
    return accounts.select("account_id").join(gate, "account_id", "left").select("account_id", F.coalesce("can_delete", F.lit(False)).alias("can_delete"))


def run_authority(accounts: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per account: can_delete, library_authoritative, adoption_enumerated, playlists_enumerated, may_narrow."""
    listed = F.col("fully_enumerated")
    rows = statuses.groupBy("account_id").agg(
        (all_true(listed) & any_true(F.col("mode") == "mirror")).alias("can_delete"),
        any_true((F.col("kind") == "library") & listed).alias("library_authoritative"),
        F.coalesce(F.bool_and(F.when(F.col("kind").isin("playlist", "liked"), listed)), F.lit(True)).alias("playlists_enumerated"),
    )
    rows = accounts.select("account_id").join(rows, "account_id", "left")
    flag = lambda name, other=False: F.coalesce(name, F.lit(other))
    rows = rows.select(
        "account_id", flag("can_delete").alias("can_delete"), flag("library_authoritative").alias("library_authoritative"), flag("playlists_enumerated", True).alias("playlists_enumerated")
    )
    return rows.withColumns(
        {"adoption_enumerated": F.col("library_authoritative") | F.col("can_delete"), "may_narrow": ~F.col("can_delete") & ~F.col("library_authoritative")}
    )


def modes_by_clip(areas: DataFrame, area_clips: DataFrame, force_copy: bool = False) -> DataFrame:
    """(account_id, clip_id, modes): which modes hold the clip, mirror before copy."""
    mode = F.lit("copy") if force_copy else F.col("mode")
    rows = area_clips.join(areas.select("account_id", "area_ord", mode.alias("_mode")), ["account_id", "area_ord"])
    has = lambda m: F.when(F.bool_or(F.col("_mode") == m), F.lit(m))
    return rows.groupBy("account_id", "clip_id").agg(F.array_compact(F.array(has("mirror"), has("copy"))).alias("modes"))


def union_areas(area_clips: DataFrame) -> DataFrame:
    """Rows of all areas, of each clip the first by area and position."""
    return dedupe_first(area_clips, ["account_id", "clip_id"], ["area_ord", "pos"])


def area_overrides(playlists: DataFrame, overrides: DataFrame, default: str = "mirror") -> DataFrame:
    """Playlists with their mode: the override by id, else the group's default."""
    return playlists.join(overrides.select("account_id", "playlist_id", F.col("mode").alias("_mode")), ["account_id", "playlist_id"], "left").withColumn(
        "mode", F.coalesce("_mode", F.lit(default))
    ).drop("_mode")


def adoption(accounts: DataFrame, listed: DataFrame, owned: DataFrame) -> DataFrame:
    """(account_id, enumerated, allow_change) -> with decision: whether files already there belong to the account."""
    n_owned = owned.select("account_id", "clip_id").distinct().groupBy("account_id").agg(F.count("*").alias("_owned"))
    both = owned.select("account_id", "clip_id").join(listed.select("account_id", "clip_id"), ["account_id", "clip_id"], "left_semi")
    n_both = both.groupBy("account_id").agg(F.count("*").alias("_both"))
    decision = (
        F.when(F.col("_owned").isNull(), "pin_fresh")
        .when(~F.col("enumerated"), "skip_pin")
        .when(F.col("_both").isNotNull(), "pin_adopt")
        .when(F.col("allow_change"), "adopt_forced")
        .otherwise("abort")
    )
    return accounts.join(n_owned, "account_id", "left").join(n_both, "account_id", "left").select("account_id", decision.alias("decision"))


def update_pins(pins: DataFrame, accounts: DataFrame) -> DataFrame:
    """Next (account_id, user_id, display_name): pinned on first use or repin, name refreshed, others as they were."""
    rows = accounts.join(pins.withColumnsRenamed({"user_id": "pinned_id", "display_name": "_old_name"}), "account_id", "full_outer")
    gate = owner_gate(F.coalesce("allow_change", F.lit(False)))
    take = F.coalesce(F.col("authed_id").isNotNull() & gate.isin("first_use", "proceed", "repin"), F.lit(False))
    rows = rows.select("account_id", F.when(take, F.col("authed_id")).otherwise(F.col("pinned_id")).alias("user_id"), F.when(take, F.col("display_name")).otherwise(F.col("_old_name")).alias("display_name"))
    return rows.where("user_id is not null")


def resolve_areas(accounts: DataFrame, asked: DataFrame, configured: DataFrame, force_copy: bool = False) -> DataFrame:
    """The areas of a run: (account_id, kind, area_id, mode, unfiltered, protector).

    What a run asks for (liked, playlist rows; copy where no mode is given) replaces the configured areas,
    and those replace the whole library in the account's verb_mode. 'off' rows are dropped. If an area
    mirrors and the library is neither listed nor switched off, a copy of the whole library is added that
    protects what the account still lists. force_copy turns all areas to copy first.
    """
    one = lambda df: df.select("account_id").distinct()
    from_run = asked.select("account_id", "kind", "area_id", F.coalesce("mode", F.lit("copy")).alias("mode"), F.lit(False).alias("unfiltered"))
    from_config = configured.join(one(asked), "account_id", "left_anti").select("account_id", "kind", "area_id", "mode", (F.col("kind") == "library").alias("unfiltered"))
    rest = accounts.join(one(asked).union(one(configured)).distinct(), "account_id", "left_anti")
    plain = rest.select("account_id", F.lit("library").alias("kind"), F.lit("").alias("area_id"), F.col("verb_mode").alias("mode"), F.lit(False).alias("unfiltered"))
    rows = from_run.unionByName(from_config).unionByName(plain)
    if force_copy:
        rows = rows.withColumn("mode", F.when(F.col("mode") == "off", "off").otherwise("copy"))
    needs = rows.groupBy("account_id").agg(any_true(F.col("mode") == "mirror").alias("armed"), any_true(F.col("kind") == "library").alias("library"))
    added = needs.where("armed and not library").select(
        "account_id", F.lit("library").alias("kind"), F.lit("").alias("area_id"), F.lit("copy").alias("mode"), F.lit(True).alias("unfiltered"), F.lit(True).alias("protector")
    )
    return rows.where("mode <> 'off'").withColumn("protector", F.lit(False)).unionByName(added)
