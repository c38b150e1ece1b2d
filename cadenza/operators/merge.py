"""Keyed merges of snapshots: each takes the old and the new rows and gives the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str], if_given: list[str] = (), if_missing: list[str] = ()) -> DataFrame:
    """Column rules on a match: overwrite takes the new value, if_given only a non-null one, if_missing only where the old is null."""
    o = old.select(*keys, *(F.col(c).alias(f"o_{c}") for c in old.columns if c not in keys), F.lit(True).alias("o_any"))
    n = new.select(*keys, *(F.col(c).alias(f"n_{c}") for c in new.columns if c not in keys), F.lit(True).alias("n_any"))
    both = o.join(n, keys, "full")
    out = list(map(F.col, keys))
    for c in (c for c in old.columns if c not in keys):
        if c in overwrite:
            v = F.when(F.col("n_any"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
        elif c in if_given:
            v = F.coalesce(f"n_{c}", f"o_{c}")
        elif c in if_missing:
            v = F.coalesce(f"o_{c}", f"n_{c}")
        else:
            v = F.when(F.col("o_any"), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}") if c in new.columns else F.lit(None))
        out.append(v.alias(c))
    return both.select(*out)


def sync_members(old: DataFrame, snapshot: DataFrame, synced: DataFrame, now: str) -> DataFrame:
    """Membership with tombstones. old: playlist_id, track_id, removed_at (text); snapshot: the present members of the playlists in
    `synced`. Present ones have removed_at null, absent ones that were active get `now`; other playlists stay as they are."""
    o = old.withColumn("was", F.lit(True))
    s = snapshot.select("playlist_id", "track_id").distinct().withColumn("here", F.lit(True))
    both = o.join(s, ["playlist_id", "track_id"], "full").join(synced.select("playlist_id").distinct().withColumn("due", F.lit(True)), "playlist_id", "left")
    removed = F.when(F.col("due").isNull(), F.col("removed_at")).when(F.col("here"), F.lit(None)).otherwise(F.coalesce("removed_at", F.lit(now)))
    return both.select("playlist_id", "track_id", removed.alias("removed_at"))


def sync_plan(now: DataFrame, was: DataFrame, fresh_hours: float = 23) -> DataFrame:
    """State of every playlist seen now (playlist_id, n) or stored (playlist_id, n, status, hours since its last sync), and whether to sync
    it: active, of another size than stored, and not synced within fresh_hours. A playlist that was never stored is new and excluded."""
    both = now.select("playlist_id", F.col("n").alias("n1")).join(was.select("playlist_id", F.col("n").alias("n0"), F.col("status").alias("given"), "hours"), "playlist_id", "full")
    status = F.coalesce("given", F.lit("excluded"))
    changed = ~F.col("n1").eqNullSafe(F.col("n0"))
    state = F.when(F.col("n1").isNull(), "archived").when(F.col("n0").isNull(), "new").when(status == "excluded", "excluded").when(changed, "stale").otherwise("current")
    due = F.col("n1").isNotNull() & (status == "active") & changed & F.coalesce(F.col("hours") >= fresh_hours, F.lit(True))
    return both.select("playlist_id", status.alias("status"), state.alias("state"), due.alias("needs_sync"))


def within_budget(rows: DataFrame, size: str, key: str, budget: int) -> DataFrame:
    """Rows, smallest first (ties by key), as long as their sizes sum to at most the budget. A row larger than the budget can't be among
    them, nor can any after the budget's count of non-empty ones, so only the least rows of each partition reach the running sum."""
    least = rows.filter(F.col(size) <= budget).orderBy(size, key).limit(budget)
    running = F.sum(size).over(Window.orderBy(size, key).rowsBetween(Window.unboundedPreceding, 0))
    return least.withColumn("__running", running).filter(F.col("__running") <= budget).drop("__running")
