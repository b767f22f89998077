"""The archive as snapshots: every change is a function from a DataFrame to the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def upsert(archive: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Rows of ``new`` replace those of their key and state, so that a live row leaves a trashed one of its path alone; a
    replaced row's star is kept. Of new rows with one key and state the latest counts, by ``last_active_at`` (null: earliest), then by all columns."""
    state = F.coalesce("state", F.lit("")) if "state" in archive.columns else F.lit("")
    order = F.struct(F.col("last_active_at").isNotNull().alias("known"), "last_active_at", *[F.col(c) for c in new.columns if c != "last_active_at"])
    one = new.withColumn("_state", state).groupBy(key, "_state").agg(F.max_by(F.struct(*new.columns), order).alias("_row"))
    new = one.select("_state", "_row.*")
    there = archive.withColumn("_state", state)
    old = there.groupBy(key, "_state").agg(F.bool_or("starred").alias("_old"))
    kept = new.join(old, [key, "_state"], "left").withColumn("starred", F.col("starred") | F.coalesce("_old", F.lit(False)))
    fresh = there.join(new.select(key, "_state"), [key, "_state"], "left_anti")
    return fresh.select(*archive.columns).unionByName(kept.drop("_old", "_state"))


def remove(archive: DataFrame, paths: DataFrame) -> DataFrame:
    return archive.join(paths.select("path"), "path", "left_anti")


def set_starred(archive: DataFrame, which: Column, starred: bool) -> DataFrame:
    return archive.withColumn("starred", F.when(which, F.lit(starred)).otherwise(F.col("starred")))


def _shift(archive: DataFrame, hit: Column, state: str, now: int, seed: int) -> DataFrame:
    """``archive`` with the rows ``hit`` brought to ``state``. Of the rows that would share a path there, the one that is there
    already keeps it, else the one active last; each other row gets a suffix of its own, from path, seed and place.

    Only rows that move are sorted, and only paths of those that are there already meet them."""
    hit = F.coalesce(hit & (F.col("state") != state), F.lit(False))
    going = archive.where(hit)
    taken = archive.where(F.col("state") == state).join(going.select("path"), "path", "left_semi").select("path").distinct().withColumn("_taken", F.lit(1))
    order = Window.partitionBy("path").orderBy(F.desc_nulls_last("last_active_at"), F.xxhash64(*archive.columns))
    placed = going.join(taken, "path", "left").withColumn("_place", F.row_number().over(order) + F.coalesce("_taken", F.lit(0)))
    suffix = F.lower(F.lpad(F.hex(F.xxhash64("path", F.lit(seed), F.lit(now), "_place")), 16, "0"))
    at = F.lit(now).cast("long") if state == "trash" else F.lit(None).cast("long")
    moved = placed.withColumns({"path": F.when(F.col("_place") == 1, F.col("path")).otherwise(_with_suffix(suffix)), "trashed_at": at, "state": F.lit(state)})
    return archive.where(~hit).unionByName(moved.select(*archive.columns))


def _with_suffix(suffix: Column) -> Column:
    """The path with ``suffix`` before its extension."""
    return F.concat(F.regexp_replace("path", "\\.[^./]*$", ""), F.lit("-"), suffix, F.regexp_extract("path", "(\\.[^./]*)?$", 0))


def trash(archive: DataFrame, which: Column, now: int, seed: int = 0) -> DataFrame:
    """The live rows ``which`` in the trash since ``now``; a path that is taken there gets a suffix."""
    return _shift(archive, which & (F.col("state") == "live"), "trash", now, seed)


def untrash(archive: DataFrame, which: Column, now: int = 0, seed: int = 0) -> DataFrame:
    """The trashed rows ``which`` back among the live ones; a path that is taken there gets a suffix."""
    return _shift(archive, which & (F.col("state") == "trash"), "live", now, seed)


def move(archive: DataFrame, paths: DataFrame, state: str, now: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Trash or restore many ``paths`` (path) at once: the archive afterwards, and (path, error) of those that no row could be
    moved for: ``missing``, or ``there`` if the path is only in ``state`` already. A path that is asked for twice is moved once; null paths are missing."""
    asked = paths.select("path").distinct()
    marked = archive.join(asked.withColumn("_asked", F.lit(True)), "path", "left")
    after = _shift(marked, F.coalesce("_asked", F.lit(False)), state, now, seed).drop("_asked").select(*archive.columns)
    known = archive.join(asked, "path", "left_semi").groupBy("path").agg(F.bool_or(F.col("state") != state).alias("_can"))
    error = F.when(F.col("_can").isNull(), "missing").otherwise("there")
    return after, asked.join(known, "path", "left").where(~F.coalesce("_can", F.lit(False))).select("path", error.alias("error"))


def purged(now: int, grace: int = 7) -> Column:
    """Whether a row has been in the trash for more than ``grace`` days; rows without a time or state stay."""
    return F.coalesce((F.col("state") == "trash") & (F.lit(now) - F.col("trashed_at") > grace * DAY), F.lit(False))


def _expired(archive: DataFrame, now: int, days: int | None, protected: DataFrame | None) -> DataFrame:
    """``archive`` with ``_due``, whether a live row is older than ``days``, not starred and not protected."""
    safe = archive if protected is None else archive.join(protected.select("path").distinct().withColumn("_safe", F.lit(True)), "path", "left")
    spared = F.lit(False) if protected is None else F.coalesce("_safe", F.lit(False))
    due = F.lit(False) if days is None else (F.lit(now) - F.col("last_active_at") > days * DAY) & ~F.col("starred") & ~spared & (F.col("state") == "live")
    return safe.select(*archive.columns, F.coalesce(due, F.lit(False)).alias("_due"))


def cleanup_lists(archive: DataFrame, now: int, days: int | None, grace: int = 7, protected: DataFrame | None = None) -> DataFrame:
    """(path, action): what :func:`cleanup` would trash and purge, by the paths before it."""
    marked = _expired(archive, now, days, protected)
    action = F.when(purged(now, grace), "purged").when(F.col("_due"), "trashed")
    return marked.select("path", action.alias("action")).where("action IS NOT NULL")


def load(archive: DataFrame, path: str) -> DataFrame:
    """The row of one path: a pushed-down filter."""
    return archive.where(F.col("path") == path)


def live(archive: DataFrame) -> DataFrame:
    """All records outside the trash, newest first."""
    return archive.where("state = 'live'").orderBy(F.desc("last_active_at"), "path")


def beside(archive: DataFrame, path: str) -> DataFrame:
    """(previous, next): the live records before and after ``path`` in the order of :func:`live`; at an end the record itself, and no
    row if it isn't live. One aggregation over the order's keys, nothing is sorted."""
    keys = archive.where("state = 'live'").select(F.struct(-F.coalesce("last_active_at", F.lit(-(2**62))), "path").alias("k"))
    here = keys.where(F.col("k.path") == path).select(F.col("k").alias("me")).limit(1)
    found = keys.join(F.broadcast(here)).groupBy("me").agg(F.max(F.when(F.col("k") < F.col("me"), F.col("k"))).alias("before"), F.min(F.when(F.col("k") > F.col("me"), F.col("k"))).alias("after"))
    return found.select(F.coalesce("before.path", "me.path").alias("previous"), F.coalesce("after.path", "me.path").alias("next"))


def record_key() -> Column:
    """The key by which a record is opened from a hit."""
    return F.concat_ws("|", "tool", F.col("started_at").cast("string"), "session_id")


def open_hits(hits: DataFrame, archive: DataFrame) -> DataFrame:
    """The live records of ``hits`` (path)."""
    return archive.where("state = 'live'").join(hits.select("path").distinct(), "path", "left_semi")


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the first by ``order``."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def move_to(archive: DataFrame, path: str, state: str, now: int, suffix: str) -> DataFrame:
    """Trash or restore one path. A missing path is an error; if the path is taken in the state it goes
    to, ``suffix`` is put before its extension."""
    there = archive.where((F.col("path") == path) & (F.col("state") != state))
    if there.isEmpty():
        raise KeyError(path)
    taken = not archive.where((F.col("path") == path) & (F.col("state") == state)).isEmpty()
    hit = (F.col("path") == path) & (F.col("state") != state)
    name = _with_suffix(F.lit(suffix)) if taken else F.col("path")
    at = F.lit(now).cast("long") if state == "trash" else F.lit(None).cast("long")
    return archive.withColumns({"path": F.when(hit, name).otherwise(F.col("path")), "trashed_at": F.when(hit, at).otherwise(F.col("trashed_at")), "state": F.when(hit, F.lit(state)).otherwise(F.col("state"))})


def sync_counts(plan: DataFrame) -> DataFrame:
    """(added, updated): files of a sync plan that are new, and those that were known before."""
    return plan.agg(F.count_if(F.col("status") == "new").alias("added"), F.count_if(F.col("status") == "changed").alias("updated"))


def cleanup(archive: DataFrame, now: int, days: int | None, grace: int = 7, protected: DataFrame | None = None) -> DataFrame:
    """Expire, then purge, over one snapshot: a row trashed now is not purged in the same pass."""
    kept = _expired(archive, now, days, protected).where(~purged(now, grace))
    return (kept if days is None else trash(kept, F.col("_due"), now)).drop("_due")


def plan_sync(listing: DataFrame, state: DataFrame, now: float, *, settle: float = 0.5, limit: int = 50 * 1024 * 1024, key: tuple[str, ...] = ("path",)) -> DataFrame:
    """(key, length, mtime, status): settling, unchanged, oversize, new or changed."""
    old = state.select(*key, F.col("length").alias("_length"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_known"))
    j = listing.join(old, list(key), "left")
    same = F.col("_length").eqNullSafe(F.col("length")) & F.col("_mtime").eqNullSafe(F.col("mtime"))
    status = F.when(F.lit(now) - F.col("mtime") < settle, "settling").when(same, "unchanged").when(F.col("length") > limit, "oversize").when(F.col("_known"), "changed").otherwise("new")
    return j.select(*key, "length", "mtime", status.alias("status"))


def prune(state: DataFrame, listing: DataFrame) -> DataFrame:
    """State of files that still exist; the archive is not touched."""
    return state.join(listing.select("path"), "path", "left_semi")
