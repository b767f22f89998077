"""Incremental ingest: a manifest comparison in each micro-batch of a ticking stream.

A file stream doesn't emit a changed file again, so the stream only ticks; each batch lists the roots of all tools once,
compares sizes and times with the manifest, and parses new and changed files whole. No path passes through the driver.
Contents are read with bounds on time and size that Spark checks before it opens a file, and the plan then picks its files.

Every file has an outcome in the manifest: ``ok``, ``empty``, ``no_messages``, ``undecodable`` and ``oversize`` advance it, so that
the file is left alone until it changes; a file that was planned but couldn't be read is ``failed``, counts its attempts and is planned
again by the next pass. A pass that fails as a whole commits nothing; doing it again is harmless. The commits (:mod:`.log`)
let passes and :func:`retain` run side by side.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import store
from ..sources import adapters as A
from . import log

MANIFEST = "tool string, path string, length long, mtime double, outcome string, attempts int"
#: Planned files that are broadcast to pick contents; more are joined by a shuffle.
PICKED = 500_000


def listing(spark: SparkSession, root: str, pattern: str = "*.jsonl", depth: int | None = None) -> DataFrame:
    """(path, length, mtime) without reading contents. Hidden files and folders and those of sub-agents are
    left out; with ``depth`` only files so many levels below ``root`` count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    below = F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/")
    found = files.select("path", "length", (F.unix_micros("modificationTime").cast("double") / 1e6).alias("mtime"), below.alias("_below"))
    kept = found.where(~F.col("path").contains("/subagents/") & ~F.exists("_below", lambda x: x.startswith(".")))
    return (kept if depth is None else kept.where(F.size("_below") == depth)).drop("_below")


def lines(files: DataFrame) -> DataFrame:
    """(file, line_no, line) of (path, content); a file that isn't UTF-8 has one line, null."""
    text = F.col("content").cast("string")
    return files.select(F.col("path").alias("file"), F.posexplode_outer(F.split(F.when(F.is_valid_utf8(text), text), "\n")).alias("line_no", "line"))


def contents(spark: SparkSession, root: str, pattern: str, plan: DataFrame) -> DataFrame:
    """(path, content) of the planned files (path, length, mtime) below ``root``. Files that are gone or can't be read are left out."""
    low, high, small, large, n = plan.agg(F.min("mtime"), F.max("mtime"), F.min("length"), F.max("length"), F.count("*")).first()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(root)
    if not n:
        return files.select("path", "content").limit(0)
    at = lambda s, by: F.lit(s * 1e6 + by).cast("long")
    near = (F.col("modificationTime") >= F.timestamp_micros(at(low, -1000))) & (F.col("modificationTime") <= F.timestamp_micros(at(high, 1000))) & (F.col("length") >= small) & (F.col("length") <= large)
    wanted = plan.select("path")
    return files.where(near).select("path", "content").join(F.broadcast(wanted) if n <= PICKED else wanted, "path", "left_semi")


def every(spark: SparkSession, run: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 240, once: bool = False) -> StreamingQuery:
    """Call ``run`` on each tick, one at a time."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def rows_of(parsed: DataFrame, seen: DataFrame) -> DataFrame:
    """Archive rows of ``parsed`` sessions that have messages; of files with one name in the archive the latest
    counts. ``seen`` has the files' path and mtime."""
    r = parsed.where("parse_status = 'ok'").join(seen.select(F.col("path").alias("file"), "mtime"), "file")
    asked = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["text"]
    rows = r.select(
        A.archive_path(F.col("tool"), F.col("started_at"), F.col("session_id")).alias("path"), "tool", "session_id", "started_at", "last_active_at", F.lit(False).alias("starred"), T.title(asked).alias("title"), "messages",
        F.col("file").alias("source"), F.lit("live").alias("state"), F.lit(None).cast("long").alias("trashed_at"), "mtime",
    )
    one = rows.groupBy("path").agg(F.max_by(F.struct(*rows.columns), F.struct("mtime", "source")).alias("r"))
    return one.select("r.*").drop("mtime")


def archive(spark: SparkSession, home: str) -> DataFrame:
    """The archive as last committed."""
    return log.archive(spark, home)


def manifest(spark: SparkSession, home: str, at: log.Commit | None = None) -> DataFrame:
    at = at or log.read(spark, home)
    return spark.read.schema(MANIFEST).parquet(f"{home}/manifest/{at.manifest}") if at.manifest else spark.createDataFrame([], MANIFEST)


def sync(spark: SparkSession, roots: dict[str, str], home: str, now: float | None = None, enabled: tuple[str, ...] | None = None) -> int:
    """One pass over the ``roots`` of tools; returns the committed version, which is a new one if files came, changed or
    went. Files of tools that aren't ``enabled`` are not read, but leave the manifest when they are gone."""
    return log.again(lambda: _pass(spark, roots, home, time.time() if now is None else now, tuple(roots) if enabled is None else enabled))


def _pass(spark: SparkSession, roots: dict[str, str], home: str, now: float, enabled: tuple[str, ...]) -> int:
    at, name = log.read(spark, home), uuid4().hex
    state = manifest(spark, home, at)

    def written(df: DataFrame, table: str, to: str = name) -> DataFrame:
        df.write.parquet(f"{home}/{table}/{to}")
        return spark.read.schema(df.schema).parquet(f"{home}/{table}/{to}")

    listed = [listing(spark, root, A.ADAPTERS[t].pattern, A.ADAPTERS[t].depth).select(F.lit(t).alias("tool"), "path", "length", "mtime") for t, root in roots.items()]
    known = state.where("length IS NOT NULL")
    plan = written(store.plan_sync(reduce(DataFrame.unionByName, listed), known, now, key=("tool", "path")), "plan")  # files are listed once
    mine = plan.where(F.col("tool").isin(*enabled))
    todo = mine.where("status IN ('new', 'changed')")
    gone = state.where(F.col("tool").isin(*roots)).join(plan, ["tool", "path"], "left_anti")
    if todo.isEmpty() and mine.where("status = 'oversize'").isEmpty() and gone.isEmpty():
        return at.version
    read = [A.sessions(lines(contents(spark, roots[t], A.ADAPTERS[t].pattern, todo.where(F.col("tool") == t))), A.ADAPTERS[t]).withColumn("of", F.lit(t)) for t in roots if t in enabled]
    parsed = written(reduce(DataFrame.unionByName, read), "parsed") if read else None
    commit = replace(at, version=at.version + 1)
    outcomes = todo.select("tool", "path").withColumn("outcome", F.lit("failed"))
    if parsed is not None:
        told = parsed.select(F.col("of").alias("tool"), F.col("file").alias("path"), "parse_status")
        outcomes = todo.select("tool", "path").join(told, ["tool", "path"], "left").select("tool", "path", F.coalesce("parse_status", F.lit("failed")).alias("outcome"))
        new = rows_of(parsed, todo.select("path", "mtime").distinct())
        touched = [r.b for r in new.select(log.bucket(F.col("path")).alias("b")).distinct().collect()]  # at most BUCKETS
        if touched:
            commit = log.rewritten(spark, home, at, store.upsert(log.archive(spark, home, at, touched), new), touched)
    # failed files keep what was known of them; what was not looked at stays as it was
    before = state.select("tool", "path", F.col("length").alias("_length"), F.col("mtime").alias("_mtime"), F.col("attempts").alias("_attempts"))
    failed = F.col("outcome") == "failed"
    done = mine.where("status IN ('new', 'changed', 'oversize')").join(outcomes, ["tool", "path"], "left").withColumn("outcome", F.coalesce("outcome", "status")).join(before, ["tool", "path"], "left")
    done = done.select("tool", "path", F.when(failed, F.col("_length")).otherwise(F.col("length")).alias("length"), F.when(failed, F.col("_mtime")).otherwise(F.col("mtime")).alias("mtime"), "outcome", F.when(failed, F.coalesce("_attempts", F.lit(0)) + 1).otherwise(0).alias("attempts"))
    stay = state.join(done, ["tool", "path"], "left_anti").join(gone.select("tool", "path"), ["tool", "path"], "left_anti")
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    written(done.select(*names).unionByName(stay.select(*names)), "manifest")
    return log.commit(spark, home, replace(commit, manifest=name))


def retain(spark: SparkSession, home: str, days: int | None, now: int | None = None, grace: int = 7, protected: DataFrame | None = None) -> int:
    """One pass of retention: expire and purge; only buckets that change are written. Returns the committed version."""

    def run() -> int:
        at, when = log.read(spark, home), int(time.time()) if now is None else now
        there = log.archive(spark, home, at)
        lists = store.cleanup_lists(there, when, days, grace, protected)
        # a row that is trashed under a path taken there gets another one, which may lie in another bucket
        came = store.cleanup(there, when, days, grace, protected).where((F.col("state") == "trash") & (F.col("trashed_at") == when)).select("path")
        touched = [r.b for r in lists.select("path").unionByName(came).select(log.bucket(F.col("path")).alias("b")).distinct().collect()]  # at most BUCKETS
        if not touched:
            return at.version
        kept = store.cleanup(log.archive(spark, home, at, touched), when, days, grace, protected)
        return log.commit(spark, home, log.rewritten(spark, home, at, kept, touched))

    return log.again(run)


def ingest(spark: SparkSession, roots: dict[str, str], home: str, checkpoint: str, seconds: int = 240, once: bool = False) -> StreamingQuery:
    """A pass on each tick."""
    return every(spark, lambda ticks, _: sync(ticks.sparkSession, roots, home), checkpoint, seconds, once)


def retaining(spark: SparkSession, home: str, checkpoint: str, days: int | None, seconds: int = 86400, once: bool = False) -> StreamingQuery:
    """A pass of retention each day, beside the ingest."""
    return every(spark, lambda ticks, _: retain(ticks.sparkSession, home, days), checkpoint, seconds, once)
