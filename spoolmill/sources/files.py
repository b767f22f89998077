"""The archive as markdown files: one for each record, trashed ones below ``_trash``.

Files lie flat in one folder, under the records' paths, as readers of single files expect. The sink writes each file to a name of
its own below ``_parts`` and renames it, so that a reader sees the file before or after, never half of it; what killed or
repeated tasks leave there is removed at the end of a save. A file that already holds the same bytes is left alone.
The folder may be a local path or the URI of any file system that Arrow knows; all executors must reach it.

Defined results: of records with one path and state the one active last is written (ties: the greater text). A null, empty or hidden name,
one with a slash, over 255 bytes or without ``.md`` is not written, but has the outcome ``bad_name``. Other columns are not
written. Null messages are none, null times 0, a null star is false. An empty table writes nothing. Only executors touch contents; the folder is listed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tables
from . import bridge

OUTCOMES = "path string, state string, bytes long, outcome string"
TRASH, PARTS = "_trash", "_parts"
MESSAGES = "array<struct<turn:int,speaker:string,role:string,text:string>>"


def _folder(root: str):
    """The file system of ``root`` and the path in it."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


def _replace(system, part: str, name: str) -> None:
    """Rename ``part`` to ``name``, also where the file system doesn't rename onto an existing file."""
    try:
        system.move(part, name)
    except OSError:
        system.delete_file(name)
        system.move(part, name)


def _same(system, name: str, data: bytes) -> bool:
    if system.get_file_info(name).size != len(data):
        return False
    with system.open_input_stream(name) as f:
        return f.read() == data


def _put(root: str, mark: str):
    """Write (path, state, md): one outcome for each, ``written``, ``same`` or ``failed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _folder(root)
        for batch in batches:
            out = []
            for path, state, md in zip(*(batch.column(i) for i in range(3)), strict=True):
                path, state, data = path.as_py(), state.as_py(), md.as_py().encode("utf-8", "replace")
                name, part = f"{at}/{TRASH}/{path}" if state == "trash" else f"{at}/{path}", f"{at}/{PARTS}/{mark}/{uuid4().hex}"
                try:
                    outcome = "same" if _same(system, name, data) else "written"
                    if outcome == "written":
                        with system.open_output_stream(part) as f:
                            f.write(data)
                        _replace(system, part, name)
                except OSError:
                    outcome = "failed"
                out.append((path, state, len(data), outcome))
            if out:
                yield _outcomes(out)

    return run


def _take_away(root: str):
    """Delete (path, state): ``removed``, ``missing`` or ``failed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _folder(root)
        for batch in batches:
            out = []
            for path, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    system.delete_file(f"{at}/{TRASH}/{path}" if state == "trash" else f"{at}/{path}")
                    outcome = "removed"
                except FileNotFoundError:
                    outcome = "missing"
                except OSError:
                    outcome = "failed"
                out.append((path, state, 0, outcome))
            if out:
                yield _outcomes(out)

    return run


def _outcomes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "state", "bytes", "outcome"])


def _done(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back."""
    path = tables.fresh(df.sparkSession, "outcomes")
    df.write.parquet(path)
    return df.sparkSession.read.schema(OUTCOMES).parquet(path)


def good_name(path: Column) -> Column:
    bad = path.isNull() | ~path.rlike("\\A[^._/][^/\\x00]*\\.md\\z") | (F.octet_length(path) > 255)
    return ~bad


def _encoded(records: DataFrame) -> Column:
    """Markdown, with the time of arrival in the header of what is in the trash."""
    when = F.date_format(F.timestamp_seconds("trashed_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = F.concat(F.lit("---\ntrashed_at: "), when, F.lit("\n"))
    md = bridge.markdown(records)
    return F.when((F.col("state") == "trash") & when.isNotNull(), F.concat(header, F.substring(md, 5, 2**31 - 1))).otherwise(md)


def save(records: DataFrame, root: str) -> DataFrame:
    """Write ``records`` (path, state, trashed_at and the fields of the markdown form) as files; (path, state, bytes, outcome)."""
    mark = uuid4().hex
    system, at = _folder(root)
    for sub in (TRASH, f"{PARTS}/{mark}"):
        system.create_dir(f"{at}/{sub}", recursive=True)
    state = F.when(F.col("state") == "trash", "trash").otherwise("live").alias("state")
    none = F.array().cast(records.schema["messages"].dataType)
    told = {"messages": F.coalesce("messages", none), "starred": F.coalesce("starred", F.lit(False)), "started_at": F.coalesce("started_at", F.lit(0)), "last_active_at": F.coalesce("last_active_at", F.lit(0))}
    whole = records.withColumns(told)
    each = whole.select("path", state, "last_active_at", _encoded(whole).alias("md"))
    one = each.where(good_name(F.col("path"))).groupBy("path", "state").agg(F.max_by("md", F.struct("last_active_at", "md")).alias("md"))
    bad = each.where(~good_name(F.col("path"))).select("path", "state", F.lit(0).cast("long").alias("bytes"), F.lit("bad_name").alias("outcome"))
    try:
        return _done(one.mapInArrow(_put(root, mark), OUTCOMES).unionByName(bad))
    finally:
        system.delete_dir(f"{at}/{PARTS}/{mark}")


def discard(names: DataFrame, root: str) -> DataFrame:
    """Delete the files of ``names`` (path, state); (path, state, bytes, outcome). Names that could not be a file's are ``missing``."""
    state = F.when(F.col("state") == "trash", "trash").otherwise("live").alias("state")
    each = names.select("path", state).distinct()
    none = each.where(~good_name(F.col("path"))).select("path", "state", F.lit(0).cast("long").alias("bytes"), F.lit("missing").alias("outcome"))
    return _done(each.where(good_name(F.col("path"))).mapInArrow(_take_away(root), OUTCOMES).unionByName(none))


def mirror(records: DataFrame, root: str) -> DataFrame:
    """:func:`save`, then delete the files that no record has; files that aren't markdown stay. The outcomes of both."""
    saved = save(records, root)
    there = listing(records.sparkSession, root).select("path", "state")
    return saved.unionByName(discard(there.join(saved.select("path", "state"), ["path", "state"], "left_anti"), root))


def listing(spark: SparkSession, root: str, contents: bool = False) -> DataFrame:
    """(path, state, mtime) of the markdown files of the archive and of its trash; with ``contents`` also those. Folders and hidden
    files in it are left out."""
    def of(folder: str, state: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
        name = F.substring_index("path", "/", -1)
        mtime = F.unix_seconds("modificationTime").alias("mtime")
        return files.select(name.alias("path"), F.lit(state).alias("state"), mtime, *(["content"] if contents else []))

    live, trash = (of(root.rstrip("/") + below, state) for below, state in (("", "live"), (f"/{TRASH}", "trash")))
    return live.unionByName(trash)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The records of the files below ``root``, with ``status``: ok, undecodable (not UTF-8) or what the decoder says; fields that
    can't be told are null. A trashed file without a time of arrival arrived when it was written."""
    content = F.col("content").cast("string")
    files = listing(spark, root, contents=True).withColumn("md", F.when(F.is_valid_utf8(content), content)).drop("content")
    d = files.withColumn("d", F.explode(F.array(bridge.from_markdown(F.col("md")))))
    f = lambda k: F.col("d.fields")[k]
    at = lambda k: F.unix_seconds(F.try_to_timestamp(f(k)))
    key = F.create_map(*[F.lit(x) for k, v in bridge.LABELS.items() for x in (v, k)])
    role = lambda s: F.when(s.isin("user", "system"), s).otherwise("assistant")
    messages = F.transform("d.messages", lambda m, i: F.struct(i.alias("turn"), key[m["label"]].alias("speaker"), role(key[m["label"]]).alias("role"), m["text"].alias("text"))).cast(MESSAGES)
    said = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["text"]
    status = F.when(F.col("md").isNull(), "undecodable").otherwise(F.col("d.status"))
    arrived = F.when(F.col("state") == "trash", F.coalesce(at("trashed_at"), F.col("mtime")))
    rows = d.select("path", "state", status.alias("status"), f("tool").alias("tool"), f("session_id").alias("session_id"), f("project").alias("project"), at("started_at").alias("started_at"), at("last_active_at").alias("last_active_at"), (f("starred") == "true").alias("starred"), messages.alias("messages"), arrived.alias("trashed_at"))
    return rows.withColumn("title", F.when(F.col("status") == "ok", T.title(said)))


def load(spark: SparkSession, root: str) -> DataFrame:
    """The live records whose files can be decoded, newest first."""
    return scan(spark, root).where("state = 'live' AND status = 'ok'").drop("status").orderBy(F.desc("last_active_at"), "path")
