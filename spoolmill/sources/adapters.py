"""Session files of two tools: lenient JSON lines with different envelopes, made into sessions.

Lines are (file, line_no, line). An adapter turns them into events (file, line_no, session_id, cwd, ts,
role, raw), one for every line that is a JSON object; ``role`` and ``raw`` are null where it is no
message. Blank, malformed and other lines give none. A field that should be a string counts only if it
is a JSON string, a list of blocks only if all of them are objects. ``ts`` is in whole epoch seconds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import segments
from ..functions import text as T
from ..functions.arrays import settle

_ISO = "^\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:?\\d\\d)$"
SESSION = "file string, parse_status string, tool string, session_id string, project string, started_at long, last_active_at long, messages array<struct<turn:int,speaker:string,role:string,text:string>>"


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def string(v: Column, path: str) -> Column:
    """The field at ``path`` if it is a JSON string."""
    return F.when(_is(F.try_variant_get(v, path, "variant"), "STRING"), F.try_variant_get(v, path, "string"))


def blocks_text(content: Column, kinds: tuple[str, ...], fold: Callable[[Column], Column] = lambda x: x) -> Column:
    """The texts of a list's blocks of the given types, joined by an empty line; null if there are none."""
    items = F.try_variant_get(content, "$", "array<variant>")
    texts = F.filter(F.transform(items, lambda b: F.when(fold(string(b, "$.type")).isin(*kinds), string(b, "$.text"))), lambda x: x.isNotNull())
    return F.when(F.forall(items, lambda b: _is(b, "OBJECT")) & (F.size(texts) > 0), F.array_join(texts, "\n\n"))


def seconds(iso: Column) -> Column:
    return F.when(iso.rlike(_ISO), F.unix_seconds(F.try_to_timestamp(iso)))


def _objects(lines: DataFrame) -> DataFrame:
    v = lines.select("file", "line_no", F.try_parse_json(F.trim("line")).alias("v"))
    return v.where(_is(F.col("v"), "OBJECT"))


def flat_events(lines: DataFrame) -> DataFrame:
    """The flat envelope: ids and folder on every line, the message under ``message``. A user's content
    may be a string or a list of blocks, an assistant's a list only."""
    v = F.col("v")
    content = F.try_variant_get(v, "$.message.content", "variant")
    kind = string(v, "$.type")
    raw = F.when(kind == "user", F.coalesce(string(v, "$.message.content"), blocks_text(content, ("text",)))).when(kind == "assistant", blocks_text(content, ("text",)))
    return _objects(lines).select("file", "line_no", string(v, "$.sessionId").alias("session_id"), string(v, "$.cwd").alias("cwd"), seconds(string(v, "$.timestamp")).alias("ts"), F.when(raw.isNotNull(), kind).alias("role"), raw.alias("raw"))


def wrapped_events(lines: DataFrame) -> DataFrame:
    """The wrapped envelope: what counts lies under ``item``, else under ``payload`` with the type beside
    it, else in the line itself. Ids and folder come from the session's own line; content may be a
    string or a list for either role."""
    v = F.col("v")
    item, payload = (F.try_variant_get(v, p, "variant") for p in ("$.item", "$.payload"))
    nested, beside = _is(item, "OBJECT"), _is(payload, "OBJECT") & string(v, "$.type").isNotNull()
    inner = F.when(nested, item).when(beside, payload).otherwise(v)
    kind = F.lower(F.when(nested, string(item, "$.type")).otherwise(string(v, "$.type")))
    rows = _objects(lines).select("file", "line_no", seconds(string(v, "$.timestamp")).alias("ts"), inner.alias("i"), kind.alias("kind"))
    i, meta = F.col("i"), F.col("kind").isin("session_meta", "sessionmeta")
    content = F.coalesce(string(i, "$.content"), blocks_text(F.try_variant_get(i, "$.content", "variant"), ("input_text", "output_text", "text"), F.lower))
    role = string(i, "$.role")
    said = F.col("kind").isin("message", "responseitem", "response_item") & role.isin("user", "assistant")
    raw = F.when(said, content)
    return rows.select("file", "line_no", F.when(meta, string(i, "$.id")).alias("session_id"), F.when(meta, string(i, "$.cwd")).alias("cwd"), "ts", F.when(raw.isNotNull(), role).alias("role"), raw.alias("raw"))


@dataclass(frozen=True)
class Adapter:
    """A tool's session files: their names, which folders below the root hold them (None: any), a prefix
    of the name that is not part of the id, and the envelope."""

    tool: str
    pattern: str
    depth: int | None
    prefix: str
    events: Callable[[DataFrame], DataFrame]


ADAPTERS = {a.tool: a for a in (Adapter("claude-code", "*.jsonl", 2, "", flat_events), Adapter("codex", "rollout-*.jsonl", None, "rollout-", wrapped_events))}


def messages(events: DataFrame, clean: Callable[[Column], Column] | None = segments.clean) -> DataFrame:
    """(file, line_no, role, ts, text): messages that are not blank once cleaned."""
    text = F.col("raw") if clean is None else clean(F.col("raw"))
    # contents are read once from a line, and texts are cleaned once
    said = settle(events.where("role IS NOT NULL").select("file", "line_no", "role", "ts", "raw"), "raw")
    out = settle(said.select("file", "line_no", "role", "ts", text.alias("text")), "text")
    return out.where(F.col("text").rlike("[^\\p{Z}\\s]"))


def stem(file: Column, prefix: str = "") -> Column:
    """A file's name without folders, last extension and ``prefix``: the id of sessions without one."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(file, "/", -1), "\\.[^.]*$", ""), f"^{prefix}" if prefix else "^$", "")


def sessions(lines: DataFrame, adapter: Adapter, clean: Callable[[Column], Column] | None = segments.clean) -> DataFrame:
    """One row (:data:`SESSION`) for each file that has a line. ``parse_status`` is ``ok``, ``empty`` (blank
    lines only), ``no_messages`` or ``undecodable`` (null lines only); where it isn't ``ok`` the rest is null. Bounds cover all lines with a time,
    messages or not; without any they are 0. The first id counts, and the first folder with a name."""
    events = adapter.events(lines)
    said = messages(events, clean)
    base = F.nullif(F.regexp_extract("cwd", "([^/]+)/*$", 1), F.lit(""))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_no")))
    about = events.groupBy("file").agg(F.min("ts").alias("from"), F.max("ts").alias("to"), first(F.col("session_id")).alias("id"), first(base).alias("project"))
    item = F.struct(F.col("line_no").cast("int").alias("turn"), F.when(F.col("role") == "assistant", adapter.tool).otherwise("user").alias("speaker"), "role", "text")
    each = said.groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("messages"))
    files = lines.groupBy("file").agg(F.bool_or(F.trim("line") != "").alias("inked"))
    out = files.join(each, "file", "left").join(about, "file", "left")
    ok = F.col("messages").isNotNull()
    status = F.when(ok, "ok").when(F.col("inked"), "no_messages").when(F.col("inked").isNull(), "undecodable").otherwise("empty")
    return out.select("file", status.alias("parse_status"), F.when(ok, adapter.tool).alias("tool"), F.when(ok, F.coalesce("id", stem(F.col("file"), adapter.prefix))).alias("session_id"), F.when(ok, F.col("project")).alias("project"), F.when(ok, F.coalesce("from", F.lit(0))).alias("started_at"), F.when(ok, F.coalesce("to", F.lit(0))).alias("last_active_at"), "messages")


def union(found: dict[str, DataFrame], enabled: tuple[str, ...] = tuple(ADAPTERS), clean: Callable[[Column], Column] | None = segments.clean) -> DataFrame:
    """The sessions of all enabled tools that have ``lines``."""
    return reduce(DataFrame.unionByName, [sessions(found[tool], ADAPTERS[tool], clean) for tool in found if tool in enabled])


def archive_path(tool: Column, started: Column, session: Column) -> Column:
    return F.concat(tool, F.lit("-"), F.date_format(F.timestamp_seconds(started), "yyyy-MM-dd"), F.lit("-"), T.sanitize(session), F.lit(".md"))
