"""Sessions from the driver's tables: conversations become messages and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.arrays import let

#: Archived tools and the labels of speakers (fixed values).
TOOLS = ("claude-code", "codex", "gemini", "cursor")
LABELS = {"claude-code": "Claude Code", "codex": "Codex", "gemini": "Gemini", "cursor": "Cursor", "user": "User", "system": "System"}
GUIDE = "请读取这个文件了解之前的上下文（仅作参考，读完等我指示）："
START, NOW = 1704067200, 1704067200 + 200 * 21600


def label(key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[key]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text, tool, speaker, ts): ts in epoch seconds."""
    m = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tool = F.element_at(F.array(*map(F.lit, TOOLS)), (F.col("conv_id") % 4 + 1).cast("int"))
    ts = F.lit(START) + F.col("conv_id") * 21600 + F.col("turn") * 60
    return m.select("conv_id", "turn", "role", "text", tool.alias("tool"), F.when(F.col("role") == "assistant", tool).otherwise(F.col("role")).alias("speaker"), ts.alias("ts"))


def to_records(m: DataFrame) -> DataFrame:
    """One row per session; its messages, ordered by turn, meet in one row."""
    item = F.struct("turn", "speaker", "role", "text")
    r = m.groupBy("conv_id", "tool").agg(F.array_sort(F.collect_list(item)).alias("messages"), F.min("ts").alias("started_at"), F.max("ts").alias("last_active_at"))
    said = F.get(F.filter("messages", lambda x: x["role"] == "user"), F.lit(0))["text"]
    session = F.concat(F.lit("conv-"), F.col("conv_id"))
    return r.select(
        F.concat("tool", F.lit("-"), F.date_format(F.timestamp_seconds("started_at"), "yyyy-MM-dd"), F.lit("-"), text.sanitize(session), F.lit(".md")).alias("path"),
        "tool", session.alias("session_id"), F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("proj"), F.col("conv_id") % 7)).alias("project"),
        "started_at", "last_active_at", (F.col("conv_id") % 6 == 0).alias("starred"), text.title(said).alias("title"), "messages", "conv_id",
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_records(messages(spark, sf_dir))


def labelled(m: Column) -> Column:
    return F.concat(label(m["speaker"]), F.lit("：\n"), m["text"])


def body(ms: Column) -> Column:
    """Labelled messages joined by an empty line; also the feed's text and what is indexed."""
    return F.array_join(F.transform(ms, labelled), "\n\n")


def copy_out(ms: Column) -> Column:
    return F.array_join(F.transform(ms, lambda m: m["text"]), "\n\n")


def markdown(r: DataFrame) -> Column:
    """The archive's export form: a header of fields, then labelled messages."""
    iso = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = [F.lit("---"), F.concat(F.lit("tool: "), "tool"), F.concat(F.lit("session_id: "), "session_id"), F.concat(F.lit("project: "), "project"), F.concat(F.lit("started_at: "), iso("started_at")), F.concat(F.lit("last_active_at: "), iso("last_active_at")), F.concat(F.lit("starred: "), F.col("starred").cast("string")), F.lit("---\n\n")]
    return F.concat(F.concat_ws("\n", *head), F.array_join(F.transform("messages", lambda m: F.concat(labelled(m), F.lit("\n\n"))), ""))


#: A label that older archives have for the user (fixed value).
OLD_LABELS = {"你": "User"}


def from_markdown(md: Column) -> Column:
    """Header ``fields`` as a map (of repeated keys the last counts), the body's ``messages`` (label, text) and
    ``status``: ok, malformed_frontmatter, unknown_tool or malformed_body (text before the first label). Null is malformed_frontmatter.
    A line that is a label and a full-width colon opens a message; empty lines at a message's end go.
    The places of labels are found first and each message is one slice of the lines, so time is linear in the text."""
    current = [*((v, v) for v in LABELS.values()), *OLD_LABELS.items()]
    label_line = "^(" + "|".join(k for k, _ in current) + ")：$"
    named = F.create_map(*[F.lit(x) for kv in current for x in kv])

    def latest(pairs: Column) -> Column:
        """Of pairs that are sorted by key and place the last of each key, by place."""
        last = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i + 1)["k"] != p["k"], F.lit(True)))
        placed = F.array_sort(F.transform(last, lambda p: F.struct(p["n"].alias("n"), p["k"].alias("k"), p["v"].alias("v"))))
        return F.map_from_entries(F.transform(placed, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))))

    def parts(ls: Column) -> Column:
        close = F.array_position(F.slice(ls, 2, F.size(ls)), "---").cast("int")
        head = F.filter(F.slice(ls, 2, F.greatest(close - 1, F.lit(0))), lambda x: x.contains(":"))
        pairs = F.transform(head, lambda x, n: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), n.alias("n"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
        body = F.slice(ls, close + 2, F.size(ls))
        return let(F.struct((F.get(ls, F.lit(0)) == "---").alias("opened"), close.alias("close"), let(F.array_sort(pairs), latest).alias("fields"), body.alias("body")), places)

    def places(h: Column) -> Column:
        opens = F.filter(F.transform(h["body"], lambda x, i: F.when(x.rlike(label_line), i)), lambda i: i.isNotNull())
        return let(opens, lambda at: finish(h, h["body"], at))

    def finish(h: Column, body: Column, at: Column) -> Column:
        fields = h["fields"]

        def message(i: Column, k: Column) -> Column:
            end = F.coalesce(F.get(at, k + 1), F.size(body))
            said = F.array_join(F.slice(body, i + 2, end - i - 1), "\n")
            return F.struct(F.element_at(named, F.regexp_extract(F.get(body, i), label_line, 1)).alias("label"), F.rtrim(said, F.lit("\n")).alias("text"))

        early = F.exists(F.slice(body, 1, F.coalesce(F.get(at, F.lit(0)), F.size(body))), lambda x: F.trim(x) != "")
        iso = "^\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(Z|[+-]\\d\\d:?\\d\\d)$"
        dated = lambda k: F.coalesce(fields[k].rlike(iso), F.lit(False))
        broken = ~F.coalesce(h["opened"], F.lit(False)) | (h["close"] == 0) | fields["tool"].isNull()
        poor = fields["session_id"].isNull() | ~dated("started_at") | ~dated("last_active_at") | fields["starred"].isNull()
        status = F.when(broken, "malformed_frontmatter").when(~fields["tool"].isin(*TOOLS), "unknown_tool").when(poor, "malformed_frontmatter").when(early, "malformed_body").otherwise("ok")
        return F.struct(status.alias("status"), fields.alias("fields"), F.transform(at, message).alias("messages"))

    return let(F.split(md, "\n"), parts)


def to_jsonl(m: DataFrame) -> DataFrame:
    """(file, line_no, line): sessions as flat-envelope JSON lines, text as block arrays for the
    assistant and as a string for others."""
    plain = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("conv-"), F.col("conv_id")).alias("sessionId"), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.struct(F.col("text").alias("content")).alias("message")))
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("tool_use").alias("type"), F.lit("x").alias("text")))
    rich = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("conv-"), F.col("conv_id")).alias("sessionId"), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.struct(blocks.alias("content")).alias("message")))
    return m.select(F.col("conv_id").alias("file"), F.col("turn").alias("line_no"), F.when(F.col("role") == "assistant", rich).otherwise(plain).alias("line"))


def to_wrapped_jsonl(m: DataFrame) -> DataFrame:
    """(file, line_no, line): sessions as wrapped-envelope JSON lines: first the session's own line, then
    messages under an item, under a payload or bare by turn, and lines that no reader should mind."""
    iso = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    block = F.array(F.struct(F.when(F.col("role") == "user", "Input_Text").otherwise("output_text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")))
    inner = F.struct(F.lit("message").alias("type"), F.col("role").alias("role"), block.alias("content"))
    bare = F.struct(F.lit("response_item").alias("type"), iso, F.col("role").alias("role"), F.col("text").alias("content"))
    line = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(iso, inner.alias("item")))).when(F.col("turn") % 3 == 1, F.to_json(F.struct(iso, F.lit("ResponseItem").alias("type"), inner.alias("payload")))).otherwise(F.to_json(bare))
    meta = F.to_json(F.struct(iso, F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("conv-"), F.col("conv_id")).alias("id"), F.concat(F.lit("/home/u/p"), F.col("conv_id") % 7, F.lit("/")).alias("cwd")).alias("payload")))
    noise = [F.lit(x) for x in ("{broken", "null", "[1]", "  ", '{"type":5}', '{"item":{"type":"message","role":"tool","content":"x"}}')]
    name = F.concat(F.lit("/s/rollout-"), F.col("conv_id"), F.lit(".jsonl"))
    rows = m.select(name.alias("file"), (F.col("turn") * 10 + 5).alias("line_no"), line.alias("line"))
    some = m.where("conv_id % 4 <> 3").groupBy("conv_id").agg(F.min("ts").alias("ts")).select(name.alias("file"), F.lit(0).alias("line_no"), meta.alias("line"))
    more = m.select(name.alias("file"), (F.col("turn") * 10 + 6).alias("line_no"), F.element_at(F.array(*noise), (F.col("turn") % len(noise) + 1).cast("int")).alias("line"))
    return rows.unionByName(some).unionByName(more)
