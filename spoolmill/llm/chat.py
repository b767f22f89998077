"""Chat formatting through a prefix tree.

Conversations that share their first turns share tree nodes: a node is a formatted turn after a
given prefix, named by a digest of all that leads to it. Nodes are emitted once, depth first, as one
stream of tokens. Each has its place in the stream, the position id of its first token (counted along
its own branch, so a branch reads as if it stood alone), and attends to the intervals of its ancestors.

Nothing grows faster than the turns. A prefix's digest is a sum of digests of (place, turn), so it is a
running sum over range-partitioned rows, and no conversation is gathered. Nodes without a branching
between them form a chain; a chain's ancestors are whole chains, so intervals are kept per chain, one
for each branching above it, and the depth-first order of nodes is that of their chains' digests. A
first turn that all conversations share is one row, and rows that meet it join apart.

Template: ``<s>[role]`` newline, text, ``</s>``. In roles and texts a backslash is doubled and one
is put after every ``<``, ``[`` and ``]``; so no control string can occur inside a turn, and the
escape is undone from left to right. Tokens are those of a byte-level vocabulary whose file is given, a
turn at a time, so that decoding gives the text back; without a file a token is a character.

Defined results: null roles and texts are empty. Turns are ordered by turn (null first), role and
text, so repeated rows are repeated turns. Rows without a conv_id form one conversation. Empty
tables give empty results. Columns other than conv_id, turn, role and text are not read. Only
``read_back`` gathers a conversation, because its digests are over whole conversations.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_spread, ranged, running_sum

#: A conversation of control strings, formatted besides the given ones (fixed values).
PROBE = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))
BEGIN, END = "<s>[", "</s>"


def escape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "\\\\", "\\\\\\\\"), "([<\\[\\]])", "$1\\\\")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, "([<\\[\\]])\\\\|\\\\(\\\\)", "$1$2")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), escape(F.coalesce(role, F.lit(""))), F.lit("]\n"), escape(F.coalesce(text, F.lit(""))), F.lit(END))


def with_probe(df: DataFrame) -> DataFrame:
    rows = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x) for x in r]) for r in PROBE])).alias("conv_id", "turn", "role", "text"))
    return df.select("conv_id", "turn", "role", "text").union(rows)


#: Digests are sums of this many parts of 32 bits, which stay exact for two thousand million turns.
_LANES = 4


def along(rows: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """Add ``<value>_0``, the sum of each value over the rows of the same conv_id before this one in
    ``order``. ``rows`` are range-partitioned by conversation and order, with the range as ``_pid``; only
    conversations that cross a border, at most two a range, bring sums from range to range."""
    here = Window.partitionBy("_pid", "conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    end = F.struct(F.col("conv_id").isNotNull().alias("k"), "conv_id")
    ends = rows.groupBy("_pid").agg(F.min(end).alias("a"), F.max(end).alias("b")).select(F.col("_pid").alias("_at"), F.explode(F.array_distinct(F.array("a", "b"))).alias("x"))
    ends = ends.select("_at", F.col("x.conv_id").alias("_conv"))  # two a range
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_pid") == F.col("_at"))
    totals = rows.join(F.broadcast(ends), same).groupBy("_at", "_conv").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.partitionBy("_conv").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a range
    carried = totals.select("_at", "_conv", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    out = rows.withColumns({f"{v}_0": F.coalesce(F.sum(v).over(here), F.lit(0)) for v in values}).join(F.broadcast(carried), same, "left")
    return out.withColumns({f"{v}_0": F.col(f"{v}_0") + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop("_at", "_conv", *[f"_{v}" for v in values])


def paths(df: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, piece): the nodes that each conversation passes."""
    piece = turn_text(F.col("role"), F.col("text"))
    rows = df.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("_tie"))
    order = ["turn", "role", "text", "_tie"]
    placed = along(ranged(rows, "conv_id", *order).withColumn("one", F.lit(1)), order, ["one"])
    placed = placed.select("conv_id", "_pid", F.col("one_0").alias("depth"), piece.alias("piece"))
    digest = F.sha2(F.concat("depth", F.lit(":"), "piece"), 256)
    lanes = {f"l{k}": F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(_LANES)}
    summed = along(cut(placed.withColumns(lanes)), ["depth"], list(lanes))

    def name(depth: Column, *sums: Column) -> Column:
        return F.substring(F.sha2(F.concat_ws(":", depth.cast("string"), *[x.cast("string") for x in sums]), 256), 1, 32)

    node = name(F.col("depth") + 1, *[F.col(f"{x}_0") + F.col(x) for x in lanes])
    parent = F.when(F.col("depth") > 0, name(F.col("depth"), *[F.col(f"{x}_0") for x in lanes]))
    return summed.select("conv_id", "depth", node.alias("node"), parent.alias("parent"), "piece")


#: Turns that are tokenised at a time.
_BATCH = 256


def tokenised(nodes: DataFrame, tokenizer: str | None) -> DataFrame:
    """Add ``tokens``, how many a node has, and ``ids``; without a tokenizer characters, and null."""
    if tokenizer is None:
        return nodes.withColumns({"tokens": F.length("piece").cast("long"), "ids": F.lit(None).cast("array<int>")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.encode_special_tokens = True
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                some = batch.slice(at, _BATCH)
                ids = [x.ids for x in model.encode_batch_fast(some.column(some.num_columns - 1).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], [*some.schema.names, "tokens", "ids"])

    rest = [c for c in nodes.columns if c != "piece"]
    types = dict(nodes.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in (*rest, "piece")], "tokens bigint", "ids array<int>"])
    return nodes.select(*rest, "piece").mapInArrow(run, schema)


_SPANS = "array<struct<chain:string,offset:bigint,tokens:bigint>>"


def _weighed(rows: DataFrame, key: str) -> DataFrame:
    return cut(rows.groupBy(key).agg(F.count("*").alias("_n")))


def format_tree(df: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stream (one row per node: node, parent, depth, chain, offset, position, tokens, ids, piece,
    conversations), its chains (chain, offset, tokens, conversations, ``attends``: the chains above, by
    offset) and the conversations' last nodes (conv_id, node).

    A node attends to its chain's ``attends``, and to its chain from the beginning up to itself.
    """
    own = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv")
    passed = cut(paths(df).select("*", own))
    nodes = passed.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("piece").alias("piece"), F.count("*").alias("conversations"), F.min("conv").alias("conv"))
    nodes = cut(tokenised(nodes, tokenizer))
    # a chain begins with the first turn and below every branching
    forks = cut(nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("_n")).where("_n > 1"))
    below = join_spread(nodes.select("node", "parent", "conversations"), forks, "parent", "_n").select("node", "conversations")
    tops = cut(below.unionByName(nodes.where("parent IS NULL").select("node", "conversations")).withColumn("step", F.substring("node", 1, 16)))
    starts = join_spread(passed.select("conv", "depth", "node"), tops, "node", "conversations")
    routes = cut(starts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "step"))).alias("route")))
    routed = cut(_weighed(nodes, "conv").join(routes, "conv"))
    taken = F.filter("route", lambda x: x["depth"] <= F.col("depth"))
    keyed = join_spread(nodes, routed, "conv", "_n").withColumn("_way", taken)
    keyed = keyed.select(*[c for c in nodes.columns if c != "conv"], F.element_at("_way", -1)["node"].alias("chain"), F.array_join(F.transform("_way", lambda x: x["step"]), "").alias("key"))
    # sorted by the chains' digests and then by depth, nodes are in depth-first order
    laid = cut(running_sum(keyed, ["key", "depth"], "tokens", "offset").drop("key"))
    chains = cut(laid.groupBy("chain").agg(F.min("offset").alias("offset"), F.sum("tokens").alias("tokens"), F.max("conversations").alias("conversations"), F.count("*").alias("_n")))
    prefix = F.explode(F.transform("route", lambda x, i: F.struct(x["node"].alias("chain"), F.transform(F.slice("route", 1, i), lambda y: y["node"]).alias("above"))))
    above = routes.select(prefix.alias("x")).select("x.*").groupBy("chain").agg(F.first("above").alias("above"))
    up = cut(above.select(F.col("chain").alias("of"), F.explode("above").alias("chain")))
    spans = cut(_weighed(up, "chain").join(chains.select("chain", "offset", "tokens"), "chain"))
    attends = join_spread(up, spans, "chain", "_n").groupBy("of").agg(F.array_sort(F.collect_list(F.struct("offset", "chain", "tokens"))).alias("a"))
    attends = attends.select(F.col("of").alias("chain"), F.transform("a", lambda x: F.struct(x["chain"].alias("chain"), x["offset"].alias("offset"), x["tokens"].alias("tokens"))).alias("attends"))
    chains = cut(chains.join(attends, "chain", "left").withColumn("attends", F.coalesce("attends", F.array().cast(_SPANS))))
    begin = F.aggregate("attends", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    about = cut(chains.select("chain", F.col("offset").alias("_o"), begin.alias("_p"), "_n"))
    stream = join_spread(laid, about, "chain", "_n").withColumn("position", F.col("_p") + F.col("offset") - F.col("_o")).drop("_o", "_p", "_n")
    last = passed.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    return cut(stream), chains.drop("_n"), cut(last)


def read_back(stream: DataFrame, chains: DataFrame, last: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, formatted, turns): each conversation's text read from what its last node attends to, and
    the unescaped turns parsed from that text alone."""
    ends = cut(_weighed(last, "node").join(stream.select("node", "chain", (F.col("offset") + F.col("tokens")).alias("end")), "node"))
    ends = cut(join_spread(last, ends, "node", "_n").select("conv_id", "chain", "end"))
    about = cut(_weighed(ends, "chain").join(chains.select("chain", "offset", "attends"), "chain"))
    own = F.array(F.struct("chain", "offset", (F.col("end") - F.col("offset")).alias("tokens")))
    seen = join_spread(ends, about, "chain", "_n").select("conv_id", F.explode(F.concat("attends", own)).alias("x"))
    seen = seen.select("conv_id", "x.chain", (F.col("x.offset") + F.col("x.tokens")).alias("until"))
    parts = cut(stream.join(chains.select("chain", F.col("conversations").alias("_n")), "chain").select("chain", "offset", "tokens", "ids", "piece", "_n"))
    got = join_spread(seen, parts, "chain", "_n").where("offset + tokens <= until")
    said = F.array_sort(F.collect_list(F.struct("offset", *(["piece"] if tokenizer is None else ["ids"]))))
    each = got.groupBy("conv_id").agg(said.alias("_p"))
    if tokenizer is None:
        text = each.select("conv_id", F.array_join(F.transform("_p", lambda x: x["piece"]), "").alias("formatted"))
    else:
        text = _decoded(each.select("conv_id", F.flatten(F.transform("_p", lambda x: x["ids"])).alias("ids")), tokenizer)
    marked = F.filter(F.split("formatted", END), lambda x: x != "")

    def parse(x: Column) -> Column:
        role = F.regexp_extract(x, "(?s)^<s>\\[(.*?)\\]\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, F.length(role) + len(BEGIN) + 3, F.length(x))).alias("text"))

    return text.withColumn("turns", F.transform(marked, parse))


def _decoded(df: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                some = batch.slice(at, _BATCH)
                texts = [model.decode(x.as_py(), skip_special_tokens=False) for x in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string())], ["conv_id", "formatted"])

    return df.mapInArrow(run, "conv_id bigint, formatted string")


def digests(read: DataFrame) -> DataFrame:
    """The registered query's columns; the loss mask covers the assistant's texts."""
    said = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = """
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(10 + length(role) + length(text) + length(regexp_replace(role || text, '[^<\\\\\\[\\]]', '', 'g')))::BIGINT AS formatted_chars
FROM a GROUP BY conv_id
"""
