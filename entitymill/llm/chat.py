"""Conversations from reply trees, in DataFrame operations only.

Iterative self-joins double every message's jump towards its root, so depth d
takes log2(d) joins; the same jumps, largest first, then list the messages above
each leaf, and no row ever carries a way. Paths from root to leaf are ranked by
score; each chosen path is formatted as one conversation, with a mask over what an
assistant says. The format can be read back to the letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

#: How a turn begins and ends. Other roles are written `### role/<name>: `.
HEADS = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
END = "</turn>\n"


def escape(text: Column) -> Column:
    """Control strings cannot occur in the result: backslash and # get a backslash before them, </turn> one inside."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("#"), F.lit("\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _head(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in HEADS.items() for x in pair])[role]
    return F.coalesce(known, F.concat(F.lit("### role/"), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(": ")))


def _same(conv: str) -> Column:
    """A conversation as a key that joins null with null: as a field of a struct, null equals null."""
    return F.struct(F.col(conv).alias("conv_id")).alias("conv_id")


def root_paths(
    messages: DataFrame, conv: str = "conv_id", message: str = "message_id", parent: str = "parent_id", score: str = "score",
    null_conversation: bool = False,
) -> DataFrame:
    """(conv_id, leaf_id, path_score, path): every path from a root to a leaf, message ids in order.

    ``messages`` has one row per message of a conversation, ids unique in it. A
    message without parent, or whose parent is not in its conversation, is a
    root. Messages on or behind a circle of parents have no root and yield no
    path. A null score counts as zero. Null conversations are left out, or are
    one conversation with ``null_conversation``.
    """
    nodes = cut_lineage(messages.select(
        _same(conv), F.col(message).alias("id"), F.col(parent).alias("up"),
        F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"),
    ).filter(F.col("id").isNotNull() & (F.lit(null_conversation) | F.col("conv_id.conv_id").isNotNull())))
    known = nodes.select("conv_id", F.col("id").alias("up"), F.lit(True).alias("_known"))
    ways = nodes.join(known, ["conv_id", "up"], "left").select("conv_id", "id", F.when(F.col("_known"), F.col("up")).alias("jump"), "score")
    parents = ways.filter("jump is not null").select("conv_id", F.col("jump").alias("id")).distinct()
    leaves = ways.join(parents, ["conv_id", "id"], "left_anti").select("conv_id", "id")
    ways, jumps = cut_lineage(ways), []
    # a way of n messages is whole after log2(n) rounds; what is not whole then runs in a circle
    longest = ways.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range((longest - 1).bit_length()):
        open_ = ways.filter("jump is not null")
        if open_.isEmpty():
            break
        jumps.append(open_.select("conv_id", "id", "jump"))
        above = ways.select("conv_id", F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("score").alias("_score"))
        longer = open_.join(above, ["conv_id", "jump"]).select("conv_id", "id", F.col("_jump").alias("jump"), (F.col("score") + F.col("_score")).alias("score"))
        ways = cut_lineage(ways.filter("jump is null").unionByName(longer))
    tips = ways.filter("jump is null").join(leaves, ["conv_id", "id"]).select("conv_id", F.col("id").alias("leaf_id"), F.col("score").alias("path_score"))
    # every number of steps above a leaf is one sum of powers of two, so the largest jumps first reach each message of its way once
    steps = tips.select("*", F.col("leaf_id").alias("id"), F.lit(0).cast("long").alias("above"))
    for k, jump in reversed(list(enumerate(jumps))):
        higher = steps.join(jump, ["conv_id", "id"]).select("conv_id", "leaf_id", "path_score", F.col("jump").alias("id"), (F.col("above") + (1 << k)).alias("above"))
        steps = cut_lineage(steps.unionByName(higher))
    path = F.sort_array(F.collect_list(F.struct("above", "id")), asc=False)["id"]
    return steps.groupBy("conv_id", "leaf_id").agg(F.first("path_score").alias("path_score"), path.alias("path")).select("conv_id.conv_id", "leaf_id", "path_score", "path")


def best_paths(paths: DataFrame, branches: int | None = None) -> DataFrame:
    """Paths with their rank in the conversation, best score first, then shorter, then smaller leaf; all or the best ``branches``."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("path_score"), F.size("path"), "leaf_id")
    ranked = paths.withColumn("rank", F.row_number().over(order))
    return ranked if branches is None else ranked.filter(F.col("rank") <= branches)


def format_paths(
    paths: DataFrame, messages: DataFrame, conv: str = "conv_id", message: str = "message_id", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per path: conv_id, leaf_id, rank, formatted, loss_spans (code points of the formatted text, end exclusive).

    A null text counts as empty, a null role as an empty name.
    """
    said = messages.select(
        _same(conv), F.col(message).alias("id"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).select("conv_id", "id", "role", _head(F.col("role")).alias("head"), escape(F.col("text")).alias("body"))
    steps = paths.select(_same("conv_id"), "leaf_id", "rank", F.posexplode("path").alias("pos", "id"))
    turns = steps.join(said, ["conv_id", "id"]).withColumn("turn", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id", "leaf_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end")))
    whole = turns.groupBy("conv_id", "leaf_id", "rank").agg(F.sort_array(F.collect_list(F.struct("pos", "turn", span.alias("span")))).alias("turns"))
    return whole.select(
        "conv_id.conv_id", "leaf_id", "rank", F.array_join(F.col("turns.turn"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, END, -1), lambda p: p != "")
    heads = F.create_map(*[F.lit(x) for r, h in HEADS.items() for x in (h, r)])

    def turn(piece: Column) -> Column:
        head = F.regexp_extract(piece, r"(?s)^### (?:role/[^\\:]*+(?:\\.[^\\:]*+)*+|[A-Za-z]+): ", 0)
        other = unescape(F.regexp_extract(head, r"(?s)^### role/(.*): $", 1))
        return F.struct(F.coalesce(heads[head], other).alias("role"), unescape(F.substr(piece, F.length(head) + 1)).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def linear_messages(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of turns as messages that each answer the turn before; equal turns follow each other by role, then text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    narrow = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    numbered = narrow.withColumn("message_id", F.row_number().over(order))
    return numbered.select(
        "conv_id", "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"),
        "role", "text", F.lit(0.0).alias("score"),
    )
