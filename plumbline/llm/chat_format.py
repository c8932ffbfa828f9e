"""Chat formatting from an event log, in DataFrame operations only.

The log is dealt by conversation and message, sorted by sequence and folded: deltas append, an edit
replaces what the message said so far, a regeneration throws it away. Messages are then rendered in
order, with the spans that a loss may look at.

A conversation is one output cell, so each conversation has to fit into a row; its events are folded
message by message before the messages meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Control strings of the template (fixed values).
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escape(text: Column) -> Column:
    """Reversible: afterwards no control string can occur, since ``<`` never meets ``|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Messages (conv_id, message, role, text) of a log (conv_id, seq, message, event, role, text).

    ``event`` is ``delta``, ``edit`` or ``regenerate``; other events and nulls change nothing. Null
    texts are empty. The role is that of the first event that names one, else empty. Events of the
    same sequence number are taken in the order of event and text. A message without an event that
    counts is an empty message. Null conversations and messages form groups of their own.
    """
    reset = F.when(F.col("event").isin("edit", "regenerate"), F.struct("seq", "event", "text"))
    grouped = events.groupBy("conv_id", "message").agg(
        F.max(reset).alias("reset"),
        F.min_by("role", F.struct("seq", "event", "text", "role")).alias("first_role"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "event", "role"))).alias("role"),
        F.array_sort(F.collect_list(F.struct("seq", "event", "text"))).alias("log"),
    )
    after = F.filter(
        "log",
        lambda e: e["event"].isin("delta", "edit")
        & (F.col("reset").isNull() | (e["seq"] > F.col("reset")["seq"])
           | ((e["seq"] == F.col("reset")["seq"]) & (e == F.col("reset")))),
    )
    text = F.array_join(F.transform(after, lambda e: F.coalesce(e["text"], F.lit(""))), "")
    role = F.coalesce("role", F.lit(""))
    return grouped.select("conv_id", "message", role.alias("role"), text.alias("text"))


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation.

    ``loss`` holds (start, length) in code points of ``formatted``: the escaped text of every message
    whose role is in ``trained``. Messages of equal number are ordered by role and text.
    """
    body = escape(F.coalesce("text", F.lit("")))
    pieces = messages.select(
        "conv_id",
        "message",
        F.col("role").isin(*trained).alias("trained"),
        F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT)).alias("head"),
        body.alias("body"),
    )
    before = Window.partitionBy("conv_id").orderBy("message", "head", "body").rowsBetween(
        Window.unboundedPreceding, -1
    )
    length = F.length("head") + F.length("body") + F.lit(len(END))
    placed = pieces.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)))
    span = F.struct(
        (F.col("start") + F.length("head")).cast("long").alias("start"),
        F.length("body").cast("long").alias("length"),
    )
    piece = F.struct("start", F.concat("head", "body", F.lit(END)).alias("piece"))
    return placed.groupBy("conv_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["piece"]), ""
        ).alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("trained"), span))).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation as an array of (role, text)."""
    turns = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 2_000_000_000)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(t, TEXT, 1)).alias("role"),
            unescape(
                F.substring_index(F.substring_index(t, TEXT, -1), END, 1)
            ).alias("text"),
        ),
    )


def masked_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss spans, unescaped, in order."""
    return F.transform(
        loss,
        lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))),
    )


def turn_events(conversations: DataFrame) -> DataFrame:
    """A finished table (conv_id, turn, role, text) as a log: every row one message of one delta.

    Rows of the same turn stay messages of their own, ordered by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("seq"),
        F.row_number().over(order).cast("long").alias("message"),
        F.lit("delta").alias("event"),
        "role",
        "text",
    )
