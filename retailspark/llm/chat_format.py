"""Chat formatting by event-sourced reconstruction.

A log has one row per event: conv_id, seq, message (number of the message inside its
conversation), kind, role and text. Kinds:

* ``open`` starts a message with a first text (often empty) and its role;
* ``delta`` appends to the message;
* ``edit`` replaces the whole text so far;
* ``regenerate`` discards the text so far and starts again with the given text.

The fold partitions the log by conversation and message, orders it by ``seq`` and keeps what
follows the last event that replaces the text; it needs no state that grows with the events of
other messages. Messages are then rendered in order. Everything is DataFrame functions.

Template of a message::

    ### role: text</turn>\\n

In roles and texts a backslash is doubled, and the first character of a control string is
written as a backslash and a letter, so a text can hold any control string and be read back.

Defined results: a null text is empty; a null role is written as an empty one; a null seq comes first, ties are
ordered by kind and text; a conversation whose log is empty does not occur; a null conv_id is a
conversation of its own; a message without ``open`` has an empty role unless a later event names
one; other columns of the log are ignored. One conversation is one row of the result and so must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, AFTER_ROLE, TAIL = "### ", ": ", "</turn>\n"
REPLACING = ("open", "edit", "regenerate")
DELTA_CHARS = 256


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\h##"))
    text = F.replace(text, F.lit("</turn"), F.lit("\\l/turn"))
    return F.replace(text, F.lit(": "), F.lit("\\c "))


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: doubled backslashes are taken off first, from left to right."""

    def letters(piece: Column) -> Column:
        for code, plain in (("\\h", "#"), ("\\l", "<"), ("\\c", ":")):
            piece = F.replace(piece, F.lit(code), F.lit(plain))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), letters), "\\")


def escape_text(text: Column) -> Column:
    """Texts may hold the mark after a role as it is: only the first one of a message is read."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\h##"))
    return F.replace(text, F.lit("</turn"), F.lit("\\l/turn"))


def log_of_turns(turns: DataFrame, piece: int = DELTA_CHARS) -> DataFrame:
    """The log that writing these finished turns would leave: each opens empty and grows by deltas."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "message", F.row_number().over(order)
    )
    pieces = F.expr(
        f"transform(sequence(0, int(ceil(char_length(text) / {piece}))), "
        f"i -> if(i = 0, '', substring(text, (i - 1) * {piece} + 1, {piece})))"
    )
    return whole.select("conv_id", "message", "role", F.posexplode(pieces).alias("step", "text")).select(
        "conv_id",
        (F.col("message").cast("long") * F.lit(1 << 32) + F.col("step")).alias("seq"),
        "message",
        F.when(F.col("step") == 0, "open").otherwise("delta").alias("kind"),
        "role",
        "text",
    )


def fold(log: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, role, text."""
    of_message = Window.partitionBy("conv_id", "message")
    order = [F.col("seq").asc_nulls_first(), F.col("kind"), F.col("text")]
    events = log.select("conv_id", "message", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    numbered = events.withColumn("at", F.row_number().over(of_message.orderBy(*order)))
    last = F.max(F.when(F.col("kind").isin(*REPLACING), F.col("at"))).over(of_message)
    live = numbered.withColumn("from", F.coalesce(last, F.lit(0)))
    part = F.when(F.col("at") >= F.col("from"), F.struct("at", "text"))
    texts = F.transform(F.sort_array(F.collect_list(part)), lambda e: e["text"])
    return live.groupBy("conv_id", "message").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"),
        F.array_join(texts, "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text and the spans (start, length) under the loss mask.

    Spans count code points of ``formatted`` and cover the escaped text of ``loss_role``.
    """
    role = escape(F.coalesce("role", F.lit("")))
    body = escape_text(F.coalesce("text", F.lit("")))
    parts = messages.select(
        "conv_id",
        "message",
        F.concat(F.lit(HEAD), role, F.lit(AFTER_ROLE)).alias("head"),
        body.alias("body"),
        (F.col("role") == loss_role).alias("learned"),
    )
    turn = F.struct(
        "message",
        F.concat("head", "body", F.lit(TAIL)).alias("block"),
        F.char_length("head").alias("lead"),
        F.char_length("body").alias("chars"),
        F.coalesce("learned", F.lit(False)).alias("learned"),
    )
    listed = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.expr(
        f"""aggregate(turns,
              struct(0L AS place, cast(array() AS array<struct<start: bigint, length: bigint>>) AS spans),
              (s, t) -> struct(
                s.place + t.lead + t.chars + {len(TAIL)}L AS place,
                if(t.learned,
                   concat(s.spans, array(struct(s.place + t.lead AS start, cast(t.chars AS bigint) AS length))),
                   s.spans) AS spans),
              s -> s.spans)"""
    )
    return listed.select(
        "conv_id", F.array_join(F.col("turns.block"), "").alias("formatted"), spans.alias("loss_spans")
    )


def format_chats(log: DataFrame, loss_role: str = "assistant") -> DataFrame:
    return render(fold(log), loss_role)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learned texts parsed from the output of ``render`` alone."""
    blocks = F.filter(F.split("formatted", TAIL, -1), lambda b: b != "")
    turns = F.transform(
        blocks,
        lambda b: F.struct(
            unescape(F.regexp_extract(b, r"(?s)\A### (.*?): ", 1)).alias("role"),
            unescape(F.regexp_replace(b, r"(?s)\A### .*?: ", "")).alias("text"),
        ),
    )
    learned = F.transform(
        "loss_spans",
        lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))),
    )
    return formatted.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))
