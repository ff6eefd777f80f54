"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A conversation is stored as a log: streamed deltas, edits (a new whole text) and regenerations (the
text starts again, and what was said below it is void). Logs are partitioned by conversation once and
sorted by sequence; folding keeps, for each message, the events from its last reset on. The final
messages are rendered in one template whose control strings are escaped inside texts.

Template: each message is ``<s>[INST]role[/INST]text</s>``. Inside roles and texts every control
string, with any number of backslashes after its first character, gets one more backslash there;
reading removes one. The segments carry the loss mask: only assistant texts have loss.

Defined results: events are ordered by (seq, kind, text); null texts are empty, a null role is the
empty role. A null conversation id is a conversation of its own. Repeated rows are repeated messages.
A conversation, with very long texts too, is one output row, so its size bounds the memory of a task. An
empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
RESETS = ("edit", "regenerate")
LOG = "conv_id long, seq long, msg long, kind string, role string, text string"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def log_of_rows(rows: DataFrame) -> DataFrame:
    """An event log that ends in finished rows (conv_id, turn, role, text), as an interface might have made them.

    Rows are messages in the order of (turn, role, text). An answer was streamed wrongly and a next message was
    begun below it; then it was regenerated, which voids both, and streamed in two deltas. Any other message was
    begun wrongly, edited to its first half and went on with its second.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", F.row_number().over(order).cast("long").alias("msg"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def event(kind: str, text: Column, below: int = 0) -> Column:
        return F.struct(F.lit(below).alias("below"), F.lit(kind).alias("kind"), text.alias("text"))

    answer = F.array(
        event("delta", second), event("delta", first), event("delta", second, 1), event("regenerate", F.lit("")), event("delta", first), event("delta", second)
    )
    other = F.array(event("delta", second), event("edit", first), event("delta", second))
    events = F.when(F.col("role") == "assistant", answer).otherwise(other)
    return numbered.select("conv_id", "msg", "role", F.posexplode(events).alias("i", "e")).select(
        "conv_id", (F.col("msg") * 8 + F.col("i")).alias("seq"), (F.col("msg") + F.col("e.below")).alias("msg"),
        F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"),
    )


def fold(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of an event log with the columns of ``LOG``."""
    earlier = Window.partitionBy("conv_id").orderBy("msg").rangeBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("conv_id", "msg")
    reset = F.when(F.col("kind").isin(*RESETS), F.col("seq"))
    live = (
        log.withColumn("void_before", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier))
        .filter(F.col("void_before").isNull() | (F.col("seq") >= F.col("void_before")))
        .withColumn("reset", F.max(reset).over(within))
    )
    after = F.col("reset").isNull() | (F.col("seq") >= F.col("reset"))
    piece = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    pieces = F.sort_array(F.collect_list(F.when(after, piece)))
    return live.groupBy("conv_id", "msg").agg(
        F.coalesce(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))), F.lit("")).alias("role"),
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, segments (text, loss), formatted."""
    message = F.struct("msg", "role", "text")
    ordered = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    segments = F.flatten(
        F.transform(
            "messages",
            lambda m: F.array(
                F.struct(F.concat(F.lit(OPEN), escape(m["role"]), F.lit(ROLE_END)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(m["text"]).alias("text"), (m["role"] == "assistant").alias("loss")),
                F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return ordered.select("conv_id", segments.alias("segments")).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def format_conversations(log: DataFrame) -> DataFrame:
    return render(fold(log))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) parsed from a formatted text."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    body = F.transform(pieces, lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    return F.transform(
        body,
        lambda b: F.struct(
            unescape(F.substring_index(b, ROLE_END, 1)).alias("role"),
            unescape(F.substring(b, F.instr(b, ROLE_END) + len(ROLE_END), F.length(b))).alias("text"),
        ),
    )


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
