"""Chat formatting from event logs: folded per message, rendered per conversation, read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events that set a message's text anew; later deltas append to it. A delete ends it.
_RESETS = ["create", "edit", "regenerate", "delete"]
_TURN = r"<\|im_start\|>((?:\\[\s\S]|[^\\\n])*+)\n([\s\S]*?)<\|im_end\|>\n"


def escaped(text: Column, line: bool = False) -> Column:
    """A backslash before every backslash and before a bar that follows '<' (and, for one-line fields, before a newline)."""
    return F.regexp_replace(text, r"(\\|(?<=<)\||\n)" if line else r"(\\|(?<=<)\|)", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of event logs.

    events: conv_id, seq, event (create, delta, edit, regenerate, delete), message_id, role, text.
    Events of a message are sorted by seq (ties: event, role, text). Its text is what its last
    create, edit or regenerate carries plus all later deltas; a later delete removes it; its place
    is that of its first event; its role is the first that is not null, else ''. Null texts count
    as empty; unknown events and null seqs sort first and act as deltas. Returns conv_id, place,
    role, text. A message with deltas only keeps them all.
    """
    at = F.struct("seq", "event", "role", "text")
    folded = events.groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(at)).alias("log"), F.max(F.when(F.col("event").isin(_RESETS), at)).alias("reset"))
    live = F.filter("log", lambda e: F.col("reset").isNull() | (e >= F.col("reset")))
    return folded.where("reset is null or reset.event <> 'delete'").select(
        "conv_id", F.struct(F.col("log")[0]["seq"].alias("seq"), "message_id").alias("place"),
        F.coalesce(F.get(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull()), 0), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
    )


def format_chats(events: DataFrame) -> DataFrame:
    """Renders conversations: <|im_start|>role, newline, text, <|im_end|>, newline for every message.

    Control strings inside roles and texts are escaped reversibly, so a text cannot open or close
    a turn. Returns conv_id, n_turns, formatted, loss (array<struct<start, chars>>: the code points
    of formatted, counted from 0, that hold assistants' texts). Logs are partitioned by
    conversation once; offsets are running sums over its messages, so a conversation's cost is
    linear in its length and only its rendered text, the result's row, is ever whole. A null
    conv_id is a conversation of its own; an empty log gives no rows.
    """
    order = Window.partitionBy("conv_id").orderBy("place")
    head = F.concat(F.lit("<|im_start|>"), escaped(F.col("role"), line=True), F.lit("\n"))
    turns = (
        fold_events(events).withColumn("head", head).withColumn("body", escaped(F.col("text")))
        .withColumn("turn", F.concat("head", "body", F.lit("<|im_end|>\n")))
        .withColumn("at", F.sum(F.length("turn")).over(order) - F.length("turn"))
    )
    span = F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("chars"))
    held = F.sort_array(F.collect_list(F.struct("at", "place", "turn", F.when(F.col("role") == "assistant", span).alias("span"))))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), held.alias("held")).select(
        "conv_id", "n_turns", F.array_join(F.transform("held", lambda t: t["turn"]), "").alias("formatted"),
        F.filter(F.transform("held", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Reads rendered conversations back: conv_id, roles, texts (arrays), masked (all text under the loss mask)."""
    masked = F.array_join(F.transform("loss", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["chars"].cast("int"))), "")
    return formatted.select(
        "conv_id", "formatted", "loss",
        F.transform(F.regexp_extract_all("formatted", F.lit(_TURN), 1), unescaped).alias("roles"),
        F.transform(F.regexp_extract_all("formatted", F.lit(_TURN), 2), unescaped).alias("texts"),
        unescaped(masked).alias("masked"),
    )
