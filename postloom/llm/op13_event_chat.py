"""Operator 13: chat formatting from event logs, with DataFrame functions only.

A conversation is a log of events. Every message is opened, streamed in pieces, and may be regenerated (what was streamed so far is
void, new pieces follow) or edited (its text is replaced, later pieces continue it), also long after other messages were written.
Folding: a message's last regeneration or edit is its base; its text is the edit's, followed by the pieces after the base in the
order of the sequence. Events are dealt by conversation and message, so that a conversation with a third of all rows is folded by many
tasks. Messages are ordered by their first event.

The template writes `<turn ROLE>`, a newline, the text and `</turn>` with a newline. In texts and roles `\\` becomes `\\b`, `<` becomes `\\l`
and `>` becomes `\\g`: so no control string of the template stands in a text, and reading back is exact, since every backslash left is the
start of one of the three. Under the loss mask are the bodies of assistant turns.

Nulls: a null conversation is one of its own, null sequence numbers come first, a null role or text is empty; an event without kind, or
of an unknown kind, only takes part in the order. The same event delivered twice (all fields equal) counts once. Messages of one first
sequence are ordered by role and text. Conversations without events have no row; other columns are ignored, whatever their names.

What is held: the live pieces of one message, and, in `assembled`, one conversation's text, because it returns that as one value.
`fragments` gives the same output a message a row, for conversations that should never be one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
#: Code points of a streamed piece in the log that is made of finished conversations.
PIECE = 160
_ESCAPES = [("\\", "\\b"), ("<", "\\l"), (">", "\\g")]


def escaped(text: Column) -> Column:
    for raw, safe in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for raw, safe in reversed(_ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, message, first, role, text) of the final messages of a log (conv_id, message, seq, kind, role, payload).

    Kinds: open (sets the role), delta, edit, regenerate. seq may have any type that has an order, structs too. Two aggregations of one
    exchange: the base of a message is found first, so that pieces that became void are not gathered.
    """
    keys = ["conv_id", "message"]
    e = events.select(*keys, "seq", "kind", "role", "payload").repartition(*keys)
    w = Window.partitionBy(*keys).orderBy(F.col("seq").desc_nulls_last(), F.col("kind").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    live = e.withColumn("void", F.coalesce(F.max(F.col("kind").isin("edit", "regenerate")).over(w), F.lit(False)))
    piece = F.when(~F.col("void") & F.col("kind").isin("delta", "edit"), F.struct("seq", "kind", F.coalesce("payload", F.lit("")).alias("payload")))
    m = live.groupBy(*keys).agg(
        F.min(F.struct(F.col("seq").isNotNull(), "seq")).alias("first"), F.max_by(F.when(F.col("kind") == "open", F.col("role")), F.when(F.col("kind") == "open", F.struct("seq", "role"))).alias("role"),
        F.array_sort(F.array_distinct(F.collect_list(piece))).alias("pieces"),
    )
    # an edit sorts behind pieces of its own sequence number, which it replaces
    return m.select(*keys, F.col("first.seq").alias("first"), F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.col("pieces.payload"), "").alias("text"))


def fragments(messages: DataFrame) -> DataFrame:
    """(conv_id, position, fragment, start, loss_at, loss_chars, loss) of folded messages: each turn as the template writes it, where it starts in its
    conversation, and which part of it is its body; loss marks the bodies under the mask. Sizes are code points, starts from 0."""
    head = F.concat(F.lit("<turn "), escaped(F.col("role")), F.lit(">\n"))
    t = messages.select("conv_id", "first", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    t = t.select("conv_id", "first", "role", "text", F.concat("head", "body", F.lit("</turn>\n")).alias("fragment"), F.length("head").alias("loss_at"), F.length("body").alias("loss_chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("first").asc_nulls_first(), "role", "text")
    start = F.coalesce(F.sum(F.length("fragment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return t.select("conv_id", F.row_number().over(order).alias("position"), "fragment", start.alias("start"), "loss_at", "loss_chars", (F.col("role") == LOSS_ROLE).alias("loss"))


def assembled(parts: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): each conversation as one text; mask has, for every turn, (start of the turn, loss_at, loss_chars, loss)."""
    turns = F.array_sort(F.collect_list(F.struct("position", "fragment", F.struct("start", "loss_at", "loss_chars", "loss").alias("mask"))))
    g = parts.groupBy("conv_id").agg(turns.alias("turns"))
    return g.select("conv_id", F.array_join(F.col("turns.fragment"), "").alias("formatted"), F.col("turns.mask").alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text) read from the formatted text and the mask alone: turns has (role, text) in order, loss_text is the
    unescaped text under the loss mask."""
    chunk = F.split(F.col("formatted"), "</turn>\n")
    chunks = F.slice(chunk, 1, F.size(chunk) - 1)  # behind the last end there is nothing
    role = lambda c: unescaped(F.substr(F.substring_index(c, ">", 1), F.lit(7)))  # noqa: E731  behind "<turn "
    text = lambda c: unescaped(F.substr(c, F.instr(c, ">") + 2))
    turns = F.transform(chunks, lambda c: F.struct(role(c).alias("role"), text(c).alias("text")))
    under = F.zip_with(chunks, "mask", lambda c, m: F.when(m["loss"], F.substr(c, m["loss_at"] + 1, m["loss_chars"])).otherwise(""))
    return formatted.select("conv_id", turns.alias("turns"), unescaped(F.array_join(under, "")).alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def log_of(conversations: DataFrame) -> DataFrame:
    """The event log that leaves these finished conversations (conv_id, turn, role, text): texts are streamed in pieces of PIECE code
    points. By a hash of the text, a third of the messages is streamed in part, regenerated and streamed anew; another third is streamed
    with a wrong start and edited two turns later. Sequence numbers are (turn, step)."""
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("message"))
    c = c.withColumn("course", F.pmod(F.xxhash64("text", "role"), F.lit(3)))
    void = F.lit(None).cast("string")
    event = lambda turn, step, kind, role, payload: F.struct(F.struct(turn.cast("long").alias("turn"), step.cast("int").alias("step")).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), payload.alias("payload"))
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / PIECE).cast("int"))
    stream = lambda step: F.transform(starts, lambda k: event(F.col("turn"), k + step, "delta", void, F.substr("text", k * PIECE + 1, F.lit(PIECE))))
    opened = F.array(event(F.col("turn"), F.lit(0), "open", F.col("role"), void))
    draft = F.array(event(F.col("turn"), F.lit(1), "delta", void, F.concat(F.lit("draft </turn> \\l "), F.substr("text", F.lit(1), F.lit(PIECE)))))
    again = F.array(event(F.col("turn"), F.lit(2), "regenerate", void, void))
    later = F.array(event(F.coalesce(F.try_add("turn", F.lit(2)), "turn", F.lit(0)), F.lit((1 << 31) - 1), "edit", void, F.col("text")))
    events = F.when(F.col("course") == 0, F.concat(opened, stream(1))).when(F.col("course") == 1, F.concat(opened, draft, again, stream(3))).otherwise(F.concat(opened, draft, later))
    return c.select("conv_id", "message", F.explode(events).alias("e")).select("conv_id", "message", "e.seq", "e.kind", "e.role", "e.payload")


def nasty(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user and an assistant turn that say a control string."""
    turn = F.col("id")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))


def report(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from formatted conversations."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars"
    )


def op13_event_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(nasty(spark))
    return report(assembled(fragments(folded(log_of(rows)))))
