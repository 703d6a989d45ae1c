"""Operator 7: chat formatting by event-sourced reconstruction.

A log holds events of a conversation: whole messages, streamed deltas, edits and
regenerations. Events are brought together by conversation, sorted by sequence and
folded into final messages, which a template renders. Everything is DataFrame
functions.

Template: a turn is `### role: text</turn>` and a line break. Inside roles and texts
a backslash is doubled and control strings are broken by one, so that neither `###`
nor `</turn>` can stand there: reading back is splitting and one replacement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAD, SEP, TAIL = "### ", ": ", "</turn>\n"
#: What an event does to the turn it names.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"


def escape(text: F.Column) -> F.Column:
    """Doubles backslashes, then breaks control strings with one."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("##"), F.lit("#\\#"))


def escape_role(role: F.Column) -> F.Column:
    """As escape(); a colon gets a backslash too, so that none stands before a blank."""
    return F.replace(escape(role), F.lit(":"), F.lit(":\\"))


def unescape(text: F.Column) -> F.Column:
    """Reverses both in one pass: each backslash goes, what follows it stays."""
    return F.regexp_replace(text, r"(?s)\\(.?)", "$1")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as a log: one message event for each row."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("seq"), F.col("turn").cast("long").alias("turn"), F.lit(MESSAGE).alias("event"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def streamed_events(conversations: DataFrame, piece: int = 40) -> DataFrame:
    """The log that a chat server would have written for a table of turns, by the
    turn's place in its conversation: user turns are sent and every third is a draft
    edited into its text; other turns stream in deltas of `piece` characters, and
    every third of those is regenerated after a first answer. Folding it gives the
    turns back; a turn that stands in several rows comes as whole messages."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    event = lambda nth, name, said: F.struct(nth.cast("long").alias("nth"), F.lit(name).alias("event"), said.alias("text"))
    zero, one = F.lit(0), F.lit(1)
    pieces = F.transform(F.sequence(one, F.greatest(one, F.ceil(F.length(text) / piece).cast("int"))), lambda k: F.substring(text, (k - 1) * piece + 1, F.lit(piece)))
    deltas = F.transform(pieces, lambda p, k: event(k + 2, DELTA, p))
    draft = event(zero, MESSAGE, F.concat(F.lit("draft: "), F.left(text, F.lit(9))))
    third = F.pmod(F.col("turn"), F.lit(3)) == 0
    spoken = F.when(third, F.array(draft, event(one, EDIT, text))).otherwise(F.array(event(zero, MESSAGE, text)))
    answered = F.when(third, F.concat(F.array(draft, event(one, REGENERATE, F.lit(None).cast("string"))), deltas)).otherwise(F.concat(F.array(event(zero, MESSAGE, F.lit(""))), deltas))
    once = F.count("*").over(Window.partitionBy("conv_id", "turn")) == 1
    log = F.when(~F.col("once") | F.col("turn").isNull(), F.array(event(zero, MESSAGE, text))).when(role == "user", spoken).otherwise(answered)
    # one shuffle, of turns: the window and the fold of their events keep its partitioning
    each = conversations.repartition("conv_id").withColumn("once", once).select("conv_id", "turn", role.alias("role"), F.explode(log).alias("e"))
    return each.select("conv_id", (F.col("turn").cast("long") * (1 << 32) + F.col("e.nth")).alias("seq"), F.col("turn").cast("long").alias("turn"), "e.event", "role", "e.text")


def final_messages(events: DataFrame) -> DataFrame:
    """Folds a log (conv_id, seq, turn, event, role, text) into conv_id and
    `messages`, array of role and text in order.

    message adds a message; delta appends to the newest message of its turn, or
    starts one; edit replaces the text of that message; regenerate empties it, so
    that deltas stream anew, and takes its text if it has any. An edit or
    regeneration of a turn that has no message adds one. Events are ordered by
    (seq, turn, role, text, event), nulls first; null roles and texts count as
    empty, a null event as message. Repeated message events are messages of their
    own."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    event = F.struct(F.col("seq"), F.col("turn"), blank("role").alias("role"), blank("text").alias("text"), F.coalesce(F.col("event"), F.lit(MESSAGE)).alias("event"))
    logs = events.groupBy("conv_id").agg(F.array_sort(F.collect_list(event)).alias("log"))
    # A turn's events fold on their own. Its texts after the last event that sets
    # the text (message, edit, regenerate), that one included, are what stays; and
    # every message event starts a message, placed at the event that started it.
    streamed = logs.select("conv_id", F.posexplode("log").alias("at", "e")).select("conv_id", "at", "e.*")
    turn = Window.partitionBy("conv_id", "turn").orderBy("at")
    starts = F.when((F.col("event") == MESSAGE) | (F.row_number().over(turn) == 1), 1).otherwise(0)
    sets = F.when(F.col("event") != DELTA, 1).otherwise(0)
    message = streamed.withColumn("message", F.sum(starts).over(turn)).withColumn("version", F.sum(sets).over(turn))
    last = message.groupBy("conv_id", "turn", "message").agg(
        F.min("at").alias("at"),
        F.max_by("role", F.when(F.col("role") != "", F.col("at"))).alias("role"),
        F.array_sort(F.collect_list(F.struct("version", "at", "text"))).alias("parts"),
    )
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["version"] == F.element_at("parts", -1)["version"]), lambda p: p["text"]), "")
    folded = last.select("conv_id", F.struct("at", F.coalesce("role", F.lit("")).alias("role"), text.alias("text")).alias("m")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: F.struct(m["role"], m["text"])).alias("messages"))
    return folded


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted (the conversation by the template) and loss_spans, array
    of start and end (code points of formatted, end exclusive) of the texts under
    the loss mask: those whose role is assistant."""
    turn = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.concat(F.lit(HEAD), escape_role(m["role"]), F.lit(SEP)).alias("head"), escape(m["text"]).alias("body")))
    turns = messages.select("conv_id", turn.alias("turns"))
    # start of each turn: lengths before it, summed once
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(state, t):
        start = state["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        spans = F.when(t["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((end + len(TAIL)).alias("at"), spans.alias("spans"))

    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TAIL))), "")
    return turns.select("conv_id", formatted.alias("formatted"), F.aggregate("turns", empty, step, lambda s: s["spans"]).alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans, `turns` (role and text of each turn, taken
    from formatted alone) and `loss_text` (what the loss mask covers, unescaped)."""
    pieces = F.filter(F.split("formatted", r"</turn>\n"), lambda p: p != "")
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(len(HEAD) + 1), F.instr(p, F.lit(SEP)) - len(HEAD) - 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, F.lit(SEP)) + len(SEP), F.length(p))).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return rendered.select("conv_id", "formatted", "loss_spans", turns.alias("turns"), loss.alias("loss_text"))


def format_chats(events: DataFrame) -> DataFrame:
    """Final messages of a log, rendered: conv_id, formatted, loss_spans.

    A null conv_id is a conversation like others; an empty log gives an empty
    result; further columns are not read. A conversation is one row of the result
    and so must fit in a task."""
    return render(final_messages(events))
