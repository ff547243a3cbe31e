"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

An event log has the columns ``conv_id, seq, kind, msg, role, text``:

* ``message`` opens a new message under the id ``msg``;
* ``delta`` appends its text to the message last opened under that id;
* ``edit`` replaces the message's text so far;
* ``regenerate`` discards the message's text so far (its own text, if any, starts the new one)
  and withdraws every message that was opened between that message and this event.

``fold_events`` sorts each log by ``seq`` and folds it into final messages; ``render`` writes them
with a reversible template and marks the loss spans; ``read_back`` parses the rendering.

Defined results: a null text is empty; a null role is an empty role; a null ``seq`` sorts first; a
null ``conv_id`` is one conversation of its own; events that tie in ``seq`` apply by (kind, role,
text); a repeated ``message`` row opens one message each; a ``delta``, ``edit`` or ``regenerate``
before the first message of its id opens one of its own; other input columns are ignored; an empty
log gives no rows.

A conversation ends up in one row since its rendering is one string. Messages are folded first,
keyed by conversation and message, so that a long stream of deltas is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
#: Every backslash in escaped text starts one of these pairs, so undoing them in reverse order is exact.
TEXT_ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"))


def escape(column: Column, pairs=TEXT_ESCAPES) -> Column:
    """Text in which neither ``<`` nor ``#`` occurs any more (nor ``:`` in roles)."""
    for plain, coded in pairs:
        column = F.replace(column, F.lit(plain), F.lit(coded))
    return column


def unescape(column: Column, pairs=TEXT_ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        column = F.replace(column, F.lit(coded), F.lit(plain))
    return column


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of each conversation: conv_id, pos, msg, part, role, text; see the module's rules."""
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "edit", 1).when(F.col("kind") == "regenerate", 2).otherwise(3)
    log = events.select(
        "conv_id", "seq", "msg", "role", F.coalesce("text", F.lit("")).alias("text"),
        (F.col("kind") == "message").alias("opens"), (F.col("kind") == "regenerate").alias("redo"), rank.alias("kind_rank"),
    )
    order = Window.partitionBy("conv_id", "msg").orderBy(F.asc_nulls_first("seq"), "kind_rank", F.asc_nulls_first("role"), "text")
    log = log.withColumn("ord", F.row_number().over(order))
    opened = F.sum(F.when(F.col("opens"), 1).otherwise(0))
    log = log.withColumn("part", opened.over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    step = F.struct("ord", (F.col("kind_rank") < 3).alias("resets"), "text")
    folded = log.groupBy("conv_id", "msg", "part").agg(
        F.min(F.struct(F.col("ord"), F.col("seq"))).getField("seq").alias("pos"),
        F.max(F.when(F.col("redo"), F.col("seq"))).alias("redone"),
        F.max(F.struct(F.col("role").isNotNull(), F.col("ord"), F.col("role"))).getField("role").alias("role"),
        F.sort_array(F.collect_list(step)).alias("steps"),
    )
    since = F.coalesce(F.array_max(F.transform(F.filter("steps", lambda s: s["resets"]), lambda s: s["ord"])), F.lit(0))
    text = F.array_join(F.transform(F.filter("steps", lambda s: s["ord"] >= F.col("since")), lambda s: s["text"]), "")
    folded = folded.withColumn("since", since).withColumn("text", text)
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("pos"), F.asc_nulls_first("msg"), "part")
    earlier = F.max("redone").over(before.rowsBetween(Window.unboundedPreceding, -1))
    kept = folded.withColumn("withdrawn", F.coalesce(earlier > F.col("pos"), F.lit(False))).filter(~F.col("withdrawn"))
    return kept.select("conv_id", "pos", "msg", "part", F.coalesce("role", F.lit("")).alias("role"), "text")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss_spans as (start, length) in code points.

    A span covers the escaped text of one message of ``loss_role``, without marks around it.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("pos"), F.asc_nulls_first("msg"), "part")
    piece = messages.select(
        "conv_id", "pos", "msg", "part", (F.col("role") == loss_role).alias("loss"),
        F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(COLON)).alias("head"), escape(F.col("text")).alias("body"),
    )
    whole = F.concat("head", "body", F.lit(TAIL))
    piece = piece.withColumn("ord", F.row_number().over(order))
    running = F.sum(F.length(whole)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    piece = piece.withColumn("start", running - F.length(whole) + F.length("head")).withColumn("whole", whole)
    rows = piece.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("ord", "whole", "loss", "start", F.length("body").alias("size")))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["size"].alias("length")))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse ``render``'s output: conv_id, turns (array of role and text), loss_text (unescaped), formatted_chars."""
    parts = F.split("formatted", TAIL)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        mark = F.instr(part, COLON)
        role = F.substring(part, F.lit(len(HEAD) + 1), mark - len(HEAD) - 1)
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substring(part, mark + len(COLON), F.length(part))).alias("text"))

    cut = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return rendered.select(
        "conv_id", F.transform(parts, turn).alias("turns"), F.array_join(cut, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The event log of a finished conversation table (conv_id, turn, role, text): one message event a row."""
    return turns.select("conv_id", F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.col("turn").cast("long").alias("msg"), "role", "text")
