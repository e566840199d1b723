"""Chats rebuilt from event logs and rendered with a reversible template.

An event tells of one message: ``message`` sets its role and text, ``delta`` adds to its text,
``edit`` replaces the text, ``regenerate`` throws the text away so that later deltas write it anew,
and ``delete`` takes the message out. Only what follows the last event that sets the text matters,
so the log is folded by message, not by conversation: the last such event is an aggregate that is
combined before the shuffle, and deltas are joined in blocks. Rendering goes in blocks of turns too,
and only the finished blocks of a conversation meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Turns or deltas that are joined in one step.
BLOCK = 256
# The template: a turn is TURN role TEXT text END, or TURN role LOSS text END if the text is to be learned.
TURN, TEXT, LOSS, END = "<|turn|>", "<|text|>", "<|loss|>", "<|end|>"
# Strings that may control a model or this template; none is left in a rendered role or text.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """``~`` becomes ``~0`` and the k-th control string ``~k``; at most 9 strings (ValueError)."""
    if len(control) > 9:
        raise ValueError("at most 9 control strings")
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    for k, word in enumerate(control, 1):
        text = F.replace(text, F.lit(word), F.lit(f"~{k}"))
    return text


def unescaped(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """The text that ``escaped`` was given."""
    for k, word in reversed(list(enumerate(control, 1))):
        text = F.replace(text, F.lit(f"~{k}"), F.lit(word))
    return F.replace(text, F.lit("~0"), F.lit("~"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, position, role, text): the final messages of a log.

    ``events`` has conv_id, message (any orderable type), position, seq, kind, role and text; the
    order of a conversation's messages is by their first known position. An unknown kind raises
    an error. Deltas before the last ``message``, ``edit`` or ``regenerate`` are void; a message of
    deltas only starts empty. Events of equal ``seq`` apply in the order of the kinds above. NULL
    ids and messages are keys like any other.
    """
    order = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "delta", 1).when(F.col("kind") == "edit", 2)
    order = order.when(F.col("kind") == "regenerate", 3).when(F.col("kind") == "delete", 4)
    known = F.coalesce(order, F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("NULL")))).cast("int"))
    told = events.select(
        # NULL keys are joined like any other below.
        F.struct(F.col("conv_id")).alias("conv"), F.struct(F.col("message")).alias("of"),
        "position", F.struct(F.col("seq"), known.alias("order")).alias("at"), "kind", "role", F.coalesce("text", F.lit("")).alias("text"),
    )
    sets = F.col("kind").isin("message", "edit", "regenerate")
    text = F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text"))
    messages = told.groupBy("conv", "of").agg(
        F.min("position").alias("position"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"),
        F.max(F.when(sets, F.struct("at", text.alias("text")))).alias("base"),
        F.max(F.when(F.col("kind") == "delete", F.col("at"))).alias("gone"),
        F.max(F.when(F.col("kind") == "delta", F.struct("at"))).alias("delta"),
    )
    alive = messages.where("gone is null or (base is not null and base.at > gone)")
    # Only messages that go on after their base are joined with their deltas.
    going = alive.where("delta is not null and (base is null or delta.at > base.at)")
    later = (
        told.where("kind = 'delta'")
        .join(going.select("conv", "of", F.col("base.at").alias("since")), ["conv", "of"])
        .where("since is null or at > since")
        .groupBy("conv", "of", F.floor(F.col("at.seq") / BLOCK).alias("block"))
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "text")))["text"], "").alias("text"))
        .groupBy("conv", "of")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "text")))["text"], "").alias("later"))
    )
    return alive.join(later, ["conv", "of"], "left").select(
        "conv.conv_id", "of.message", "position", "role",
        F.concat(F.coalesce("base.text", F.lit("")), F.coalesce("later", F.lit(""))).alias("text"),
    )


def render(messages: DataFrame, learned: tuple[str, ...] = ("assistant",), control: tuple[str, ...] = CONTROL) -> DataFrame:
    """(conv_id, formatted): one string per conversation, turns by position, then role, text and message.

    A NULL position comes last, a NULL role or text is empty.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    mark = F.when(role.isin(*learned), LOSS).otherwise(TEXT)
    turn = F.concat(F.lit(TURN), escaped(role, control), mark, escaped(text, control), F.lit(END))
    blocks = messages.groupBy("conv_id", F.floor(F.col("position") / BLOCK).alias("block")).agg(
        F.array_sort(
            F.collect_list(F.struct("position", role.alias("role"), text.alias("text"), "message", turn.alias("turn")))
        )["turn"].alias("turns")
    )
    part = F.struct(F.col("block").isNull().alias("last"), "block", F.array_join("turns", "").alias("part"))
    return blocks.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(part))["part"], "").alias("formatted"))


def turns_of(formatted: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """array(struct(role, text, loss)) read back from a rendered conversation."""
    turns = F.filter(F.split(formatted, _quoted(END)), lambda t: t != "")

    def read(turn: Column) -> Column:
        halves = F.split(turn, f"{_quoted(TEXT)}|{_quoted(LOSS)}", 2)
        return F.struct(
            unescaped(F.substring(halves[0], len(TURN) + 1, 2**31 - 1), control).alias("role"),
            unescaped(halves[1], control).alias("text"),
            turn.contains(LOSS).alias("loss"),
        )

    return F.transform(turns, read)


def loss_spans(formatted: Column) -> Column:
    """array(struct(start, end)): code points of the rendered string under the loss mask, ends exclusive."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        end = state["at"] + F.length(turn)
        begin = end - F.length(F.element_at(F.split(turn, _quoted(LOSS), 2), -1))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(
            (end + len(END)).cast("bigint").alias("at"),
            F.when(turn.contains(LOSS), F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(F.filter(F.split(formatted, _quoted(END)), lambda t: t != ""), start, add)["spans"]


def _quoted(mark: str) -> str:
    return mark.replace("|", r"\|")


def format_chats(events: DataFrame, learned: tuple[str, ...] = ("assistant",), control: tuple[str, ...] = CONTROL) -> DataFrame:
    """(conv_id, formatted): a log of events folded and rendered. See ``fold_events`` and ``render``.

    An empty log gives an empty table; a conversation whose messages are all deleted is left out.
    """
    return render(fold_events(events), learned, control)
