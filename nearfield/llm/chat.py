"""Chat formatting (operator 2), in DataFrame functions only.

A ``Template`` declares how a turn is written and which roles are trained on;
``TURN_ORDER`` is the finite-state machine over roles.  A conversation's turns
(ordered by turn, then role and text) become one string, and segments
``(text, loss)`` whose texts joined are that string.

Escaping: in a text each ``<`` followed by n backslashes and ``|`` gets one
backslash more, so no escaped text holds a control string, and taking one
backslash away again gives the text back.  In a role, backslash and newline are
escaped too, as a newline ends the role.

Defined results: a null text or role is an empty one; a conversation without a
turn doesn't exist; a null conv_id is a conversation of its own; a sequence of
roles that the machine refuses is formatted all the same, with valid = false.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: State -> role -> next state; START is before the first turn.  Other roles are refused.
TURN_ORDER = {
    "START": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}
#: A conversation may end after these.
FINAL = ("assistant", "user")


@dataclass(frozen=True)
class Template:
    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>\n"
    trained: tuple[str, ...] = field(default=("assistant",))


CHATML = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def unescape_role(role: Column) -> Column:
    # an escaped backslash is set aside, so that it isn't taken for the start of \n
    aside = F.regexp_replace(unescape(role), r"\\\\", "\x00")
    return F.regexp_replace(F.regexp_replace(aside, r"\\n", "\n"), "\x00", r"\\")


def turns_valid(roles: Column) -> Column:
    """Whether the machine accepts an array of roles."""
    steps = [F.lit(x) for state, after in TURN_ORDER.items() for role, to in after.items() for x in (f"{state}>{role}", to)]
    table = F.create_map(*steps)
    end = F.aggregate(roles, F.lit("START"), lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit(">"), role)), F.lit("refused")))
    return end.isin(*FINAL)


def format_chats(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>, valid."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def parts(t: Column) -> Column:
        head = F.concat(F.lit(template.before_role), escape_role(t.role), F.lit(template.after_role))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t.text).alias("text"), t.role.isin(*template.trained).alias("loss")),
            F.struct(F.lit(template.after_text).alias("text"), F.lit(False).alias("loss")),
        )

    chats = chats.select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"), turns_valid(F.transform("turns", lambda t: t.role)).alias("valid"))
    return chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments", "valid")


def read_chats(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, turns array<struct<role, text>> read back from ``formatted`` alone, and
    loss_texts, the trained texts unescaped, read from the segments."""
    pieces = F.slice(F.split("formatted", r"\Q" + template.before_role + r"\E", -1), 2, F.lit(1 << 30))

    def turn(piece: Column) -> Column:
        cut = F.length(F.substring_index(piece, template.after_role, 1))
        body = F.substr(piece, cut + len(template.after_role) + 1, F.length(piece) - cut - len(template.after_role) - len(template.after_text))
        return F.struct(unescape_role(F.substring_index(piece, template.after_role, 1)).alias("role"), unescape(body).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text))
    return formatted.select("*", F.transform(pieces, turn).alias("turns"), loss.alias("loss_texts"))


def report(read: DataFrame) -> DataFrame:
    """The digests of what ``read_chats`` gives."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
