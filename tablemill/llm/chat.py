"""Chat formatting: a finite-state machine over roles and a declarative template, with DataFrame functions only.

The machine's state is the role of the turn before (or the start), so it runs as an ordered aggregate over a conversation's
turns. The template gives each role the literal text around a turn; segments carry a loss flag each: the role's text may count
towards the loss, the literals never do. Control strings that occur inside a text are escaped reversibly, so a turn's text can
neither open nor close a turn, and the formatted text reads back to exactly the turns that went in.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    """What stands around the text of a role, and whether the text counts towards the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role, the control strings that texts must not contain, and the machine's moves.

    ``follows`` names for each state the roles that may come next; "start" is the first state and ``ends`` holds the roles that
    may stand last. Control strings have two characters or more and no backslash, and none may overlap another or itself:
    then a marker cannot arise across the border of a text.
    """

    turns: dict[str, Turn]
    controls: tuple[str, ...]
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    _checked: bool = field(default=True, repr=False)

    def __post_init__(self) -> None:
        for one in self.controls:
            if len(one) < 2 or ESCAPE in one:
                raise ValueError(f"control string {one!r} is too short or contains the escape character")
            for other in self.controls:
                if any(one.endswith(other[:n]) for n in range(1, min(len(one), len(other)) + (one != other))) or (one != other and other in one):
                    raise ValueError(f"control strings {one!r} and {other!r} overlap")
        befores = [turn.before for turn in self.turns.values()]
        for role, turn in self.turns.items():
            if not any(c in turn.after for c in self.controls) or not turn.before:
                raise ValueError(f"the turn of {role!r} needs text before it and a control string after it")
        if any(one != other and one.startswith(other) for one in befores for other in befores):
            raise ValueError("one turn's beginning is the beginning of another's")


#: Instruction markup in the manner of open chat models. Fixed values of the format.
INSTRUCT = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Turn("<s>[INST] ", " [/INST]"),
        "assistant": Turn(" ", " </s>", loss=True),
    },
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"),
    follows={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("user", "assistant"),
)


def escape(text: Column, template: Template) -> Column:
    """Backslashes doubled, and one backslash put behind the first character of every control string."""
    controls = "|".join(re.escape(c[1:]).join((f"(?<={re.escape(c[0])})(?=", ")")) for c in sorted(template.controls, key=len, reverse=True))
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit(controls), F.lit(ESCAPE * 2))


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: a pair of backslashes is one, a single one goes."""
    return F.regexp_replace(text, F.lit(r"\\(\\?)"), F.lit("$1"))


def format_chats(rows: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: (conv_col, segments, formatted, valid, bad_turn).

    ``segments`` is an array of (text, loss) whose texts joined are ``formatted``. ``valid`` tells whether the machine accepts the
    order of roles; ``bad_turn`` is the place (from 0) of the first turn it refuses, or the number of turns where only the end
    is wrong. A conversation out of order is formatted all the same; with a role that the template doesn't have (null, for one)
    ``segments`` and ``formatted`` are null. Turns go by number, then role and text, null first; repeated rows are turns of their
    own; a null text counts as empty; rows with a null conversation id form one conversation. A conversation is one output value and so
    meets in one task. An empty table gives an empty result; other columns are not read.
    """
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    chats = rows.select(F.col(f"`{conv_col}`").alias("conv"), turn.alias("turn")).groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    moves = [f"{state}>{role}" for state, roles in template.follows.items() for role in roles]
    stays = F.transform(F.col("turns"), lambda t, i: F.when(
        F.concat(F.when(i == 0, F.lit("start")).otherwise(F.get(F.col("turns.role"), i - 1)), F.lit(">"), t["role"]).isin(moves), F.lit(None)).otherwise(i))
    last = F.get(F.col("turns.role"), F.size("turns") - 1)
    bad = F.coalesce(F.array_min(stays), F.when(~F.coalesce(last.isin(list(template.ends)), F.lit(False)), F.size("turns")))

    def pieces(t: Column) -> Column:
        shape = None
        for role, around in template.turns.items():
            made = F.array(*[F.struct(text.alias("text"), F.lit(loss).alias("loss")) for text, loss in
                             ((F.lit(around.before), False), (escape(t["text"], template), around.loss), (F.lit(around.after), False))])
            shape = F.when(t["role"] == role, made) if shape is None else shape.when(t["role"] == role, made)
        return shape

    segments = F.flatten(F.transform(F.col("turns"), pieces))  # null as soon as one turn has no shape
    chats = chats.select("conv", bad.alias("bad_turn"), segments.alias("segments"))
    return chats.select(F.col("conv").alias(conv_col), "segments", F.array_join(F.col("segments.text"), "").alias("formatted"),
                        F.col("bad_turn").isNull().alias("valid"), "bad_turn")


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """array<struct<role, text>> of the turns of a formatted text, unescaped."""
    shapes = [f"{re.escape(t.before)}.*?{re.escape(t.after)}" for t in template.turns.values()]
    found = F.regexp_extract_all(formatted, F.lit(f"(?s){'|'.join(shapes)}"), F.lit(0))

    def turn(whole: Column) -> Column:
        read = None
        for role, around in template.turns.items():
            inner = F.substring(whole, F.lit(len(around.before) + 1), F.length(whole) - (len(around.before) + len(around.after)))
            value = F.struct(F.lit(role).alias("role"), unescape(inner).alias("text"))
            test = F.startswith(whole, F.lit(around.before))
            read = F.when(test, value) if read is None else read.when(test, value)
        return read

    return F.transform(found, turn)


def chat_digests(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What can be read back from the formatted conversations, as digests: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    valid). Null digests where a conversation could not be formatted."""
    chats = format_chats(rows, template).withColumn("read", read_turns(F.col("formatted"), template))
    masked = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    listing = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    chats = chats.select("conv_id", F.when(F.col("formatted").isNotNull(), F.size("read")).cast("bigint").alias("n_turns"), F.sha2(listing, 256).alias("turns_sha256"),
                         masked.alias("masked"), F.length("formatted").cast("bigint").alias("formatted_chars"), "valid")
    return chats.select("conv_id", "n_turns", "turns_sha256", F.length("masked").cast("bigint").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars", "valid")
