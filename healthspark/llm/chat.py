"""Chat formatting: a finite-state machine over roles and a declarative template.

A template gives each role an opening and a closing mark and says whether its text is under the loss.
Formatting emits one segment per mark and text, in order, each with its loss flag. Inside texts every
control string of the template is escaped (a backslash after its first character, and each backslash
doubled), so no text can pass for a mark and parsing gives the texts back exactly.

The machine's states are the last accepted role; `NEXT` lists what may follow. A conversation whose turns
break the order keeps its output and is flagged: `valid` false and `bad_turn`, the first offending turn's
position. One conversation is one training example and is formatted in one row, as a document is.

Input rules: a null text is empty; a null role is the empty name; roles without marks of their own
are written with their (escaped) name; turns are ordered by turn, role, text with nulls first, so ties
and repeated rows have a fixed order and each is kept; a null conv_id is a conversation; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    #: role -> (opening mark, closing mark, text under the loss)
    roles: dict = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>", False),
        "user": ("[INST]", "[/INST]", False),
        "assistant": ("[OUT]", "</s>", True)})
    #: any other role: opening mark, mark between name and text, closing mark
    other: tuple = ("[ROLE]", "[/ROLE]", "[/TURN]")

    def marks(self) -> list[str]:
        return [m for o, c, _ in self.roles.values() for m in (o, c)] + list(self.other)

    def __post_init__(self):
        marks = self.marks()
        if len(set(marks)) < len(marks) or any("\\" in m or len(m) < 2 for m in marks):
            raise ValueError("marks differ, have two characters at least and no backslash")
        for a in marks:
            for b in marks:
                # no mark may be completed by text beside another mark, nor hide in one
                if (a != b and a in b) or any(a[i:] == b[:len(a) - i] or a[:i] == b[-i:] for i in range(1, len(a))):
                    raise ValueError(f"marks {a!r} and {b!r} overlap")


DEFAULT = Template()
#: state -> roles that may come next
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def escape(text: Column, template: Template) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.marks():
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _machine(turns: Column) -> Column:
    """Position of the first turn that breaks the order, or null."""
    def step(acc, turn):
        state, bad, at = acc["state"], acc["bad"], acc["at"]
        ok = F.lit(False)
        for last, following in NEXT.items():
            ok = ok | ((state == last) & turn["role"].isin(*following))
        return F.struct(F.when(ok, turn["role"]).otherwise(state).alias("state"),
                        F.coalesce(bad, F.when(~ok, at)).alias("bad"), (at + 1).alias("at"))

    start = F.struct(F.lit("").alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("at"))
    return F.aggregate(turns, start, step, lambda acc: acc["bad"])


def _segments(turn: Column, template: Template) -> Column:
    def seg(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    text = escape(turn["text"], template)
    opening, named, closing = template.other
    out = F.array(seg(F.concat(F.lit(opening), escape(turn["role"], template), F.lit(named)), False),
                  seg(text, False), seg(F.lit(closing), False))
    for role, (opening, closing, loss) in template.roles.items():
        out = F.when(turn["role"] == role, F.array(seg(F.lit(opening), False), seg(text, loss),
                                                   seg(F.lit(closing), False))).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: Template = DEFAULT, conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, valid, bad_turn, segments array<struct<text, loss>>: one row per conversation."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return held.select("conv_id", _machine(F.col("turns")).alias("bad_turn"),
                       F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments")) \
        .select("conv_id", F.col("bad_turn").isNull().alias("valid"), "bad_turn", "segments")


def read_conversations(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Parses formatted output back: conv_id, formatted, turns array<struct<role, text>>, loss_text.

    `turns` come from the marks in the concatenated text alone, `loss_text` from the loss flags.
    """
    whole = F.concat_ws("", F.transform("segments", lambda s: s["text"]))
    pattern = "|".join(f"{re.escape(o)}.*?{re.escape(c)}" for o, c in
                       [(o, c) for o, c, _ in template.roles.values()] + [(template.other[0], template.other[2])])

    def parse(piece: Column) -> Column:
        opening, named, closing = template.other
        name = F.substring_index(piece, named, 1)
        out = F.struct(unescape(F.substr(name, F.lit(len(opening) + 1))).alias("role"),
                       unescape(F.substr(piece, F.length(name) + len(named) + 1,
                                         F.length(piece) - F.length(name) - len(named) - len(closing))).alias("text"))
        for role, (opening, closing, _) in template.roles.items():
            inner = F.substr(piece, F.lit(len(opening) + 1), F.length(piece) - len(opening) - len(closing))
            out = F.when(F.startswith(piece, F.lit(opening)),
                         F.struct(F.lit(role).alias("role"), unescape(inner).alias("text"))).otherwise(out)
        return out

    loss = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])))
    return formatted.withColumn("formatted", whole).withColumn(
        "turns", F.transform(F.regexp_extract_all("formatted", F.lit(f"(?s){pattern}"), F.lit(0)), parse)).select(
        "conv_id", "valid", "formatted", "turns", loss.alias("loss_text"))


def conversation_digest(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """n_turns, digests and lengths of what is read back from the formatted output."""
    back = read_conversations(formatted, template)
    spoken = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
