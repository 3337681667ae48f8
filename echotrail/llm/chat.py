"""Chat formatting: a state machine over roles and a declarative template. DataFrame functions only.

A template names, for every role, the control strings around its text and whether the text counts in the
loss. Texts are escaped, so that no control string of the template ever stands in one, and the whole
formatted conversation can be cut at the closing strings and turned back. The state machine reads the roles
in order and says whether the turns come as the template expects, and if not, at which turn they stop to.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import name
from echotrail.operators.ordered import ordered_chunks


@dataclass(frozen=True)
class Turn:
    """What stands around the text of a role, and whether its text counts in the loss."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles, control strings and the machine that says which role may follow which.

    ``machine`` maps a state to the roles it takes and the state after each; any other role leads to a state
    that nothing leaves. ``final`` are the states in which a conversation may end. A role that ``turns`` does
    not name is written between ``role_open`` and ``role_close`` and its text goes up to ``other_close``.
    """

    begin: str = "<s>"
    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("", "</s>", loss=True),
    })
    role_open: str = "[ROLE]"
    role_close: str = "[/ROLE]"
    other_close: str = "[/TURN]"
    escape: str = "~"
    machine: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    final: tuple[str, ...] = ("start", "answered")

    def __post_init__(self):
        if len(self.escape) != 1 or any(self.escape in c for c in self.controls):
            raise ValueError("the escape must be one character that no control string holds")
        for c in self.controls:
            if any(first in c[1:] for first in self.firsts):
                raise ValueError(f"{c}: the first character of a control string may stand nowhere else in one")
        if len(set(self.closes)) < len(self.closes) or "" in self.closes:
            raise ValueError("every role needs a closing string of its own")

    @property
    def closes(self) -> list[str]:
        return [t.close for t in self.turns.values()] + [self.other_close]

    @property
    def controls(self) -> list[str]:
        """All control strings, each once."""
        named = [self.begin, self.role_open, self.role_close, self.other_close]
        return sorted({c for c in named + [s for t in self.turns.values() for s in (t.open, t.close)] if c})

    @property
    def firsts(self) -> list[str]:
        return sorted({c[0] for c in self.controls})

    def _escapes(self) -> list[tuple[str, str]]:
        """Per first character: itself and the rests of its control strings, both as patterns."""
        return [(re.escape(f), "|".join(re.escape(c[1:]) for c in self.controls if c[0] == f)) for f in self.firsts]

    def escaped(self, text: Column) -> Column:
        """``text`` with one escape behind the first character of every control string, escaped ones too."""
        e = re.escape(self.escape)
        for first, rests in self._escapes():
            text = F.regexp_replace(text, f"({first})({e}*(?:{rests}))", f"$1{self.escape}$2")
        return text

    def unescaped(self, text: Column) -> Column:
        e = re.escape(self.escape)
        for first, rests in self._escapes():
            text = F.regexp_replace(text, f"({first}){e}({e}*(?:{rests}))", "$1$2")
        return text


DEFAULT = Template()


def _states(template: Template) -> list[str]:
    """States of the machine in order of their numbers; the last one is the state of broken order."""
    seen = list(template.machine)
    for after in template.machine.values():
        seen += [s for s in after.values() if s not in seen]
    return seen + ["broken"]


def _table(template: Template) -> Column:
    """Transitions as one array: state * (roles + 1) + role, the last role being any other."""
    states, roles = _states(template), list(template.turns)
    cells = []
    for s in states:
        after = template.machine.get(s, {})
        cells += [states.index(after[r]) if r in after else len(states) - 1 for r in roles] + [len(states) - 1]
    return F.array(*[F.lit(c) for c in cells])


def turns(df: DataFrame, template: Template = DEFAULT, conv_col: str = "conv_id", turn_col: str = "turn",
          role_col: str = "role", text_col: str = "text", chunk_rows: int | None = None) -> DataFrame:
    """One row per turn: ``conv_id, pos, role, code, segments`` and ``_chunk``.

    ``segments`` is an array of text and loss flag: the opening control strings, the escaped text and the
    closing one. Turns of a conversation come by turn (null first), then role and text; ``pos`` counts them
    from 1. Null role and text are empty, null conversation ids are one conversation, repeated rows are
    turns of their own, roles that the template does not name are written out and escaped like texts.
    Rows are dealt by conversation if each fits a chunk, else by ranges of (conversation, turn).
    """
    role, text = F.coalesce(name(role_col).cast("string"), F.lit("")), F.coalesce(name(text_col).cast("string"), F.lit(""))
    rows = df.select(name(conv_col).alias("conv_id"), name(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = ordered_chunks(rows, ["conv_id"], order, halo=0, rows=chunk_rows).drop("_own", "turn")
    code, opened, closed, loss = F.lit(len(template.turns)), None, None, F.lit(False)
    opened = F.concat(F.lit(template.role_open), template.escaped(F.col("role")), F.lit(template.role_close))
    closed = F.lit(template.other_close)
    for i, (r, t) in enumerate(template.turns.items()):
        mine = F.col("role") == r
        code = F.when(mine, i).otherwise(code)
        opened = F.when(mine, t.open).otherwise(opened)
        closed = F.when(mine, t.close).otherwise(closed)
        loss = F.when(mine, t.loss).otherwise(loss)
    opened = F.concat(F.when(F.col("pos") == 1, template.begin).otherwise(""), opened)
    segment = lambda part, flag: F.struct(part.alias("text"), flag.alias("loss"))
    return placed.select(
        "conv_id", "_chunk", "pos", "role", code.alias("code"),
        F.array(segment(opened, F.lit(False)), segment(template.escaped(F.col("text")), loss), segment(closed, F.lit(False))).alias("segments"))


def segments(df: DataFrame, template: Template = DEFAULT, **columns) -> DataFrame:
    """One row per segment: ``conv_id, pos, part, text, loss``. No task holds more than a chunk of a conversation."""
    parts = turns(df, template, **columns).select("conv_id", "pos", F.posexplode("segments").alias("part", "segment"))
    return parts.select("conv_id", "pos", "part", "segment.text", "segment.loss")


def chats(df: DataFrame, template: Template = DEFAULT, learn_after_break: bool = True, **columns) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, marks, order_ok, first_bad``.

    ``marks`` holds per turn where its loss text begins behind the turn's start and how many code points it
    has (0: none). ``first_bad`` is the position of the first turn that the machine does not take, null if
    there is none; ``order_ok`` also wants a final state at the end. With ``learn_after_break`` false,
    turns from ``first_bad`` on bear no loss. An empty table gives an empty result.

    Each chunk is folded from every state of the machine, and chunks are then chained, so the order of a
    conversation of any length is checked in pieces. The formatted text itself is one value per conversation.
    """
    states = _states(template)
    width, broken = len(template.turns) + 1, len(states) - 1
    table = _table(template)

    def step(run: Column, turn: Column) -> Column:
        after = F.get(table, run["state"] * width + turn["code"])
        bad = F.coalesce(run["bad"], F.when((after == broken) & (run["state"] != broken), turn["pos"]))
        return F.struct(after.alias("state"), bad.alias("bad"))

    nothing = F.lit(None).cast("long")
    begin = F.array(*[F.struct(F.lit(s).alias("state"), nothing.alias("bad")) for s in range(len(states))])
    loss = F.exists("segments", lambda s: s["loss"])
    before = F.char_length(F.get("segments", F.lit(0))["text"])
    inside = F.char_length(F.get("segments", F.lit(1))["text"])
    lines = turns(df, template, **columns).select(
        "conv_id", "_chunk", F.struct(
            "pos", "code", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"),
            before.alias("skip"), F.when(loss, inside).otherwise(0).alias("size")).alias("line"))
    chunks = lines.groupBy("conv_id", "_chunk").agg(F.sort_array(F.collect_list("line")).alias("lines")).select(
        "conv_id", "_chunk", F.size("lines").alias("n"),
        F.array_join(F.transform("lines", lambda x: x["text"]), "").alias("text"),
        F.transform("lines", lambda x: F.struct(x["pos"].alias("pos"), x["skip"].alias("skip"), x["size"].alias("size"))).alias("marks"),
        F.aggregate("lines", begin, lambda runs, x: F.transform(runs, lambda r: step(r, x))).alias("runs"))
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_chunk", "n", "text", "marks", "runs"))).alias("chunks"))
    first = F.struct(F.lit(0).alias("state"), nothing.alias("bad"))

    def chain(run: Column, chunk: Column) -> Column:
        end = F.get(chunk["runs"], run["state"])
        return F.struct(end["state"].alias("state"), F.coalesce(run["bad"], end["bad"]).alias("bad"))

    checked = whole.withColumn("end", F.aggregate("chunks", first, chain))
    marks = F.flatten(F.transform("chunks", lambda c: c["marks"]))
    if not learn_after_break:
        marks = F.transform(marks, lambda m: F.struct(
            m["pos"], m["skip"], F.when(m["pos"] >= F.col("end.bad"), 0).otherwise(m["size"]).alias("size")))
    fine = F.col("end.state").isin([states.index(s) for s in template.final])
    return checked.select(
        "conv_id", F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + c["n"]).alias("n_turns"),
        F.array_join(F.transform("chunks", lambda c: c["text"]), "").alias("formatted"), marks.alias("marks"),
        fine.alias("order_ok"), F.col("end.bad").alias("first_bad"))


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Adds ``turns`` (role and text of each turn) and ``loss_texts``, both read from ``formatted`` and ``marks``.

    The text is cut behind every closing string. A piece tells its role by the string that closes it; what
    the marks cover is the text that counts in the loss.
    """
    cut = "(?<=" + "|".join(re.escape(c) for c in template.closes) + ")"
    body = F.col("formatted").substr(F.lit(len(template.begin) + 1), F.char_length("formatted"))
    pieces = F.filter(F.split(body, cut), lambda p: p != "")

    def between(piece: Column, opened: Column, closed: str) -> Column:
        start = F.char_length(opened)
        return piece.substr(start + 1, F.char_length(piece) - start - len(closed))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, template.role_close, 1)
        opened = F.concat(head, F.lit(template.role_close))
        role = template.unescaped(head.substr(F.lit(len(template.role_open) + 1), F.char_length(head)))
        text = between(piece, opened, template.other_close)
        for r, t in template.turns.items():
            mine = piece.endswith(t.close)
            role = F.when(mine, F.lit(r)).otherwise(role)
            text = F.when(mine, between(piece, F.lit(t.open), t.close)).otherwise(text)
        return F.struct(role.alias("role"), template.unescaped(text).alias("text"))

    cutting = formatted.withColumn("_pieces", pieces)
    covered = F.zip_with("_pieces", "marks", lambda p, m: template.unescaped(
        p.substr(m["skip"] + 1 - F.when(m["pos"] == 1, len(template.begin)).otherwise(0), m["size"])))
    return cutting.withColumns({"turns": F.transform("_pieces", turn), "loss_texts": covered}).drop("_pieces")


def chat_report(df: DataFrame, template: Template = DEFAULT, **columns) -> DataFrame:
    """Per conversation, from what is read back: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, order_ok, first_bad``."""
    back = read_back(chats(df, template, **columns), template)
    turn_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss_text = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turn_text.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss_text).cast("long").alias("loss_chars"), F.sha2(loss_text.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "order_ok", "first_bad")
