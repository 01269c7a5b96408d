"""Chat formatting: a role machine validates turn order; a declarative template emits text with loss flags.

A template names the marks around a turn, which roles count for the loss, and the role machine's moves. Nothing else
knows a mark: escaping, splitting and reading back are built from the template. Control strings inside a text are
escaped: a backslash is doubled, and a backslash goes behind the first character of every mark in it, so no mark can
appear in a text and every text can be read back. A role that has no shown name is escaped likewise, with a backslash
in front, so it can't be taken for a shown name. Everything is a DataFrame operation.

Defined results: turns are ordered by (turn, role, text), nulls first; a null role or text is empty; rows
that repeat are turns of their own; a role that the machine has no move for makes the conversation invalid
but it is formatted whole. Rows with a null conv_id form one conversation. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepline.llm.common import sha256_hex


def _overlap(first: str, then: str) -> bool:
    """Whether an occurrence of ``then`` could begin in the end of ``first`` and run into what follows."""
    return any(first.endswith(then[:n]) for n in range(1, len(then)))


@dataclass(frozen=True)
class Template:
    """open + role + close + text + end for each turn; moves: (state, role) to the next state.

    Marks have two characters or more and no backslash; ``close`` and ``end`` can't begin inside the mark before them
    or inside themselves; shown names hold no mark, and are different and not empty. Other templates are refused.
    """

    open: str = "### "
    close: str = ": "
    end: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    shown: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    start: str = "begin"
    accepting: tuple[str, ...] = ("answered",)
    moves: dict = field(
        default_factory=lambda: {
            ("begin", "system"): "briefed",
            ("begin", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )

    def __post_init__(self) -> None:
        marks, names = (self.open, self.close, self.end), list(self.shown.values())
        wrong = [m for m in marks if len(m) < 2 or "\\" in m]
        wrong += [a + b for a, b in ((self.close, self.close), (self.end, self.end), (self.open, self.end), (self.close, self.end)) if _overlap(a, b)]
        wrong += [self.end[k:] for k in range(1, len(self.end)) if self.close.startswith(self.end[k:]) or self.end[k:].startswith(self.close)]
        wrong += [m for m in marks for other in marks if m is not other and m in other]
        wrong += [n for n in names if not n or "\\" in n or any(m in n for m in marks) or _overlap(n, self.close)]
        if wrong or len(set(names)) < len(names):
            raise ValueError(f"marks or names that can't be read back: {wrong or names}")

    @property
    def marks(self) -> tuple[str, ...]:
        """What texts and roles may not hold: the marks, without white space at their ends where two characters stay."""
        return tuple(m.strip() if len(m.strip()) > 1 else m for m in (self.open, self.close, self.end))


def _quoted(text: str) -> str:
    """A pattern of just this text, for Java's expressions."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def escaped(text: Column, template: Template = Template(), in_role: bool = False) -> Column:
    """Texts may hold the mark behind a role; roles may not."""
    out = F.regexp_replace(text, r"\\", r"\\\\")
    for mark in template.marks:
        if in_role or mark != template.marks[1]:
            first, rest = _quoted(mark[0]), _quoted(mark[1:])
            shown = mark[0].replace("$", r"\$")
            out = F.regexp_replace(out, f"{first}(?={rest})", shown + r"\\")
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def segments(turns: Column, template: Template) -> Column:
    """array<struct<text, loss>>: for each turn its opening mark, its text (with the loss flag) and its end."""
    shown = _literal_map(template.shown)

    def of(t: Column) -> Column:
        other = F.when(t["role"] == "", "").otherwise(F.concat(F.lit("\\"), escaped(t["role"], template, True)))
        name = F.coalesce(F.try_element_at(shown, t["role"]), other)
        plain = lambda x: F.struct(x.alias("text"), F.lit(False).alias("loss"))
        return F.array(
            plain(F.concat(F.lit(template.open), name, F.lit(template.close))),
            F.struct(escaped(t["text"], template).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            plain(F.lit(template.end)),
        )

    return F.flatten(F.transform(turns, of))


def machine_state(turns: Column, template: Template) -> Column:
    """The state after all turns; ``error`` from the first turn on that has no move."""
    moves = _literal_map({f"{state}\x00{role}": to for (state, role), to in template.moves.items()})
    return F.aggregate(
        turns,
        F.lit(template.start),
        lambda s, t: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\x00"), t["role"])), F.lit("error")),
    )


def read_back(formatted: Column, template: Template) -> Column:
    """array<struct<role, text>> parsed from the formatted text."""
    roles = _literal_map({name: role for role, name in template.shown.items()})
    pieces = F.filter(F.split(formatted, _quoted(template.end)), lambda x: x != "")

    def of(piece: Column) -> Column:
        turn = F.substr(piece, F.lit(len(template.open) + 1))
        mark = F.substring_index(turn, template.close, 1)
        return F.struct(
            F.coalesce(F.try_element_at(roles, mark), unescaped(mark)).alias("role"),
            unescaped(F.substr(turn, F.length(mark) + len(template.close) + 1)).alias("text"),
        )

    return F.transform(pieces, of)


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation: conv_id, n_turns, valid, segments (text, loss), formatted."""
    clean = conversations.select(
        "conv_id",
        F.struct(
            "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    turns = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    built = turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        machine_state(F.col("turns"), template).isin(*template.accepting).alias("valid"),
        segments(F.col("turns"), template).alias("segments"),
    )
    return built.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What a reader of the output gets back: turns from the formatted text, loss text from the segments."""
    turns = read_back(F.col("formatted"), template)
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), ""
    )
    read = formatted.select(
        "conv_id", "valid", turns.alias("turns"), loss.alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(line).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha256_hex(F.col("loss_text")).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
