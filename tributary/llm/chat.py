"""Chat formatting: conversations as marked text whose segments say whether they count for the loss, in DataFrame operations alone.

A template is data: the marks around a turn, a machine over roles, and the roles that are learnt. The machine's state is that which the last turn led to; a turn
without a transition is a fault, after which the machine goes on as the turn's role alone would have it. Texts are escaped so that no mark stands in them, and the
formatted text can be read back to the very turns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """opens, closes: marks of a turn, which begin with lead; a line feed ends the role. moves: the state that a role leads to, by state; state "" is the beginning.
    after: the state of a role that came without a transition; another role's is the beginning. ends: states in which a conversation is complete. learnt: roles whose texts count for the loss."""

    opens: str = "<|im_start|>"
    closes: str = "<|im_end|>"
    lead: str = "<|"
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user", "tool": "tool"}, "tool": {"assistant": "assistant", "tool": "tool"}})
    after: dict[str, str] = field(default_factory=lambda: {"system": "system", "user": "user", "assistant": "assistant", "tool": "tool"})
    ends: tuple[str, ...] = ("assistant",)
    learnt: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if len(self.lead) < 2 or "\\" in self.lead or self.lead[0] in self.lead[1:] or not (self.opens.startswith(self.lead) and self.closes.startswith(self.lead)):
            raise ValueError("marks must begin with lead, two characters or more of which the first isn't met again, none a backslash")
        if self.opens == self.closes or self.lead in self.opens[1:] or self.lead in self.closes[1:]:
            raise ValueError("marks must differ, and lead must stand at their beginning alone")


def escaped(text: Column, t: Template) -> Column:
    """Text in which lead doesn't stand: a backslash more after its first character, wherever only backslashes are between that and the rest."""
    a, b = re.escape(t.lead[0]), re.escape(t.lead[1:])
    return F.when(F.contains(text, F.lit(t.lead[1:])), F.regexp_replace(text, rf"({a}\\*)({b})", r"$1\\$2")).otherwise(text)


def unescaped(text: Column, t: Template) -> Column:
    a, b = re.escape(t.lead[0]), re.escape(t.lead[1:])
    return F.when(F.contains(text, F.lit("\\" + t.lead[1:])), F.regexp_replace(text, rf"({a})\\(\\*{b})", "$1$2")).otherwise(text)


def _line(role: Column) -> Column:
    """A role on one line, reversibly."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _lines(role: Column) -> Column:
    return F.when(F.contains(role, F.lit("\\")), F.array_join(F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")).otherwise(role)


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]) if pairs else F.create_map().cast("map<string,string>")


def turn_segments(role: Column, text: Column, t: Template) -> Column:
    """The segments (text, loss) of a turn: its head, what was said, its end."""
    quiet = lambda x: F.struct(x.alias("text"), F.lit(False).alias("loss"))
    head = F.concat(F.lit(t.opens), escaped(_line(role), t), F.lit("\n"))
    return F.array(quiet(head), F.struct(escaped(text, t).alias("text"), role.isin(*t.learnt).alias("loss")), quiet(F.lit(t.closes + "\n")))


def segments(turns: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each segment: conv_id, turn, part (1, 2, 3), text, loss. Nothing is gathered or shuffled, so a conversation may be of any size.

    Null roles and texts are empty ones; equal rows give equal segments, no rows none; other columns are not read.
    """
    parts = turn_segments(F.coalesce(role, F.lit("")), F.coalesce(text, F.lit("")), template)
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.posexplode(parts).alias("part", "x"))
    return rows.select("conv_id", "turn", (F.col("part") + 1).alias("part"), "x.text", "x.loss")


def walked(roles: Column, state: Column, t: Template) -> Column:
    """(state, faults) of the machine after an array of roles, from a state."""
    moves = _table({f"{s}\n{r}": n for s, by in t.moves.items() for r, n in by.items()})
    after = _table(t.after)

    def step(now: Column, role: Column) -> Column:
        to = F.try_element_at(moves, F.concat(now["state"], F.lit("\n"), role))
        return F.struct(F.coalesce(to, F.try_element_at(after, role), F.lit("")).alias("state"), (now["faults"] + F.when(to.isNull(), 1).otherwise(0)).cast("long").alias("faults"))

    return F.aggregate(roles, F.struct(state.alias("state"), F.lit(0).cast("long").alias("faults")), step)


def verdicts(turns: DataFrame, template: Template = Template(), block: int = 4096, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_faults, complete) of each conversation; only roles are shuffled, and a conversation in blocks of so many turn numbers.

    A block is walked from every state that the machine has; the blocks' results are then applied one after another. Null ids are one conversation; turns are
    ordered by number, null first, then role; no rows give none.
    """
    states = sorted({"", *template.moves, *(n for by in template.moves.values() for n in by.values()), *template.after.values()})
    said = turns.select(F.col(conv_id).alias("conv_id"), F.floor(F.col(turn) / block).alias("b"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role")).alias("x"))
    parts = said.groupBy("conv_id", "b").agg(F.sort_array(F.collect_list("x")).alias("x")).select("conv_id", "b", F.size("x").cast("long").alias("n"), F.transform("x", lambda x: x["role"]).alias("roles"))
    ways = F.map_from_arrays(F.array(*map(F.lit, states)), F.array(*[walked(F.col("roles"), F.lit(s), template) for s in states]))
    parts = parts.select("conv_id", F.struct("b", "n", ways.alias("ways")).alias("x"))

    def on(now: Column, x: Column) -> Column:
        way = F.try_element_at(x["ways"], now["state"])
        return F.struct((now["n"] + x["n"]).alias("n"), way["state"].alias("state"), (now["faults"] + way["faults"]).alias("faults"))

    # maps have no order, so blocks are ordered by their number alone
    ordered = F.array_sort(F.collect_list("x"), lambda p, q: F.when(p["b"].eqNullSafe(q["b"]), 0).when(p["b"].isNull() | (p["b"] < q["b"]), -1).otherwise(1))
    last = F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("n"), F.lit("").alias("state"), F.lit(0).cast("long").alias("faults")), on)
    return parts.groupBy("conv_id").agg(last.alias("x")).select("conv_id", F.col("x.n").alias("n_turns"), F.col("x.faults").alias("n_faults"), F.col("x.state").isin(*template.ends).alias("complete"))


def formatted(turns: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: conv_id, segments (text, loss) in the order of turns, n_faults, complete. The segments' texts, one after another, are the formatted conversation.

    A conversation is an example to learn from and so a row, of up to 2 GB; longer ones, and verdicts on them, are had by segments() and verdicts(), which gather no texts.
    Null ids are one conversation, null roles and texts are empty; turns are ordered by number, null first, then role and text; no rows give none; other columns are not read.
    The texts are shuffled once.
    """
    said = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("x"))
    rows = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    end = walked(F.transform("x", lambda x: x["role"]), F.lit(""), template)
    parts = F.flatten(F.transform("x", lambda x: turn_segments(x["role"], x["text"], template)))
    return rows.select("conv_id", parts.alias("segments"), end.alias("end")).select("conv_id", "segments", F.col("end.faults").alias("n_faults"), F.col("end.state").isin(*template.ends).alias("complete"))


def whole(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda x: x["text"]), "")


def learnt(segments: Column, t: Template) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescaped(x["text"], t)), "")


def read_turns(text: Column, t: Template) -> Column:
    """The turns (role, text) of a formatted conversation, from its text alone."""
    pieces = F.filter(F.split(text, re.escape(t.opens)), lambda p, i: i > 0)
    role = lambda p: F.substring_index(p, "\n", 1)
    tail = len(t.closes) + 1
    said = lambda p: F.substr(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 1 - tail)
    return F.transform(pieces, lambda p: F.struct(_lines(unescaped(role(p), t)).alias("role"), unescaped(said(p), t).alias("text")))


def round_trip(turns: DataFrame, template: Template = Template(), **columns: str) -> DataFrame:
    """What the formatted conversations say when read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_faults, complete."""
    done = formatted(turns, template, **columns).select("conv_id", "n_faults", "complete", whole(F.col("segments")).alias("text"), learnt(F.col("segments"), template).alias("learnt"))
    done = done.select("conv_id", "n_faults", "complete", "learnt", F.length("text").cast("long").alias("formatted_chars"), read_turns(F.col("text"), template).alias("turns"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256)
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars", "n_faults", "complete")
