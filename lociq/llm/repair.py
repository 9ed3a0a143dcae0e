"""Conversation repair: cheapest edits that make a conversation's roles alternate.

Rows are dealt out by conversation once.  Inside a task they are sorted from the last turn to the
first, and a pass over the Arrow batches carries, for each of four states of the dialogue, the
cost of finishing it from there.  The best edit of each state takes two bits, so a row's
backpointers are one byte, which is written onto the row.  Spark's sorter then puts the rows back
into turn order, spilling them where they don't fit, and a second pass follows the backpointers
from the first turn, hashing the repaired text as it goes.  Neither pass holds a conversation: the
state between two batches is a few numbers, and the only thing that grows is the audit string.

States: nothing yet, after a leading system turn, after a user turn, after an assistant turn.  In
every state one role alone can come next, so an edit's letter also says which role it writes, and
the smallest letter among the cheapest edits of each step gives the ASCII-least audit.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from lociq.llm.common import plain

# The Python steps travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

START, SYSTEM, USER, ASSISTANT = range(4)
#: Role that an inserted or re-roled turn gets in each state, and the state after it.
WRITTEN = ("user", "user", "assistant", "user")
AFTER = (USER, USER, ASSISTANT, USER)
#: Turns that still have to be inserted at the end.
MISSING = (0, 2, 1, 0)
#: State after keeping a turn, by role initial; an empty role has no initial and changes nothing.
KEPT = {
    "s": (SYSTEM, None, None, None),
    "u": (USER, USER, None, USER),
    "a": (None, None, ASSISTANT, None),
    "": (START, SYSTEM, USER, ASSISTANT),
    "?": (None, None, None, None),
}
INITIALS = list(KEPT)
INSERT_COST, DELETE_COST, REROLE_COST, TRUNCATED_COST = 2, 3, 2, 1
LETTERS = "DIKR"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Kind of a row that marks a conversation none of whose turns it holds.
GONE = -1
NEXT_TO = {"su", "ua", "au"}

_SPACE = " \t\n\x0b\x0c\r"


def row_kind(role: Column, fault: Column) -> Column:
    """Role initial and fault in one small number."""
    initial = F.substring(role, 1, 1)
    place = F.lit(INITIALS.index("?"))
    for name in INITIALS[:-1]:
        place = F.when(initial == name, INITIALS.index(name)).otherwise(place)
    return place * 4 + fault


def best_edits(costs: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int]:
    """Cost of finishing from each state before a row, from those after it, and the row's byte."""
    kept, fault = KEPT[INITIALS[kind // 4]], kind % 4
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    options = []
    for state in range(4):
        choice = {"D": DELETE_COST + costs[state]}
        if fault not in (BLANK, DUPLICATE):
            choice["R"] = REROLE_COST + extra + costs[AFTER[state]]
            if kept[state] is not None:
                choice["K"] = extra + costs[kept[state]]
        options.append(choice)
    before = [min(c.values()) for c in options]
    for _ in range(2):
        before = [min(before[s], INSERT_COST + before[AFTER[s]]) for s in range(4)]
    byte = 0
    for state in range(4):
        choice = options[state] | {"I": INSERT_COST + before[AFTER[state]]}
        letter = min(x for x, cost in choice.items() if cost == before[state])
        byte |= LETTERS.index(letter) << 2 * state
    return tuple(before), byte


def mark_edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds ``edits``, the backpointers, and ``back``, the place from the end, to rows that come
    conversation by conversation, last turn first.

    Costs differ from their least by a few units only, so few (costs, kind) pairs exist; each is
    worked out once.
    """
    known: dict[tuple, tuple] = {}
    end = tuple(INSERT_COST * n for n in MISSING)
    conversation, costs, back = None, end, 0
    for batch in batches:
        edits, places = [], []
        for conv, kind in zip(batch["conv"].to_numpy(), batch["kind"].to_numpy().tolist()):
            if conv != conversation:
                conversation, costs, back = conv, end, 0
            byte = 0
            if kind != GONE:
                if (costs, kind) not in known:
                    new, byte = best_edits(costs, kind)
                    least = min(new)
                    known[costs, kind] = tuple(c - least for c in new), byte
                costs, byte = known[costs, kind]
            edits.append(byte)
            places.append(back)
            back += 1
        yield batch.assign(edits=edits, back=places)


class Repair:
    """Follows the backpointers of one conversation, first turn first."""

    def __init__(self, conv: str, with_turns: bool):
        self.conv, self.turns = conv, [] if with_turns else None
        self.state, self.cost, self.audit, self.sha = START, 0, bytearray(), hashlib.sha256()
        self.faults, self.illegal, self.initial = [0, 0, 0, 0], 0, None
        self.least = self.most = None
        self.distinct = self.place = 0

    def write(self, role: str, text: str, letter: str) -> None:
        line = f"{role}:{text}"
        self.sha.update((f"\n{line}" if self.place else line).encode())
        if self.turns is not None:
            self.turns.append((self.conv, self.place, role, text, letter))
        self.place += 1

    def insert(self) -> None:
        self.write(WRITTEN[self.state], "", "I")
        self.audit += b"I"
        self.cost += INSERT_COST
        self.state = AFTER[self.state]

    def take(self, turn: str | None, role: str, text: str, kind: int, edits: int) -> None:
        if kind == GONE:
            return
        fault, initial = kind % 4, role[:1]
        self.faults[fault] += 1
        self.illegal += self.initial is not None and self.initial + initial not in NEXT_TO
        self.initial = initial
        if turn is not None:
            number = int(turn)
            self.distinct += number != self.most
            self.least = number if self.least is None else self.least
            self.most = number
        while (letter := LETTERS[edits >> 2 * self.state & 3]) == "I":
            self.insert()
        self.audit += letter.encode()
        if letter == "D":
            self.cost += DELETE_COST
            return
        self.cost += TRUNCATED_COST if fault == TRUNCATED else 0
        if letter == "K":
            self.write(role, text, "K")
            self.state = KEPT[INITIALS[kind // 4]][self.state]
        else:
            self.cost += REROLE_COST
            self.write(WRITTEN[self.state], text, "R")
            self.state = AFTER[self.state]

    def finish(self) -> tuple:
        for _ in range(MISSING[self.state]):
            self.insert()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return (
            self.conv, gaps, *self.faults[1:], self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest()
        )


_REPORT = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_TURNS = "conv string, place bigint, role string, text string, edit string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(",")]


def _follow(with_turns: bool):
    names = _names(_TURNS if with_turns else _REPORT)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_one = None
        for batch in batches:
            out = []
            columns = [batch[c].to_numpy().tolist() for c in ("conv", "turn", "role", "text", "kind", "edits")]
            for conv, *row in zip(*columns):
                if open_one is None or conv != open_one.conv:
                    if open_one is not None:
                        report = open_one.finish()
                        out += open_one.turns if with_turns else [report]
                    open_one = Repair(conv, with_turns)
                open_one.take(*row)
            if with_turns and open_one is not None:
                out += open_one.turns
                open_one.turns = []
            yield pd.DataFrame(out, columns=names)
        if open_one is not None:
            report = open_one.finish()
            yield pd.DataFrame(open_one.turns if with_turns else [report], columns=names)

    return follow


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, kind, nth`` of (conv_id, turn, role, text, gone), by conversation.

    The window's keys contain the conversation, so it needs no second shuffle.
    """
    conv = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    dealt = rows.withColumn("conv", conv).repartition("conv")
    same = Window.partitionBy("conv", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = (
        F.when(bare == "", BLANK)
        .when(F.col("nth") > 1, DUPLICATE)
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(0)
    )
    return dealt.withColumn("nth", F.row_number().over(same)).select(
        "conv", "turn", "role", "text", F.when(F.col("gone"), GONE).otherwise(row_kind(F.col("role"), fault)).alias("kind"), "nth"
    )


def _repaired(rows: DataFrame, with_turns: bool) -> DataFrame:
    kind = rows.schema["conv_id"].dataType
    last_first = with_faults(rows).sortWithinPartitions(
        "conv", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("nth")
    )
    slim = last_first.select("conv", F.col("turn").cast("string").alias("turn"), "role", "text", "kind")
    marked = slim.mapInPandas(mark_edits, "conv string, turn string, role string, text string, kind int, edits int, back bigint")
    out = marked.sortWithinPartitions("conv", F.desc("back")).mapInPandas(
        _follow(with_turns), _TURNS if with_turns else _REPORT
    )
    conv_id = F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind).alias("conv_id")
    return out.select(conv_id, *[F.col(c) for c in out.columns[1:]])


def _taken(conversations: DataFrame) -> DataFrame:
    """The columns a repair reads; a null role or text is one space, as in :func:`damaged`."""
    rows = plain(conversations, "conv_id", "turn", "role", "text")
    return rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})


def damaged(conversations: DataFrame) -> DataFrame:
    """Every twentieth row each dropped, emptied, stripped of sentence ends, repeated or given to
    the user, by the checksum of conversation and turn.

    A dropped row stays as a marker (``gone``), so that its conversation is not forgotten.
    """
    rows = _taken(conversations)
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("fate", F.crc32(key) % 20)
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("fate") == 0).alias("gone"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def repair_report(rows: DataFrame) -> DataFrame:
    """Per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``rows`` has conv_id, turn (an integer), role, text and gone; other columns are ignored.  Null
    turns come first and don't count in ``gaps``; rows of equal turn are ordered by role and text.
    Null conversations make one conversation.  An empty role has no initial: keeping its row
    changes nothing.  A conversation of markers alone has zeros, an empty audit and the hash of the
    empty string; an empty table has no rows.
    """
    return _repaired(rows, False)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, role, text, edit``: the repaired turns, deleted ones left out.

    ``edit`` is K, R or I.  Takes conversations as they are, undamaged.
    """
    return _repaired(_taken(conversations).withColumn("gone", F.lit(False)), True)
