"""Conversations brought back to the grammar (system? (user assistant)+)? by the cheapest edits, with an audit of them.

Faults of each row, and the rows' order, are columns: one shuffle by conversation, windows within it. Then each conversation passes a worker as a stream, first what the decisions need,
then the texts: a forward Viterbi pass over four states (nothing yet, after system, after user, after assistant) carries the least (cost, audit) of each, closes each row's
layer with the insertions, at most two in a row, and the texts are hashed as the audit says. So no conversation is held: memory is a batch and the audits under way, of which all states share
all but the last letters in practice.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trackweave.llm.common import small_batches


@dataclass(frozen=True)
class RepairParams:
    """Costs of edits; keep costs nothing. `cut`: what an undeleted row costs more whose text breaks off."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    cut: int = 3


NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a user or assistant row leads to, by the state before: what insertions and new roles give.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state that a kept row leads to, by its role's initial and the state before.
KEPT = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
WHITE = " \t\n\x0b\f\r"
OUT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@dataclass
class Viterbi:
    """The least (cost, audit) of each state; letters that all states share are moved to `done`."""

    costs: RepairParams
    best: list[tuple[int, str] | None] = field(default_factory=lambda: [(0, ""), None, None, None])
    done: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._close()

    def _close(self) -> None:
        """Insertions after this layer; a third one in a row would only come back to a state that was cheaper before."""
        for _ in range(2):
            for state, held in enumerate(self.best[:]):
                if held:
                    self._offer(self.best, NEXT[state], held[0] + self.costs.insert, held[1] + "I")

    @staticmethod
    def _offer(layer: list[tuple[int, str] | None], state: int, cost: int, audit: str) -> None:
        held = layer[state]
        if held is None or (cost, audit) < held:
            layer[state] = cost, audit

    def read(self, initial: str, fault: int) -> None:
        """The next row: its role's initial and its fault."""
        layer: list[tuple[int, str] | None] = [None] * 4
        more = self.costs.cut if fault == TRUNCATED else 0
        for state, held in enumerate(self.best):
            if not held:
                continue
            cost, audit = held
            self._offer(layer, state, cost + self.costs.delete, audit + "D")
            if fault not in (BLANK, DUPLICATE):
                kept = KEPT.get((initial, state))
                if kept is not None:
                    self._offer(layer, kept, cost + more, audit + "K")
                self._offer(layer, NEXT[state], cost + more + self.costs.rerole, audit + "R")
        self.best = layer
        self._close()
        if len(layer[NOTHING][1] if layer[NOTHING] else layer[USER][1]) > 256:
            shared = os.path.commonprefix([h[1] for h in layer if h])
            self.done.append(shared)
            self.best = [h and (h[0], h[1][len(shared) :]) for h in layer]

    def result(self) -> tuple[int, str]:
        """The least cost of a whole conversation, and its audit."""
        cost, audit = min(h for h in (self.best[NOTHING], self.best[ASSISTANT]) if h)
        return cost, "".join(self.done) + audit


class Repaired:
    """The digest of the repaired rows, as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.sha, self.first = audit, 0, NOTHING, hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def _insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = NEXT[self.state]
            self._put(ROLE[self.state], "")
            self.at += 1

    def read(self, role: str, text: str) -> None:
        self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[role[:1], self.state]
            self._put(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._put(ROLE[self.state], text)

    def result(self) -> str:
        self._insertions()
        return self.sha.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: nulls of role and text as one space; by crc32 of `conv_id:turn` (nulls again as one space) modulo 20, 0 marks a row as gone, 1 empties its text, 2 takes out its
    `.`, `!` and `?`, 3 repeats it, 4 makes it the user's."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(dash("conv_id"), F.lit(":"), dash("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(dash("text"), ".!?", "")).otherwise(dash("text"))
    role = F.when(kind == 4, "user").otherwise(dash("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def whole(rows: DataFrame) -> DataFrame:
    """Rows as they are, none gone: what `repair` takes from a table that isn't to be damaged first."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", "turn", dash("role"), dash("text"), F.lit(False).alias("gone"))


def examined(rows: DataFrame) -> DataFrame:
    """Rows numbered within their conversation (`pos`; rows that are gone last), with `fault`, `illegal` and `fresh` (the first row of its turn)."""
    conversation = Window.partitionBy("conv_id").orderBy("gone", F.asc_nulls_first("turn"), "role", "text")
    same = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy("pos")
    out = rows.withColumns({"pos": F.row_number().over(conversation), "before": F.lag(F.substring("role", 1, 1)).over(conversation), "turn_before": F.lag("turn").over(conversation), "digest": F.sha2("text", 256)})
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = F.when(last == "", BLANK).when(F.row_number().over(same) > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    initial = F.substring("role", 1, 1)
    illegal = F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")
    fresh = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    return out.select("conv_id", "pos", "gone", "turn", initial.alias("initial"), fault.alias("fault"), illegal.alias("illegal"), fresh.alias("fresh"), "role", "text")


def repair(rows: DataFrame, costs: RepairParams = RepairParams()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation in conv_id, turn, role, text and gone, as `damaged` and `whole` give them.

    A row without any character but white space is blank, one whose role and text stood before is a duplicate, one that doesn't end in `.`, `!` or `?` is truncated; the first of these
    counts. Rows are taken by turn, nulls first; rows of equal turn by role, then text. A role is told by its first character; other initials than s, u and a can be reroled or deleted,
    not kept. A null conv_id is a conversation of its own. A conversation whose rows are all gone has zeros, an empty audit and the digest of nothing. An empty table gives none. Whole
    texts are read. Extra columns take no part. The digest of a conversation needs its rows one after the other, so one conversation is one task's work, as a stream.
    """
    small_batches(rows.sparkSession)
    flat = examined(rows)
    slim = F.struct(F.lit(0).alias("step"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    full = F.struct(F.lit(1).alias("step"), F.when(~F.col("gone"), F.col("role")).alias("role"), F.when(~F.col("gone"), F.col("text")).alias("text"))
    both = flat.select(*flat.columns[:8], F.explode(F.array(slim, full)).alias("_row")).select(*flat.columns[:8], "_row.*").sortWithinPartitions("conv_id", "step", "pos")
    conv_type = both.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *OUT, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = run  # no conversation is this
        made: list[tuple] = []
        path = text = None
        seen, least, most, turns = [0] * 5, None, None, 0

        def close() -> None:
            gaps = most - least + 1 - turns if least is not None else 0
            made.append((conv, gaps, *seen[BLANK : TRUNCATED + 1], seen[4], cost, text.audit, text.result()))

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), *((c, pa.int64()) for c in OUT), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for c, gone, turn, initial, fault, illegal, fresh, step, role, words in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "gone", "turn", "initial", "fault", "illegal", "fresh", "step", "role", "text")), strict=True):
                if c != conv or conv is run:
                    if text:
                        close()
                    conv, path, text = c, Viterbi(costs), None
                    seen, least, most, turns = [0] * 5, None, None, 0
                if step and not text:
                    cost, audit = path.result()
                    text = Repaired(audit)
                if gone:
                    continue
                if step:
                    text.read(role, words)
                    continue
                path.read(initial, fault)
                seen[fault] += 1
                seen[4] += illegal
                if fresh:
                    turns, least, most = turns + 1, turn if least is None else least, turn
            if made:
                yield pa.RecordBatch.from_pylist([dict(zip(names, m, strict=True)) for m in made], schema)
                made = []
        if text:
            close()
            yield pa.RecordBatch.from_pylist([dict(zip(names, m, strict=True)) for m in made], schema)

    return both.mapInArrow(run, f"conv_id {conv_type}, {', '.join(f'{c} bigint' for c in OUT)}, audit string, repaired_sha256 string")
