"""Repair of conversations: Wagner-Fischer alignment of turns with every feasible length of the alternating grammar
`(s?(ua)+)?`, in Ukkonen bands from the cost of a known repair, the backtraced audits compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, split_by_keys

# Costs of edits, white space, ends of sentences.
RETAG, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANK, ENDS = " \t\n\x0b\x0c\r", ".!?"
LEGAL = {"su", "ua", "au"}
#: States of the grammar: nothing yet, after a system turn, a user's turn is next, an assistant's is next.
START, AFTER_S, NEXT_U, NEXT_A = range(4)
#: Rows of a conversation that are aligned as one piece.
PIECE = 256
FAR = 1 << 40
ROLES = {"u": "user", "a": "assistant"}


def _char(exit_state: int, rest: int) -> str:
    """The role initial with `rest` characters of the target left, itself included."""
    return "a" if (rest % 2 == 1) == (exit_state == NEXT_U) else "u"


def _known_repair(rows: list[tuple[str, bool, bool]], entry: int, exit_state: int) -> int:
    """The cost of one valid repair: a turn out of place gets the missing one before it or another role."""
    want, cost, made = "a" if entry == NEXT_A else "u", 0, entry in (NEXT_U, NEXT_A)
    for initial, forced, truncated in rows:
        if forced:
            cost += DELETE
            continue
        cost += truncated * TRUNCATED + (initial != want) * RETAG
        made = True
        if initial == want or initial not in ROLES:
            want = "a" if want == "u" else "u"
    if not made and exit_state == NEXT_U:
        cost += 2 * INSERT
    elif (want == "u") != (exit_state == NEXT_U):
        cost += INSERT
    return cost


class _Table:
    """Costs of aligning rows i.. with the last r characters of a target that ends before exit_state: every length at once.

    Only r within the band count: `rest` characters more than free rows need an insert each, fewer a deletion each, and the
    costs of a known repair allow no more of them.
    """

    def __init__(self, rows: list[tuple[str, bool, bool]], exit_state: int, known: int):
        self.rows, self.exit = rows, exit_state
        n, spare = len(rows), known - DELETE * sum(f for _, f, _ in rows)
        width = sum(not f for _, f, _ in rows) + spare // INSERT + 2
        slope = INSERT * np.arange(width)
        kinds = {c: np.array([0 if _char(exit_state, r) == c else RETAG for r in range(1, width)]) for c in "ua"}
        other = np.full(width - 1, RETAG)
        self.cost: list[np.ndarray] = [np.where(slope <= spare, slope, FAR)]
        free = 0
        for initial, forced, truncated in reversed(rows):
            below = self.cost[-1]
            base = below + DELETE
            if not forced:
                free += 1
                np.minimum(base[1:], below[:-1] + kinds.get(initial, other) + truncated * TRUNCATED, out=base[1:])
            row = np.minimum.accumulate(base - slope) + slope
            row[: max(0, free - spare // DELETE)] = FAR
            row[free + spare // INSERT + 1 :] = FAR
            self.cost.append(row)
        self.cost.reverse()

    def lengths(self, at: int, first: str, least: int) -> list[int]:
        """Lengths of targets that begin with `first`, from row `at` on."""
        return [r for r in range(least, len(self.cost[at])) if self.cost[at][r] < FAR and (r == 0 or _char(self.exit, r) == first)]

    def audit(self, i: int, r: int) -> str:
        """The least of the cheapest audits of rows i.. and r characters: at each place the least edit of a cheapest way."""
        out, cost, n = [], self.cost, len(self.rows)
        while i < n or r:
            here = cost[i][r]
            initial, forced, truncated = self.rows[i] if i < n else ("", True, False)
            if i < n and cost[i + 1][r] + DELETE == here:
                out.append("D")
                i += 1
            elif r and cost[i][r - 1] + INSERT == here:
                out.append("I")
                r -= 1
            else:
                out.append("K" if initial == _char(self.exit, r) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def align(rows: list[tuple[str, bool, bool]], entries: tuple[int, ...], exits: tuple[int, ...]) -> dict[tuple[int, int], tuple[int, str]]:
    """{(entry, exit): (cost, audit)} of rows (initial, must go, truncated): the cheapest edits that lead from state to state,
    of equal costs those of the least audit over all lengths."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    n = len(rows)
    for p in entries:
        for q in exits:
            if p == q and q in (START, AFTER_S):
                out[p, q] = DELETE * n, "D" * n
            elif (p, q) == (START, AFTER_S):
                kept = [(DELETE * (n - 1) + t * TRUNCATED, "D" * i + "K" + "D" * (n - i - 1)) for i, (c, f, t) in enumerate(rows) if c == "s" and not f]
                if kept:
                    out[p, q] = min(kept)
    for q in {NEXT_U, NEXT_A} & set(exits):
        table = _Table(rows, q, max(_known_repair(rows, p, q) for p in entries))
        for p in entries:
            found = [(int(table.cost[0][r]), 0, r, "") for r in table.lengths(0, "a" if p == NEXT_A else "u", 0 if p == q else 1)]
            if p == START:
                # A system turn may come first: what stands before it is deleted.
                for i, (c, f, t) in enumerate(rows):
                    if c == "s" and not f:
                        found += [(DELETE * i + t * TRUNCATED + int(table.cost[i + 1][r]), i + 1, r, "D" * i + "K") for r in table.lengths(i + 1, "u", 1)]
            least = min(x[0] for x in found)
            out[p, q] = least, min(head + table.audit(i, r) for cost, i, r, head in found if cost == least)
    return out


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """The lines that an audit leaves of some rows, and the state after them."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        name = ROLES["a" if state == NEXT_A else "u"]
        if edit == "I":
            out.append(f"{name}:")
        else:
            out.append(f"{roles[i] if edit == 'K' else name}:{texts[i]}")
            i += 1
        system = edit == "K" and state == START and roles[i - 1][:1] == "s"
        state = AFTER_S if system else NEXT_U if state == NEXT_A else NEXT_A
    return out, state


PIECES = "part int, no int, counts array<bigint>, ends array<string>, costs array<bigint>, audits array<string>, roles array<string>, texts array<string>"
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
ALL = ((START, AFTER_S, NEXT_U, NEXT_A),) * 2


def piece(rows: list[tuple], first: bool, last: bool) -> dict:
    """A stretch of a conversation, aligned: rows are (turn, role, text, late, copy), late and copy telling duplicates."""
    blank = duplicate = truncated = illegal = 0
    faults, before = [], None
    for _, role, text, again in rows:
        body = text.rstrip(BLANK)
        kind = "blank" if not body else "duplicate" if again else "truncated" if body[-1] not in ENDS else ""
        blank, duplicate, truncated = blank + (kind == "blank"), duplicate + (kind == "duplicate"), truncated + (kind == "truncated")
        illegal += before is not None and before + role[:1] not in LEGAL
        before = role[:1]
        faults.append((role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
    turns = [t for t, *_ in rows if t is not None]
    found = align(faults, (START,) if first else ALL[0], (START, NEXT_U) if last else ALL[1])
    pairs = [found.get((p, q), (None, None)) for p in range(4) for q in range(4)]
    return {
        "counts": [blank, duplicate, truncated, illegal, len(set(turns)), min(turns, default=None), max(turns, default=None)], "ends": [rows[0][1][:1], rows[-1][1][:1]],
        "costs": [c for c, _ in pairs], "audits": [a for _, a in pairs], "roles": [r for _, r, *_ in rows], "texts": [t for _, _, t, _ in rows],
    }


class Repair:
    """A conversation's pieces put together in order: the best way to each state, with the hash of its lines so far."""

    def __init__(self):
        self.best = {START: (0, "", hashlib.sha256(), False)}
        self.sums, self.turns, self.low, self.high, self.role = [0] * 4, 0, None, None, None

    def add(self, x: dict) -> None:
        *sums, turns, low, high = x["counts"]
        self.sums = [a + b for a, b in zip(self.sums, sums)]
        self.sums[3] += self.role is not None and self.role + x["ends"][0] not in LEGAL
        self.role = x["ends"][1]
        if turns:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high
        new: dict[int, tuple] = {}
        for q in range(4):
            ways = [(cost + x["costs"][4 * p + q], audit + x["audits"][4 * p + q], p) for p, (cost, audit, *_) in self.best.items() if x["costs"][4 * p + q] is not None]
            if ways:
                cost, audit, p = min(ways)
                _, _, digest, any_yet = self.best[p]
                lines, _ = repaired(x["audits"][4 * p + q], p, x["roles"], x["texts"])
                digest = digest.copy()
                if lines:
                    digest.update((("\n" if any_yet else "") + "\n".join(lines)).encode())
                new[q] = cost, audit, digest, any_yet or bool(lines)
        self.best = new

    def result(self) -> tuple:
        cost, audit, q = min((x[0], x[1], q) for q, x in self.best.items() if q in (START, NEXT_U))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (gaps, *self.sums, cost, audit, self.best[q][2].hexdigest())


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


KEY = "conv_id bigint, unnamed boolean"


def _repair_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a task's range: conversations that lie within it are repaired, the outer two go on as aligned pieces."""
    part = TaskContext.get().partitionId()
    held: list[tuple] = []
    key, first, no, rows, before, pieces = None, True, 0, [], None, []
    nothing = (None,) * 8

    def cut(last: bool):
        nonlocal rows, no
        if rows:
            pieces.append((no, piece(rows, no == 0 and not first, last and no == 0 and not first)))
            rows, no = [], no + 1

    def leave(last: bool):
        """End the conversation: its row, or its pieces where it may go on in another task."""
        nonlocal pieces, no, first
        cut(not last)
        if first or last:
            held.extend((*key, part, i, *x.values(), *nothing) for i, x in pieces)
            if not pieces:  # all its rows here are dropped
                held.append((*key, part, -1, *(None,) * 6, *nothing))
        else:
            r = Repair()
            for _, x in pieces:
                r.add(x)
            held.append((*key, None, None, *(None,) * 6, *r.result()))
        pieces, no, first = [], 0, False

    for batch in batches:
        for conv, unnamed, turn, role, text, dropped, late, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if (conv, unnamed) != key:
                if key is not None:
                    leave(False)
                key, before = (conv, unnamed), None
            if dropped:
                continue
            for k in range(copies):
                rows.append((turn, role, text, late or k > 0 or before == (turn, role, text)))
                before = (turn, role, text)
                if len(rows) == PIECE:
                    cut(False)
        if len(held) >= 2000:
            yield _table(held, f"{KEY}, {PIECES}, {RESULT}")
            held.clear()
    if key is not None:
        leave(True)
    if held:
        yield _table(held, f"{KEY}, {PIECES}, {RESULT}")


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations whose pieces come in order."""
    key, r, out = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (k := (row["conv_id"], row["unnamed"])) != key:
                if key is not None:
                    out.append((*key, *r.result()))
                key, r = k, Repair()
            if row["no"] >= 0:
                r.add(row)
        if len(out) >= 2000:
            yield _table(out, f"{KEY}, {RESULT}")
            out = []
    if key is not None:
        out.append((*key, *r.result()))
        yield _table(out, f"{KEY}, {RESULT}")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, unnamed, turn, role, text, dropped, copies): damage by crc32 of `conv_id:turn` modulo 20; nulls are a space.

    0 drops a row (it stays as a mark that its conversation exists), 1 empties its text, 2 takes `.!?` out of it, 3 makes it
    two, 4 makes it a user's. unnamed tells a null conv_id.
    """
    space = lambda c, kind: F.coalesce(F.col(c).cast(kind).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space("conv_id", "bigint"), F.lit(":"), space("turn", "bigint")).cast("binary")) % 20
    text = F.when(hit <= 1, "").when(hit == 2, F.regexp_replace(space("text", "string"), "[.!?]", "")).otherwise(space("text", "string"))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("unnamed"), F.col("turn").cast("bigint").alias("turn"), F.when(hit == 4, "user").otherwise(space("role", "string")).alias("role"),
        text.alias("text"), (hit == 0).alias("dropped"), F.when(hit == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )
    return rows


def _place(turn: str) -> Column:
    return F.struct(F.col(turn).isNotNull().alias("given"), F.col(turn).alias("turn"))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id after the damage of damaged(): faults, and the cheapest edits into `(s?(ua)+)?`.

    Columns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows are taken by turn (null
    first), of one turn by role and text, so equal rows stand together. Null role and text are a space; a null conv_id is a
    conversation of its own; a conversation whose rows are all dropped has zeros, no audit and the hash of nothing. An empty
    table gives no rows; extra columns are ignored.

    Rows are dealt by ranges of (conv_id, turn, role, text), so a conversation of any length spreads over tasks; it is aligned
    in pieces, between any two states of the grammar, and these chains are put together: a least audit's parts are least.
    """
    rows = damaged(conversations)
    rows = rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    group = ["conv_id", "unnamed", "digest"]
    there = rows.where("not dropped")
    again = there.groupBy(*group).agg(F.sum("copies").alias("n"), F.min(_place("turn")).alias("earliest")).where("n > 1").drop("n")
    again = materialize(again, "repeated-turns")
    some, rest = split_by_keys(there, again, group)
    some = some.groupBy(*group, "turn", "role", "text", "dropped").agg(F.sum("copies").alias("copies")).join(again, group, "left")
    columns = ["conv_id", "unnamed", "turn", "role", "text", "dropped"]
    late = F.coalesce(_place("turn") > F.col("earliest"), F.lit(False)).alias("late")
    everything = some.select(*columns, late, "copies").unionByName(rest.select(*columns, F.lit(False).alias("late"), "copies")).unionByName(rows.where("dropped").select(*columns, F.lit(False).alias("late"), "copies"))
    order = ["unnamed", "conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = everything.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(dealt.mapInArrow(_repair_sorted, f"{KEY}, {PIECES}, {RESULT}"), "repaired")
    columns = [f.split(" ")[0] for f in RESULT.split(", ")]
    open_ones = found.where("part IS NOT NULL").select("conv_id", "unnamed", *[f.split(" ")[0] for f in PIECES.split(", ")])
    joined = open_ones.repartition("unnamed", "conv_id").sortWithinPartitions("unnamed", "conv_id", "part", "no").mapInArrow(_join_pieces, f"{KEY}, {RESULT}")
    out = found.where("part IS NULL").select("conv_id", "unnamed", *columns).unionByName(joined)
    return out.select(F.when(~F.col("unnamed"), F.col("conv_id")).alias("conv_id"), *columns)
