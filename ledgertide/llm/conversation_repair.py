"""Repair of conversation structure: faults marked by joins, the cheapest edits found by a survivor-coalescence Viterbi.

A repaired conversation is empty or an optional system turn followed by pairs of user and assistant. Rows are kept (0),
given another role (1), deleted (2, which blank and duplicate rows must be), or an empty turn is inserted (5); a truncated
row that stays costs 5 more. Of equally cheap edits those with the ASCII-least initials win.

`Repair` walks a conversation in order and keeps one survivor per state (nothing yet, system, user, assistant last).
Survivors are leaves of a tree of back pointers whose nodes count what hangs on them; nodes that nothing needs go at once,
and as soon as all survivors share an ancestor the edits up to it are given out, so memory holds the undecided rows only.
A survivor that another one beats by more than any continuation can win back is dropped. Ties compare the complete
undecided suffixes: each survivor has its rank among them, and as no suffix begins another one (each ends in the edit of
the same row), ranks of longer suffixes follow from ranks of shorter ones. Nodes hold no text: every survivor feeds its
own running digest of the repaired text, so rows that stay undecided for long hold a few words of memory each.

Rows are dealt out by conversation and sorted by Spark; a task reads them as a stream and never gathers a conversation,
however long it is. (The digest of a conversation is serial by definition, so one conversation is one task's stream.)

Edge cases: null ids, turns, roles and texts count as one space in the damage, and null roles and texts stay so; a null
conv_id is a conversation of its own; rows are taken by turn (nulls first), role, text; equal rows follow one another; a
conversation whose rows are all dropped has an empty repair; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm.work import settle

#: Costs of the edits; a kept truncated row costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: State after a turn with this initial, by state before.
MOVES = {
    "s": {NOTHING: SYSTEM},
    "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
#: The role an inserted or reroled turn takes in a state, which is also the state after it.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: How much more a continuation of the second state can cost at most if it is begun in the first one.
CATCH_UP = {
    (ASSISTANT, NOTHING): DELETE, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): INSERT,
    (USER, NOTHING): INSERT + DELETE, (USER, SYSTEM): INSERT, (USER, ASSISTANT): INSERT,
    (NOTHING, SYSTEM): 0, (NOTHING, ASSISTANT): 0, (NOTHING, USER): INSERT,
    (SYSTEM, NOTHING): 2 * INSERT, (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 2 * INSERT,
}
GOOD_PAIRS = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"

EDITS = "conv_id BIGINT, seq BIGINT, row BIGINT, edit STRING, role STRING"
SUMMARY = (
    "conv_id BIGINT, gaps BIGINT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT, cost BIGINT, "
    "audit STRING, repaired_sha256 STRING"
)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by a checksum of id and turn; dropped rows stay as markers of their conversation."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    copies = F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(said("role")).alias("role"),
        F.when(draw != 0, text).otherwise("").alias("text"), (draw == 0).alias("dropped"), F.explode(copies).alias("copy"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Adds row (a number of its own) and fault: the first of blank, duplicate and truncated that a row has.

    Rows are conv_id, turn, role, text, dropped, copy. The first place of every role and text of a conversation is found
    by a grouping that is summed up before the shuffle, on digests of the texts.
    """
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "conversation-rows")
    rows = rows.withColumn("digest", F.sha2("text", 256))
    said, blank = F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) > 0, F.lit(BLANK)
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row", "copy")
    first = rows.where(~F.col("dropped")).groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select(
        F.col("conv_id").alias("of"), F.col("role").alias("of_role"), F.col("digest").alias("of_digest"), "first"
    )
    same = F.expr("conv_id <=> of AND role <=> of_role AND digest = of_digest")
    fault = (
        F.when(~said, blank)
        .when(F.coalesce(order > F.col("first"), F.lit(False)), DUPLICATE)
        .when(~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), CUT)
    )
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "dropped", "copy", "row", fault.alias("fault"))


class Node:
    """An edit of a row with the turns inserted before it: a node of the tree of back pointers."""

    __slots__ = ("parent", "kids", "held", "inserted", "edit", "row", "role")

    def __init__(self, parent: Node | None, inserted: tuple, edit: str, row: int | None, role: str | None):
        self.parent, self.inserted, self.edit, self.row, self.role = parent, inserted, edit, row, role
        self.kids: list[Node] = []
        self.held = True
        if parent:
            parent.kids.append(self)


class Repair:
    """Cheapest edits of one conversation, fed row by row; `emit(row, edit, role)` gets them in order once they are certain."""

    def __init__(self, emit: Callable[[int | None, str, str | None], None]):
        self.emit = emit
        self.base = Node(None, (), "", None, None)
        # state: (cost, rank of the undecided suffix, leaf, running digest)
        self.survivors = {NOTHING: (0, 0, self.base, hashlib.sha256())}
        self.undecided = self.most_undecided = 0

    def feed(self, row: int, role: str, text: str, fault: str | None) -> None:
        extra = TRUNCATED if fault == CUT else 0
        gone = fault in (BLANK, DUPLICATE)
        kept = MOVES.get(role[:1], {})
        found: dict[int, tuple] = {}
        for state, (cost, rank, _, _) in self.survivors.items():
            here, paid, inserted = state, cost, ()
            for _ in range(3 if state in (NOTHING, SYSTEM) else 2):
                options = [("D", here, paid + DELETE, None)]
                if not gone:
                    if here in kept:
                        options.append(("K", kept[here], paid + extra, role))
                    options.append(("R", NEXT[here], paid + REROLE + extra, NAMES[NEXT[here]]))
                for edit, after, total, name in options:
                    key = (total, rank, "I" * len(inserted) + edit)
                    if after not in found or key < found[after][0]:
                        found[after] = (key, state, inserted, name)
                here, paid = NEXT[here], paid + INSERT
                inserted += (NAMES[here],)
        self._replace(self._worthwhile(found), row, text)

    def _worthwhile(self, found: dict[int, tuple]) -> dict[int, tuple]:
        cost = {state: entry[0][0] for state, entry in found.items()}
        return {
            state: entry for state, entry in found.items()
            if not any(p != state and cost[p] + CATCH_UP[p, state] < cost[state] for p in cost)
        }

    def _replace(self, found: dict[int, tuple], row: int, text: str) -> None:
        old = self.survivors
        order = sorted(found, key=lambda state: found[state][0][1:])
        fresh = {}
        for state, ((cost, _, path), parent, inserted, name) in found.items():
            _, _, leaf, digest = old[parent]
            digest, empty = digest.copy(), parent == NOTHING
            for turn in inserted:
                digest.update((f"{turn}:" if empty else f"\n{turn}:").encode())
                empty = False
            if name is not None:
                digest.update((f"{name}:{text}" if empty else f"\n{name}:{text}").encode())
            fresh[state] = (cost, order.index(state), Node(leaf, inserted, path[-1], row, name), digest)
        self.undecided += len(fresh)
        self.survivors = fresh
        for _, _, leaf, _ in old.values():
            self._release(leaf)
        self._decide()
        self.most_undecided = max(self.most_undecided, self.undecided)

    def _release(self, leaf: Node) -> None:
        """A leaf is no survivor any more: it goes, and what only led to it, too."""
        leaf.held = False
        while leaf is not self.base and not leaf.held and not leaf.kids:
            parent = leaf.parent
            parent.kids.remove(leaf)
            self.undecided -= 1
            leaf = parent

    def _decide(self) -> None:
        """Give out the edits that all survivors share."""
        while len(self.base.kids) == 1 and not self.base.held:
            self.base = self.base.kids[0]
            self.base.parent = None
            self.undecided -= 1
            self._give(self.base)

    def _give(self, node: Node) -> None:
        for role in node.inserted:
            self.emit(None, "I", role)
        self.emit(node.row, node.edit, node.role)

    def finish(self) -> tuple[int, str]:
        """Cost and digest of the cheapest repair; gives out the rest of the edits."""
        ends = {NOTHING: (), ASSISTANT: (), USER: ("assistant",), SYSTEM: ("user", "assistant")}
        best = min(
            (cost + INSERT * len(ends[state]), rank, "I" * len(ends[state]), state)
            for state, (cost, rank, _, _) in self.survivors.items()
        )
        _, _, leaf, digest = self.survivors[best[3]]
        path = []
        while leaf is not self.base:
            path.append(leaf)
            leaf = leaf.parent
        for node in reversed(path):
            self._give(node)
        for role in ends[best[3]]:
            self.emit(None, "I", role)
            digest.update(f"\n{role}:".encode())
        return best[0], digest.hexdigest()


def _walk(rows: DataFrame, schema: str, collect: Callable) -> DataFrame:
    """Stream the rows of whole conversations, in order, through `collect` (a generator over tuples of a row)."""
    columns = ["conv_id", "turn", "role", "text", "dropped", "row", "fault"]
    names = [part.split()[0] for part in schema.split(", ")]
    arrow = pa.schema([(p.split()[0], pa.int64() if p.split()[1] == "BIGINT" else pa.string()) for p in schema.split(", ")])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                yield from zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns], strict=True)

        out: list[tuple] = []
        for made in collect(each()):
            out.append(made)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*out), arrow)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*out), arrow)], names=names)

    dealt = rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("dropped").desc(), F.col("turn").asc_nulls_first(), "role", "text", "copy", "row"
    )
    return dealt.select(*columns).mapInArrow(walk, schema)


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, None) where a conversation begins, else (conv_id, row)."""
    now, begun = None, False
    for row in rows:
        if not begun or row[0] != now:
            now, begun = row[0], True
            yield now, None
        if not row[4]:
            yield now, row


def edits(rows: DataFrame) -> DataFrame:
    """conv_id, seq (order of the edits from 1), row (null if inserted), edit (K, R, D, I), role after the edit."""

    def collect(stream):
        made: list[tuple] = []
        repair = now = None
        seq = 0

        def number():
            nonlocal seq
            for row, edit, role in made:
                seq += 1
                yield now, seq, row, edit, role
            made.clear()

        for conv_id, row in _conversations(stream):
            if row is None:
                if repair:
                    repair.finish()
                    yield from number()
                repair, now, seq = Repair(lambda *e: made.append(e)), conv_id, 0
            else:
                repair.feed(row[5], row[2], row[3], row[6])
                yield from number()
        if repair:
            repair.finish()
            yield from number()

    return _walk(rows, EDITS, collect)


def repaired(rows: DataFrame, made: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, seq, turn and row (null if inserted), role, text."""
    texts = rows.select("row", "turn", "text")
    return made.where("edit <> 'D'").join(texts, "row", "left").select(
        "conv_id", "seq", "turn", "row", "role", F.coalesce("text", F.lit("")).alias("text")
    )


def summary(rows: DataFrame) -> DataFrame:
    """Per conversation: the faults counted, cost and initials of the edits, digest of the repaired text."""

    def collect(stream):
        repair = state = None

        def told():
            cost, digest = repair.finish()
            faults = state["faults"]
            span = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
            return (
                state["conv_id"], span, faults[BLANK], faults[DUPLICATE], faults[CUT], state["illegal"], cost,
                "".join(state["audit"]), digest,
            )

        for conv_id, row in _conversations(stream):
            if row is None:
                if repair:
                    yield told()
                audit: list[str] = []
                repair = Repair(lambda _row, edit, _role, audit=audit: audit.append(edit))
                state = {
                    "conv_id": conv_id, "faults": {BLANK: 0, DUPLICATE: 0, CUT: 0}, "illegal": 0, "low": None, "high": None,
                    "turns": 0, "initial": None, "audit": audit,
                }
                continue
            _, turn, role, text, _, place, fault = row
            if turn is not None and turn != state["high"]:
                state["low"] = turn if state["low"] is None else state["low"]
                state["high"] = turn
                state["turns"] += 1
            if state["initial"] is not None and state["initial"] + role[:1] not in GOOD_PAIRS:
                state["illegal"] += 1
            state["initial"] = role[:1]
            if fault:
                state["faults"][fault] += 1
            repair.feed(place, role, text, fault)
        if repair:
            yield told()

    return _walk(rows, SUMMARY, collect)
