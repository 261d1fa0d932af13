"""Repair of conversation structure by a Viterbi search that streams over the rows.

A conversation is read in order of turn (nulls first; rows of one turn by role, then text).
Every row is kept, given another role, or deleted, and empty rows may be inserted, so that
the role initials read ``(s?(ua)+)?`` at the least cost; of equally cheap repairs the one
whose edits, written as K, R, D, I, come first in ASCII order is taken.

The search has four states: nothing put out yet, a system row, a user row last, an
assistant row last. Survivors of the states are leaves of one tree of back pointers. Each
node counts its children and the states that hold it; nodes that nothing holds are freed,
and as soon as the root has one child left, that edit is settled and leaves the tree. So a
task holds only what is unresolved, however long a conversation is. Ties are decided over
the complete unresolved suffixes: pointers to far ancestors find where two paths part,
which costs the logarithm of their length. A state that can't win any more is dropped:
one without output costs at most one deletion (of a later system row) less than "assistant last",
one after a system row nothing less.

Spark brings a conversation's rows together and sorts them, spilling where it must; the
task streams. One task per conversation is inherent, as each repair is a sequence and its
digest covers the whole text.

Null columns count as one space; a row whose text has no character but white space is
blank; conversations without any row have no edits. Ids may be null (one conversation).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

#: Cost of each edit, and of a truncated row that is not deleted.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: States of the search.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Initials a row may have to be kept in a state, and the state after it.
KEEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: The state after a row put out with the role that a state asks for.
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
FAULTS = ("", "blank", "duplicate", "truncated")
#: Rows and bytes of one Arrow batch that a task puts out.
OUT_ROWS, OUT_BYTES = 4096, 4 << 20
#: Damage of the query: remainders of crc32(conv_id:turn) and what they do.
PARTS, DROP, EMPTY, UNPUNCTUATED, REPEAT, AS_USER = 20, 0, 1, 2, 3, 4

SPACE = r"\x20\x09-\x0D"
EDITS = "conv_id long, step long, edit string, turn long, role string, text string, was string, fault string"


class Node:
    """An edit on a path from the root: ``row`` is what it puts out or deletes."""

    __slots__ = ("parent", "jump", "depth", "edit", "row", "state", "kids", "holds")

    def __init__(self, parent: Node | None, edit: str, row, state: int):
        self.parent, self.edit, self.row, self.state = parent, edit, row, state
        self.kids: list[Node] = []
        self.holds = 0
        if parent is None:
            self.depth, self.jump = 0, self
        else:
            self.depth = parent.depth + 1
            far = parent.jump
            # jumps double as far as depths allow, so an ancestor is a few jumps away
            self.jump = far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent
            parent.kids.append(self)

    def up(self, depth: int) -> Node:
        node = self
        while node.depth > depth:
            node = node.jump if node.jump.depth >= depth else node.parent
        return node


def first_path(a: tuple[Node, str], b: tuple[Node, str]) -> bool:
    """Whether path ``a`` plus its edit comes before path ``b`` plus its edit in ASCII order."""
    (x, left), (y, right) = a, b
    depth = min(x.depth, y.depth)
    p, q = x.up(depth), y.up(depth)
    if p is q:  # one path goes on where the other ends
        if x.depth == y.depth:
            return left < right
        longer = x if x.depth > y.depth else y
        here = longer.up(depth + 1).edit
        return here < right if longer is x else left < here
    while p.parent is not q.parent:
        p, q = (p.jump, q.jump) if p.jump is not q.jump else (p.parent, q.parent)
    return p.edit < q.edit


class Repair:
    """The search over one conversation; ``emit(edit, row, state)`` gets settled edits in order."""

    def __init__(self, emit: Callable[[str, object, int], None]):
        self.emit = emit
        self.root = Node(None, "", None, START)
        self.root.holds = 1
        self.costs: dict[int, int] = {START: 0}
        self.nodes: dict[int, Node] = {START: self.root}
        self._insert()

    def _insert(self) -> None:
        """Inserted rows: from any state to "user last", from there to "assistant last"."""
        for target, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            best, cost = self.nodes.get(target), self.costs.get(target)
            chosen = None
            for source in sources:
                if source not in self.nodes:
                    continue
                total, node = self.costs[source] + INSERT, self.nodes[source]
                if cost is None or total < cost or total == cost and self._before(node, chosen, best):
                    cost, chosen = total, node
            if chosen is not None:
                new = Node(chosen, "I", None, target)
                new.holds = 1
                self.nodes[target], self.costs[target] = new, cost
                if best is not None:
                    self._release(best)

    @staticmethod
    def _before(node: Node, chosen: Node | None, best: Node | None) -> bool:
        """Whether inserting after ``node`` gives a path before the best one so far."""
        if chosen is not None:
            return first_path((node, "I"), (chosen, "I"))
        return first_path((node, "I"), (best.parent, best.edit))

    def _release(self, node: Node) -> None:
        node.holds -= 1
        while node is not self.root and not node.holds and not node.kids:
            parent = node.parent
            parent.kids.remove(node)
            node.parent = node.row = None
            node = parent

    def row(self, initial: str, must_go: bool, truncated: bool, row: object) -> None:
        best: dict[int, tuple[int, Node, str]] = {}

        def offer(target: int, cost: int, node: Node, edit: str) -> None:
            known = best.get(target)
            if known is None or cost < known[0] or cost == known[0] and first_path((node, edit), known[1:]):
                best[target] = (cost, node, edit)

        for state, node in self.nodes.items():
            cost = self.costs[state]
            offer(state, cost + DELETE, node, "D")
            if not must_go:
                out = cost + (TRUNCATED if truncated else 0)
                if (initial, state) in KEEPS:
                    offer(KEEPS[initial, state], out, node, "K")
                offer(NEXT[state], out + REROLE, node, "R")
        old = list(self.nodes.values())
        self.nodes, self.costs = {}, {}
        for state in sorted(best):
            cost, parent, edit = best[state]
            self.nodes[state] = node = Node(parent, edit, row, state)
            node.holds, self.costs[state] = 1, cost
        for node in old:
            self._release(node)
        self._insert()
        for state, slack in ((START, DELETE), (SYSTEM, 0)):
            if state in self.nodes and self.costs[state] > self.costs[ASSISTANT] + slack:
                self._release(self.nodes.pop(state))
                del self.costs[state]
        self._settle()

    def _settle(self) -> None:
        """Puts out the edits that all survivors share."""
        while not self.root.holds and len(self.root.kids) == 1:
            node = self.root.kids[0]
            self.emit(node.edit, node.row, node.state)
            self.root.parent = None
            self.root, node.row = node, None

    def end(self) -> int:
        """Settles the cheapest repair and returns its cost."""
        final = ASSISTANT
        if START in self.nodes:
            gap = self.costs[START] - self.costs[ASSISTANT]
            a, b = self.nodes[START], self.nodes[ASSISTANT]
            if gap < 0 or gap == 0 and first_path((a, ""), (b, "")):
                final = START
        cost = self.costs[final]
        for state, node in self.nodes.items():
            if state != final:
                self._release(node)
        self._settle()
        return cost


class Sink:
    """Collects rows of the output and hands them over in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.ready = schema, []
        self.clear()

    def clear(self) -> None:
        self.rows, self.bytes = [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size
        if len(self.rows) >= OUT_ROWS or self.bytes >= OUT_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            columns = zip(*self.rows)
            self.ready.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema))
        self.clear()

    def take(self) -> Iterator[pa.RecordBatch]:
        ready, self.ready = self.ready, []
        yield from ready


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, gone) after the damage that the query asks for:
    dropped rows stay with ``gone`` true, so that no conversation is lost."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name) % PARTS).alias("part"))
    part = F.col("part")
    text = F.when(part == EMPTY, F.lit("")).when(part == UNPUNCTUATED, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(part == AS_USER, F.lit("user")).otherwise(F.col("role"))
    gone = part == DROP
    copies = F.explode(F.when(part == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), gone.alias("gone"), copies.alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) with their first fault, each conversation in
    one partition and in order. The window reuses the partitions by conversation."""
    same = W.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut_off = F.col("text").rlike(rf"[^{SPACE}.!?][{SPACE}]*\z")
    fault = F.when(blank, FAULTS[1]).when(F.row_number().over(same) > 1, FAULTS[2]).when(cut_off, FAULTS[3]).otherwise(FAULTS[0])
    placed = rows.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id")
    return placed.withColumn("fault", fault).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def conversations_of(batches: Iterator[pa.RecordBatch], start: Callable, each: Callable, end: Callable, sink: Sink) -> Iterator[pa.RecordBatch]:
    """Streams sorted rows: ``start(conv_id)``, ``each(row)`` and ``end()`` per conversation."""
    current: tuple | None = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if current is None or row[0] != current[0]:
                if current is not None:
                    end()
                current = (row[0],)
                start(row[0])
            each(row)
        yield from sink.take()
    if current is not None:
        end()
    sink.flush()
    yield from sink.take()


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def repair(rows: DataFrame) -> DataFrame:
    """The edits of each conversation of ``rows`` (conv_id, turn, role, text, gone), in order:
    conv_id, step, edit (K, R, D or I), turn and role and text of the row as repaired (an
    inserted row has no turn and an empty text, a deleted one its old role), was (its role
    before) and fault. A conversation whose rows are all gone has one row without an edit.
    """
    arrow = _arrow(EDITS)

    def run(batches):
        sink = Sink(arrow)
        now: dict = {}

        def start(conv_id):
            now.update(id=conv_id, step=0, search=None)

        def emit(edit, row, state):
            now["step"] += 1
            if edit == "I":
                sink.add((now["id"], now["step"], edit, None, ROLES[state], "", None, ""), 64)
            else:
                turn, was, text, fault = row
                role = ROLES[state] if edit == "R" else was
                sink.add((now["id"], now["step"], edit, turn, role, text, was, fault), 64 + len(text))

        def each(row):
            _, turn, role, text, gone, fault = row
            if gone:
                return
            if now["search"] is None:
                now["search"] = Repair(emit)
            now["search"].row(role[:1], fault in FAULTS[1:3], fault == FAULTS[3], (turn, role, text, fault))

        def end():
            if now["search"] is None:
                sink.add((now["id"], 0, None, None, None, None, None, None), 64)
            else:
                now["search"].end()

        yield from conversations_of(batches, start, each, end, sink)

    return ordered(rows).mapInArrow(run, EDITS)


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summaries(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``edits`` as ``repair`` returns them: each conversation in
    one partition, in order of step (a table read back must be dealt and sorted so again)."""
    arrow = _arrow(SUMMARY)

    def run(batches):
        sink = Sink(arrow)
        now: dict = {}

        def start(conv_id):
            now.update(id=conv_id, least=None, last=None, turns=0, faults=dict.fromkeys(FAULTS, 0), illegal=0, before=None, cost=0, audit=[], sha=hashlib.sha256(), first=True)

        def each(row):
            _, _, edit, turn, role, text, was, fault = row
            if edit is None:
                return
            now["audit"].append(edit)
            now["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == FAULTS[3] and edit != "D" else 0)
            if edit != "I":
                if turn is not None and turn != now["last"]:
                    now["least"] = turn if now["least"] is None else now["least"]
                    now["last"], now["turns"] = turn, now["turns"] + 1
                now["faults"][fault] += 1
                if now["before"] is not None and now["before"] + was[:1] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["before"] = was[:1]
            if edit != "D":
                now["sha"].update((f"{role}:" if now["first"] else f"\n{role}:").encode())
                now["sha"].update(text.encode())
                now["first"] = False

        def end():
            gaps = 0 if now["last"] is None else now["last"] - now["least"] + 1 - now["turns"]
            sink.add((now["id"], gaps, *(now["faults"][f] for f in FAULTS[1:]), now["illegal"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest()), len(now["audit"]) + 128)

        yield from conversations_of(batches, start, each, end, sink)

    return edits.mapInArrow(run, SUMMARY)


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return summaries(repair(damaged(table(spark, sf_dir, "conversations"))))
