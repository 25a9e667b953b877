"""Repair of the turn structure of conversations, with the cheapest edits.

A repaired conversation has an optional system turn and then user and assistant turns
in alternation, or nothing: its role initials give ``(s?(ua)+)?``. Keeping a turn costs 0,
giving it the role user or assistant 2, deleting it 3, inserting an empty user or assistant
turn 2, and each truncated turn that stays 1 more. Blank turns, and turns that repeat an
earlier one, must go. Among the cheapest edits the list of initials (D, I, K, R)
that is least in ASCII order is taken.

Secondary-sorted streaming, in two passes over rows dealt by conversation:

1. Rows without texts stream from the last turn to the first. What the rest of the
   conversation costs from each of the four grammar states is carried over Arrow
   batches. The best edit of each state is a back pointer of two bits, one byte a row;
   blocks of ``BLOCK_ROWS`` bytes are written as rows of a table, so a conversation
   of any length spills as it goes.
2. Pointer blocks and full rows are sorted together, each block before its first
   row, and stream from the first turn to the last. The edits that the pointers name are applied row
   by row, the state carried over batches; texts go straight into what is made of them.

The faults that need other rows are found before: the first turn of each repeated pair of role
and text comes from an aggregate that combines map-side, and only pairs that occur at several turns
are joined back. Equal rows of one turn are next to each other in the stream.

A conversation's rows pass through one task, in order, as the method asks; the task holds one batch
and one block of pointers.

Edge cases. NULL roles and texts count as one space, so such a text is blank. Turns go by ``turn``,
NULL first, rows of one turn by a digest of role and text. Only the initial of a role counts; roles
that begin with other letters than s, u and a can only be rerolled or deleted. NULL is a conversation
of its own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.tables import keep, size_checked

BLOCK_ROWS = 65_536
# A row of ids, a digest of 32 bytes and a place: about 100 bytes, 20 MB at most.
BROADCAST_PAIRS = 200_000

# Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

# Grammar states: at the start, after the system turn, after a user, after an assistant turn.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
# The user or assistant turn that may come next, and the state after it.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}
EDITS = "DIKR"

# What a turn is for the costs: its initial, or one of these.
OTHER, MUST_GO = ".", "-"
# As in a SQL literal.
SPACES = r" \t\n\u000b\u000c\r"


def _after_inserts(costs: list[int]) -> list[int]:
    """Costs if turns may be inserted first; two at most, as four states go round."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return costs


# Behind the last turn the conversation may end at the start or after an assistant.
END_COSTS = _after_inserts([0, 99, 99, 0])


def step(initial: str, truncated: bool, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Cost from each state through one turn and the rest, and the edits to begin with.

    ``after`` are the costs of the rest. The edits are four of two bits; ``I`` is
    followed by the edit of the state it leads to.
    """
    extra = TRUNCATED if truncated else 0
    options = []
    for state in range(4):
        costs = {"D": DELETE + after[state]}
        if initial != MUST_GO:
            costs["R"] = REROLE + extra + after[NEXT[state]]
            if initial in KEPT[state]:
                costs["K"] = extra + after[KEPT[state][initial]]
        options.append(costs)
    best = _after_inserts([min(o.values()) for o in options])
    edits = 0
    for state, costs in enumerate(options):
        costs["I"] = INSERT + best[NEXT[state]]
        first = min(e for e, c in costs.items() if c == best[state])
        edits |= EDITS.index(first) << 2 * state
    return tuple(best), edits


class Costs:
    """The costs of the rest of a conversation, read from its end.

    Only differences of the four costs matter and there are few, so each kind
    of turn after each set of differences is worked out once.
    """

    def __init__(self):
        self.known: dict = {}
        self.reset()

    def reset(self) -> None:
        self.after = tuple(END_COSTS)

    def add(self, initial: str, truncated: bool) -> int:
        """One turn further to the front; returns its edits."""
        key = (initial, truncated, self.after)
        found = self.known.get(key)
        if found is None:
            best, edits = step(*key)
            least = min(best)
            found = self.known[key] = (tuple(c - least for c in best), edits)
        self.after = found[0]
        return found[1]


def _pointers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of conversations, last turn first, to blocks of edits in turn order.

    Blocks count down from 0, the last one. Equal rows of one turn repeat the first of them, which
    comes last here; so a turn is taken up when the one before it has been seen.
    """
    costs, block, number, late = Costs(), bytearray(), 0, None

    def written() -> dict:
        conv_id, place, digest = late[:3]
        return {
            "conv_id": conv_id, "place": place, "digest": digest, "seq": -number,
            "edits": bytes(reversed(block)),
        }

    for batch in batches:
        out = []
        columns = (batch.column(i).to_pylist() for i in range(batch.num_columns))
        for turn in zip(*columns):
            if late is not None:
                repeats = turn[:3] == late[:3]
                block.append(costs.add(MUST_GO if repeats else late[3], late[4]))
                ends = turn[0] != late[0]
                if ends or len(block) >= BLOCK_ROWS:
                    out.append(written())
                    block, number = bytearray(), number + 1
                if ends:
                    number = 0
                    costs.reset()
            late = turn
        if out:
            yield pa.RecordBatch.from_pylist(out, _BLOCKS)
    if late is not None:
        block.append(costs.add(late[3], late[4]))
        yield pa.RecordBatch.from_pylist([written()], _BLOCKS)


_BLOCKS = pa.schema(
    [
        ("conv_id", pa.int64()), ("place", pa.int64()), ("digest", pa.binary()),
        ("seq", pa.int64()), ("edits", pa.binary()),
    ]
)
_EDITS = pa.schema(
    [
        ("conv_id", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()),
        ("was", pa.string()), ("role", pa.string()), ("text", pa.string()),
        ("fault", pa.string()),
    ]
)


class Repair:
    """Applies the edits to one conversation after another."""

    def __init__(self):
        self.out: list[tuple] = []
        self.conv: tuple | None = None

    def open(self, conv: tuple) -> None:
        self.close()
        self.conv, self.state, self.seen = conv, BEGIN, None
        self.blocks: list[bytes] = []
        self.at = 0

    def close(self) -> None:
        """Insert what the end of the grammar still asks for."""
        if self.conv is not None:
            while self.state in (SYSTEM, USER):
                self.insert()

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.out.append((*self.conv, "I", None, None, NAMES[self.state], "", None))

    def pointer(self) -> int:
        if self.at == len(self.blocks[0]):
            self.blocks.pop(0)
            self.at = 0
        self.at += 1
        return self.blocks[0][self.at - 1]

    def add(self, place: int, digest: bytes, turn: int | None, was: str, text: str, fault: str | None) -> None:
        """One row, after the turns that are inserted before it."""
        if fault != "blank" and self.seen == (place, digest):
            fault = "duplicate"
        self.seen = (place, digest)
        edits = self.pointer()
        while (edit := EDITS[edits >> 2 * self.state & 3]) == "I":
            self.insert()
        role = None
        if edit == "D":
            text = None
        elif edit == "K":
            role, self.state = was, KEPT[self.state][was[0]]
        else:
            self.state = NEXT[self.state]
            role = NAMES[self.state]
        self.out.append((*self.conv, edit, turn, was, role, text, fault))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and pointer blocks in turn order to edited rows."""
    work = Repair()

    def edited() -> pa.RecordBatch:
        columns = zip(*work.out) if work.out else [()] * len(_EDITS)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _EDITS)]
        work.out = []
        return pa.RecordBatch.from_arrays(arrays, schema=_EDITS)

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            columns = (part.column(i).to_pylist() for i in range(part.num_columns))
            for conv_id, edits, place, digest, *row in zip(*columns):
                if work.conv != (conv_id,):
                    work.open((conv_id,))
                if edits is not None:
                    work.blocks.append(edits)
                else:
                    work.add(place, digest, *row)
            yield edited()
    work.close()
    yield edited()


def repair(conversations: DataFrame) -> DataFrame:
    """The edits of every conversation, in order: ``conv_id, edit, turn, was, role, text,
    fault``.

    ``was`` is the role before the edit; ``role`` and ``text`` are those of the repaired turn, NULL
    if it is deleted. ``fault`` is blank, duplicate, truncated or NULL. Rows of a conversation stand
    together, in one partition, until the result is written or shuffled.
    """
    trimmed = f"trim(TRAILING '{SPACES}' FROM text)"
    rows = (
        conversations.selectExpr(
            "CAST(conv_id AS BIGINT) AS conv_id",
            "CAST(turn AS BIGINT) AS turn",
            f"coalesce(CAST(turn AS BIGINT), {-(2**62)}L) AS place",
            "coalesce(role, ' ') AS role",
            "coalesce(CAST(text AS STRING), ' ') AS text",
        )
        .selectExpr("*", f"right({trimmed}, 1) AS end")
        .selectExpr(
            "*",
            "unhex(sha2(concat(length(role), ':', role, text), 256)) AS digest",
            "end = '' AS blank",
            "end NOT IN ('.', '!', '?') AS truncated",
        )
    )
    first = keep(
        rows.where("NOT blank")
        .groupBy("conv_id", "digest")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .where("first < last")
        .selectExpr("conv_id AS _id", "digest AS _digest", "first"),
        "repeated-turns",
    )
    marked = rows.join(
        size_checked(first, BROADCAST_PAIRS),
        F.expr("conv_id <=> _id AND digest = _digest"),
        "left",
    ).selectExpr(
        "conv_id", "place", "digest", "turn", "role", "text",
        """CASE WHEN blank THEN 'blank' WHEN place > first THEN 'duplicate'
          WHEN truncated THEN 'truncated' END AS fault""",
    )
    blocks = keep(
        marked.selectExpr(
            "conv_id", "place", "digest",
            f"""CASE WHEN fault IN ('blank', 'duplicate') THEN '{MUST_GO}'
              WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1)
              ELSE '{OTHER}' END AS initial""",
            "coalesce(fault = 'truncated', false) AS truncated",
        )
        .repartition("conv_id")
        .sortWithinPartitions(F.desc("conv_id"), F.desc("place"), F.desc("digest"))
        .mapInArrow(
            _pointers,
            "conv_id BIGINT, place BIGINT, digest BINARY, seq BIGINT, edits BINARY",
        ),
        "edit-blocks",
    )
    columns = ["conv_id", "edits", "place", "digest", "turn", "role", "text", "fault"]
    return (
        marked.selectExpr("*", "1L AS seq")
        .unionByName(blocks, allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "place", "digest", "seq")
        .select(*columns)
        .mapInArrow(
            _apply,
            "conv_id BIGINT, edit STRING, turn BIGINT, was STRING, role STRING,"
            " text STRING, fault STRING",
        )
    )


LEGAL = {"su", "ua", "au"}
EDIT_COSTS = {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}


class Audit:
    """Counts and digests of one conversation, edit by edit."""

    def __init__(self, conv: tuple):
        self.conv, self.cost, self.illegal, self.last = conv, 0, 0, None
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.low = self.high = None
        self.turns = 0
        self.edits: list[str] = []
        self.digest, self.empty = hashlib.sha256(), True

    def add(self, edit: str, turn: int | None, was: str | None, role: str | None,
            text: str | None, fault: str | None) -> None:
        self.edits.append(edit)
        self.cost += EDIT_COSTS[edit]
        if edit != "I":
            if self.last is not None and self.last + was[:1] not in LEGAL:
                self.illegal += 1
            self.last = was[:1]
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.turns = turn, self.turns + 1
            if fault:
                self.faults[fault] += 1
                if fault == "truncated" and edit != "D":
                    self.cost += TRUNCATED
        if edit != "D":
            lead = "" if self.empty else "\n"
            self.digest.update(f"{lead}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.empty = False

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (
            *self.conv, gaps, *self.faults.values(), self.illegal, self.cost,
            "".join(self.edits), self.digest.hexdigest(),
        )


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_AUDITS = pa.schema(
    [("conv_id", pa.int64())]
    + [(name, pa.int64()) for name in COUNTS]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out = None, []

    def done() -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * len(_AUDITS)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _AUDITS)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=_AUDITS)

    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(batch.num_columns))
        for conv_id, *edit in zip(*columns):
            if now is None or now.conv != (conv_id,):
                if now is not None:
                    out.append(now.row())
                now = Audit((conv_id,))
            now.add(*edit)
        yield done()
    if now is not None:
        out.append(now.row())
    yield done()


def audits(edits: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``: ``gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256``.

    Reads the rows as ``repair`` gives them, without another shuffle: hand in its own result.
    """
    counts = ", ".join(f"{name} BIGINT" for name in COUNTS)
    return edits.mapInArrow(
        _audits, f"conv_id BIGINT, {counts}, audit STRING, repaired_sha256 STRING"
    )
