r"""Chat text that reads back as exactly the turns it was made from.

A conversation is written turn by turn, ``<|im_start|>role\ntext<|im_end|>\n``, and
parsed back by a deterministic grammar:

    chat = turn*
    turn = "<|im_start|>" role "\n" body "<|im_end|>\n"

where neither role nor body holds ``<|``, and a role no line feed. In both, ``<``, one or more
backslashes and ``|`` stand for the same with one backslash less. So a text is written
as it is, or escaped: with one backslash more in each ``<|``, ``<\|``, ``<\\|`` ...

Round trip: rendered text is parsed and compared with its source. If it does not parse, or
other turns come out, the turns that do not survive alone are escaped, and the
whole is rendered and compared again until it is identical. Most texts stay as they are.

A row of the result holds up to ``BLOCK_TURNS`` turns, or ``PART_CHARS`` characters, of one
conversation, so nearly every conversation is one row and a conversation of any size is spread over
many; the concatenation in the order of (block, part) is the whole. ``loss`` lists
the places of assistant texts in ``text``, in code points, the end exclusive.

Edge cases. NULL roles and texts count as empty. Turns go by ``turn``, NULL first, then by
role and text; repeated rows are turns of their own. A line feed in a role is written
``\n`` and a backslash in a role doubled. NULL is a conversation of its own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The control strings of the template, and the role that is learned.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"

BLOCK_BITS = 10
BLOCK_TURNS = 1 << BLOCK_BITS
PART_CHARS = 4_000_000

_ESCAPABLE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPABLE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _read_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]], escaped: set[int]) -> str:
    """Text of turns; those in ``escaped`` with their role and text escaped."""
    out = []
    for i, (role, text) in enumerate(turns):
        role = _role(role)
        if i in escaped:
            role, text = escape(role), escape(text)
        out.append(f"{START}{role}\n{text}{END}\n")
    return "".join(out)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendered text, as role, text and the place of the written text.

    Raises ``ValueError`` where the grammar does not allow what it finds.
    """
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        head = at + len(START)
        begin = text.find("\n", head) + 1
        role = text[head : begin - 1]
        if not begin or "<|" in role:
            raise ValueError(f"no role at {head}")
        stop = text.find("<|", begin)
        if stop < 0 or not text.startswith(f"{END}\n", stop):
            raise ValueError(f"the turn at {at} does not end")
        turns.append((_read_role(unescape(role)), unescape(text[begin:stop]), begin, stop))
        at = stop + len(END) + 1
    return turns


def _survives(turns: list[tuple[str, str]], text: str) -> bool:
    try:
        return [t[:2] for t in parse(text)] == turns
    except ValueError:
        return False


def round_trip(turns: list[tuple[str, str]]) -> str:
    """Rendered turns that parse to the very same turns."""
    escaped: set[int] = set()
    while True:
        text = render(turns, escaped)
        if _survives(turns, text):
            return text
        found = {
            i
            for i, turn in enumerate(turns)
            if i not in escaped and not _survives([turn], render([turn], set()))
        }
        if not found:
            raise AssertionError("escaped turns do not read back")
        escaped |= found


_FORMATTED = pa.schema(
    [
        ("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.int64()),
        ("n_turns", pa.int64()), ("text", pa.string()),
        ("loss", pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))),
    ]
)


def _row(key: tuple, part: int, turns: list[tuple[str, str]]) -> dict:
    text = round_trip(turns)
    loss = [
        {"begin": begin, "stop": stop}
        for role, _, begin, stop in parse(text)
        if role == LEARNED
    ]
    return dict(
        zip(_FORMATTED.names, (*key, part, len(turns), text, loss), strict=True)
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, block and turn to formatted rows; a block may
    reach over many batches and is let go part by part."""
    key, part, turns, size = None, 0, [], 0
    for batch in batches:
        out = []
        for *at, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            at = tuple(at)
            if turns and (at != key or size > PART_CHARS):
                out.append(_row(key, part, turns))
                part, turns, size = part + 1, [], 0
            if at != key:
                key, part = at, 0
            turns.append((role, text))
            size += len(role) + len(text)
        if out:
            yield pa.RecordBatch.from_pylist(out, _FORMATTED)
    if turns:
        yield pa.RecordBatch.from_pylist([_row(key, part, turns)], _FORMATTED)


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, block, part, n_turns, text, loss`` of a turn table.

    ``conversations`` has ``conv_id``, ``turn`` (integers), ``role`` and ``text``. Blocks are
    stretches of turn numbers, so a long conversation is dealt to many tasks.
    """
    rows = conversations.selectExpr(
        "CAST(conv_id AS BIGINT) AS conv_id",
        # Floor division by BLOCK_TURNS, also below 0; NULL before all others.
        f"coalesce(shiftright(CAST(turn AS BIGINT), {BLOCK_BITS}), {-(2**62)}L) AS block",
        "CAST(turn AS BIGINT) AS turn",
        "coalesce(role, '') AS role",
        "coalesce(CAST(text AS STRING), '') AS text",
    )
    ordered = rows.repartition("conv_id", "block").sortWithinPartitions(
        "conv_id", "block", "turn", "role", "text"
    )
    return ordered.select("conv_id", "block", "role", "text").mapInArrow(
        _blocks,
        "conv_id BIGINT, block BIGINT, part BIGINT, n_turns BIGINT, text STRING,"
        " loss ARRAY<STRUCT<begin: BIGINT, stop: BIGINT>>",
    )


class _Digest:
    """What is read back from the formatted parts of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: list[dict]) -> None:
        for role, said, _, _ in parse(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        for span in loss:
            said = unescape(text[span["begin"] : span["stop"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))
        self.chars += len(text)

    def row(self) -> tuple:
        return (
            self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars,
            self.loss.hexdigest(), self.chars,
        )


_DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), _DIGESTS)], schema=_DIGESTS
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by conversation, one at a time; only the digests' states are kept."""
    now = None
    for batch in batches:
        out = []
        for conv_id, text, loss in zip(*batch.columns):
            conv_id = conv_id.as_py()
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.row())
                now = _Digest(conv_id)
            now.add(text.as_py(), loss.as_py())
        if out:
            yield _digest_rows(out)
    if now is not None:
        yield _digest_rows([now.row()])


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation ``n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars``, read back from ``format_chats``.

    A SHA-256 runs from the first to the last part, so a conversation's parts pass
    through one task, in order; the task holds one batch of parts.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    return ordered.select("conv_id", "text", "loss").mapInArrow(
        _digests,
        "conv_id BIGINT, n_turns BIGINT, turns_sha256 STRING, loss_chars BIGINT,"
        " loss_sha256 STRING, formatted_chars BIGINT",
    )
