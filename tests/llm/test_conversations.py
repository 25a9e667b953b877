"""Chat formatting and structure repair: round trips, brute force, streams over many batches."""

from __future__ import annotations

import hashlib
import heapq
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatsieve.llm import chat_format, repair
from chatsieve.llm.catalog import HOSTILE, damaged

KINDS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
PIECES = ["<", "|", "\\", "<|im_end|>", "<|im_start|>", "\n", "assistant", "a", "<\\|", ">"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turns(spark, rows):
    df = spark.createDataFrame(rows, KINDS)
    for name in ("block", "part", "place", "digest", "edits", "seq", "first", "end", "fault", "_id"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=5))
@settings(max_examples=300, deadline=None)
def test_any_turns_read_back(said):
    text = chat_format.round_trip(said)
    assert [t[:2] for t in chat_format.parse(text)] == said
    for role, body, begin, stop in chat_format.parse(text):
        assert chat_format.unescape(text[begin:stop]) == body


def test_plain_texts_stay_as_they_are():
    text = chat_format.round_trip([("user", "a < b | c"), ("assistant", "x <\\ y")])
    assert text == (
        "<|im_start|>user\na < b | c<|im_end|>\n<|im_start|>assistant\nx <\\ y<|im_end|>\n"
    )
    for bad in (text[1:], text[:-1], text.replace("user\n", "user"), text + "x", "<|im_start|>u\n<|x"):
        with pytest.raises(ValueError):
            chat_format.parse(bad)


def formatted(rows):
    """Expected digests by conversation, from source rows."""
    out = {}
    def order(r):
        return [(v is not None, v or "") if i else (v is not None, v or 0) for i, v in enumerate(r[1:])]
    for r in sorted(rows, key=order):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return {
        conv: (
            len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)),
            sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant")),
        )
        for conv, t in out.items()
    }


ODD = [
    (1, None, None, None), (1, None, "user", "a"), (1, 0, "", ""), (1, 0, "", ""), (1, -5, "assistant", "é<|x|>"),
    (2, 2**40, "assistant", HOSTILE), (2, 2**40, "assistant", HOSTILE), (2, 3, "a\n\\b<|", "\n"),
    (None, 1, "assistant", "n"), (None, None, "user", " "), (3, 0, "assistant", "long " * 100_000),
]


def test_format_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART_CHARS", 300_000)
    rows = ODD + [(7, i, "user" if i % 2 else "assistant", f"<|t{i}|>" * (i % 3)) for i in range(3000)]
    parts = chat_format.format_chats(turns(spark, rows)).cache()
    assert parts.where("conv_id = 7").count() == 3
    out = chat_format.digests(parts).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in out} == formatted(rows)
    chars = parts.groupBy("conv_id").agg({"n_turns": "sum"}).count()
    assert chars == len(out) == 5
    parts.unpersist()


def test_format_of_no_rows(spark):
    none = chat_format.format_chats(turns(spark, []))
    assert none.count() == 0 and chat_format.digests(none).count() == 0


# --- repair -----------------------------------------------------------------

GRAMMAR = {"": "su", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def faults(rows):
    """Fault of each row, in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        out.append(
            "blank" if not body else "duplicate" if (role, text) in seen
            else None if body[-1] in ".!?" else "truncated"
        )
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit) and the turns it leaves, by best-first search over all edits."""
    found = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, kept = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, kept
        moves = [("I", 2, x, (NAME[x], ""), 0) for x in GRAMMAR[last] if x != "s"]
        if i < len(rows):
            role, text = rows[i]
            moves.append(("D", 3, None, None, 1))
            if found[i] not in ("blank", "duplicate"):
                late = found[i] == "truncated"
                if role[:1] and role[:1] in GRAMMAR[last]:
                    moves.append(("K", late, role[0], (role, text), 1))
                moves += [("R", 2 + late, x, (NAME[x], text), 1) for x in GRAMMAR[last] if x != "s"]
        for edit, price, x, turn, step in moves:
            new = (cost + price, audit + edit, i + step, last if x is None else x)
            heapq.heappush(heap, (*new, kept if turn is None else (*kept, turn)))


def expected(rows):
    """Audit of one conversation from ``(turn, role, text)`` rows in order."""
    said = [(r, t) for _, r, t in rows]
    cost, audit, kept = cheapest(said)
    found = faults(said)
    numbers = [t for t, _, _ in rows if t is not None]
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
    return (
        max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        *(found.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
        sha("\n".join(f"{r}:{t}" for r, t in kept)),
    )


def audited(df):
    return {r.conv_id: tuple(r)[1:] for r in repair.audits(repair.repair(df)).collect()}


@pytest.mark.parametrize("block_rows", [repair.BLOCK_ROWS, 3])
def test_repairs_are_the_cheapest(spark, monkeypatch, block_rows):
    monkeypatch.setattr(repair, "BLOCK_ROWS", block_rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    rng = random.Random(11)
    texts = ["Yes.", "No!", "cut", "cut off\n", " ", "", "Why?", "a.", "b."]
    roles = ["system", "user", "user", "assistant", "assistant", "bot", ""]
    talks = {
        i: [(j * rng.choice((1, 1, 2)), rng.choice(roles), rng.choice(texts)) for j in range(rng.randint(1, 12))]
        for i in range(120)
    }
    talks[None] = [(None, "user", "hm."), (1, "assistant", "x.")]
    for rows in talks.values():
        # One row for each turn, but for equal ones.
        numbers = {t: (t, r, x) for t, r, x in rows}
        rows[:] = [numbers[t] for t in sorted(numbers, key=lambda t: (t is not None, t or 0))]
        if len(rows) % 3 == 0:
            rows.insert(1, rows[0])
    flat = [(c, *r) for c, rows in talks.items() for r in rows]
    try:
        assert audited(turns(spark, flat)) == {c: expected(r) for c, r in talks.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_giant_conversation_streams(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_ROWS", 1000)
    rng = random.Random(2)
    rows = [(j, rng.choice(["user", "assistant"]), f"text {j % 9000}{rng.choice(['.', ''])}") for j in range(20_000)]
    rows += [rows[-1]] * 3000
    short = [(0, "user", "Hi."), (1, "assistant", "Yes.")]
    df = turns(spark, [(1, *r) for r in rows] + [(2, *r) for r in short])
    assert audited(df) == {1: expected(rows), 2: expected(short)}


def test_repair_of_odd_rows(spark):
    out = audited(turns(spark, ODD))
    assert set(out) == {1, 2, None, 3}
    assert out[2][1:4] == (1, 1, 1) and out[3][3] == 1
    edits = repair.repair(turns(spark, ODD)).collect()
    for conv in out:
        left = "".join(r.role[0] for r in edits if r.conv_id == conv and r.role)
        assert left == "" or left.removeprefix("s") == "ua" * (len(left.removeprefix("s")) // 2)
    assert audited(turns(spark, [])) == {}


def test_damage(spark):
    rows = [(i, j, "assistant", "A. b! c?") for i in range(30) for j in range(10)] + [(None, None, None, None)]
    out = damaged(spark.createDataFrame(rows, KINDS))
    import zlib
    kinds = {(i, j): zlib.crc32(f"{' ' if i is None else i}:{' ' if j is None else j}".encode()) % 20 for i, j, _, _ in rows}
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in out.collect()), key=repr)
    want = []
    for i, j, role, text in rows:
        kind, role, text = kinds[i, j], role or " ", text or " "
        text = {1: "", 2: "A b c" if text != " " else " "}.get(kind, text)
        want += [(i, j, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    assert got == sorted(want, key=repr)
