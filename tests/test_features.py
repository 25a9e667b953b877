from __future__ import annotations

import random

import pytest

from chatsieve.catalog.inputs import chat_input
from chatsieve.operators.features import (
    FEATURES,
    conversation_features,
    role_totals,
    sample_features,
)
from chatsieve.operators.validate import turn_faults, valid_conversations
from chatsieve.sources.turns import assemble, explode_messages
from tests.conftest import SF_SMALL, sample_rows, turn_rows

CONVERSATIONS = {
    1: [("user", "Hi"), ("assistant", "A b  a\nB"), ("user", "x"), ("assistant", "c A")],
    2: [("system", "s"), ("user", "Hi"), ("assistant", "")],
    3: [("user", "Hi"), ("assistant", " 　 ")],
    4: [("system", "s"), ("user", "é😀"), ("assistant", "ΟΔΟΣ οδος")],
}


def by_id(frame):
    return {r.conv_id: r.asDict() for r in frame.select("conv_id", *FEATURES).collect()}


def test_measures(spark):
    rows = by_id(conversation_features(turn_rows(spark, CONVERSATIONS)))
    first = rows[1]
    assert (first["n_messages"], first["n_user"], first["n_assistant"]) == (4, 2, 2)
    assert (first["user_chars"], first["assistant_chars"]) == (3, 11)
    # words: a b a b c a -> 6, distinct a b c -> 3
    assert (first["n_words"], first["n_distinct"]) == (6, 3)
    assert (rows[2]["n_system"], rows[2]["assistant_chars"], rows[2]["n_words"]) == (1, 0, 0)
    assert (rows[3]["assistant_chars"], rows[3]["n_words"], rows[3]["n_distinct"]) == (3, 0, 0)
    assert (rows[4]["user_chars"], rows[4]["n_distinct"]) == (2, 1)
    assert all(r["valid"] for r in rows.values())


def test_turn_route_equals_nested_route(spark):
    nested = by_id(sample_features(sample_rows(spark, CONVERSATIONS)))
    assert by_id(conversation_features(turn_rows(spark, CONVERSATIONS))) == nested


@pytest.mark.parametrize("long_turns", [1, 2, 3])
def test_long_conversations_give_the_same_measures(spark, long_turns):
    turns = chat_input(spark, SF_SMALL)
    expected = by_id(conversation_features(turns))
    assert by_id(conversation_features(turns, long_turns)) == expected


@pytest.mark.parametrize("min_hot_rows", [3, 10**6])
def test_long_route_without_broadcast(spark, monkeypatch, min_hot_rows):
    monkeypatch.setattr("chatsieve.operators.features.MAX_BROADCAST_IDS", 0)
    monkeypatch.setattr("chatsieve.operators.skew.MIN_HOT_ROWS", min_hot_rows)
    turns = chat_input(spark, SF_SMALL)
    expected = by_id(conversation_features(turns))
    for long_turns in (2, 5):
        assert by_id(conversation_features(turns, long_turns)) == expected


def test_one_conversation_with_a_third_of_all_turns(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(500)]
    hot = [
        ("assistant" if i % 2 else "user", " ".join(rng.choices(vocabulary, k=20)))
        for i in range(4000)
    ]
    rest = {i: [("user", "hello"), ("assistant", "word1 other")] for i in range(1, 4001)}
    rows = by_id(conversation_features(turn_rows(spark, {0: hot, **rest})))
    said = [w for role, text in hot if role == "assistant" for w in text.split()]
    assert rows[0]["n_messages"] == 4000
    assert rows[0]["n_words"] == len(said)
    assert rows[0]["n_distinct"] == len(set(said))
    assert len(rows) == 4001 and len({r["key"] for r in rows.values()}) == 2


def test_turn_faults_and_valid(spark):
    turns = turn_rows(
        spark,
        {
            1: [("user", "a"), ("assistant", "b")],
            2: [("user", "a")],
            3: [("bot", "a"), (None, None), ("assistant", "c")],
            4: [("system", "a"), ("user", "b")],
        },
    )
    got = {}
    for row in turn_faults(turns).collect():
        got.setdefault(row.conv_id, []).append(row.error)
    assert {k: sorted(v) for k, v in got.items()} == {
        2: ["no_assistant", "too_few_messages"],
        3: ["content_not_string@1", "invalid_role@0", "invalid_role@1", "no_user"],
        4: ["no_assistant"],
    }
    assert [r.conv_id for r in valid_conversations(turns).collect()] == [1]


def test_a_conversation_is_one_sample(spark):
    turns = chat_input(spark, SF_SMALL)
    back = explode_messages(assemble(turns))
    assert back.exceptAll(turns).isEmpty() and turns.exceptAll(back).isEmpty()
    said = [("user" if i % 2 == 0 else "assistant", f"turn number {i}") for i in range(1503)]
    rows = assemble(turn_rows(spark, {1: said})).collect()
    assert len(rows) == 1 and [m.content for m in rows[0].messages] == [c for _, c in said]


def test_role_totals(spark):
    rows = role_totals(turn_rows(spark, {1: CONVERSATIONS[1]})).collect()
    assert sorted((r.role, r.n, r.chars) for r in rows) == [
        ("assistant", 2, 11), ("user", 2, 3),
    ]


def numbered(spark, rows):
    kinds = "conv_id BIGINT, turn BIGINT, role STRING, content STRING"
    return spark.createDataFrame(rows, kinds)


SAID = [("user", "What is it?"), ("assistant", "It is the answer."), ("user", "Why?")]


def test_turn_numbers_may_start_anywhere(spark):
    starts = {1: 0, 2: 1, 3: -7, 4: 2**40, 5: 2**60}
    rows = [(c, start + i, *m) for c, start in starts.items() for i, m in enumerate(SAID)]
    rows += [(6, i, *m) for i, m in enumerate(reversed(SAID))]
    found = by_id(conversation_features(numbered(spark, rows)))
    nested = by_id(sample_features(sample_rows(spark, {1: SAID, 6: SAID[::-1]})))
    assert all(r["valid"] for r in found.values())
    assert {found[c]["key"] for c in starts} == {nested[1]["key"]}
    assert found[6]["key"] == nested[6]["key"] != nested[1]["key"]


@pytest.mark.parametrize(
    ("turns", "errors"),
    [
        ([0, 1, 2], []),
        ([0, 0, 1], ["repeated_turn@0"]),
        ([0, 1, 3], ["turn_gap"]),
        ([0, 0, 2], ["repeated_turn@0", "turn_gap"]),
        ([None, 0, 1], ["missing_turn"]),
        ([None, None, None], ["missing_turn"]),
        ([-(2**63), 0, 2**63 - 1], ["turn_gap"]),
    ],
)
def test_turn_numbers(spark, turns, errors):
    rows = numbered(spark, [(1, t, *m) for t, m in zip(turns, SAID)])
    assert sorted(r.error for r in turn_faults(rows).collect()) == errors
    assert valid_conversations(rows).count() == (not errors)
    assert [r.valid for r in conversation_features(rows).collect()] == [not errors]


def test_rows_without_a_conversation(spark):
    rows = numbered(spark, [(None, i, "user", None) for i in range(600)] + [(1, i, *m) for i, m in enumerate(SAID)])
    errors = [r.error for r in turn_faults(rows).where("conv_id IS NULL").collect()]
    assert errors.count("missing_id") == 1 and len(errors) == 601
    for long_turns in (256, 2):
        found = by_id(conversation_features(rows, long_turns))
        assert found[None]["valid"] is False and found[1]["valid"] is True


def test_many_gaps_and_repeats_are_seen(spark):
    """Random rows of turns with the right number, span and sum."""
    rng = random.Random(4)
    rows, whole = [], set()
    for c in range(400):
        turns = list(range(20))
        for _ in range(rng.randint(0, 3)):
            # Two inner turns move by one towards or away from each other: the sum stays.
            i, j = rng.sample(range(1, 19), 2)
            turns[i], turns[j] = min(turns[i] + 1, 19), max(turns[j] - 1, 0)
        if sorted(turns) == list(range(20)):
            whole.add(c)
        rows += [(c, t, *SAID[k % 2]) for k, t in enumerate(turns)]
    assert {r.conv_id for r in valid_conversations(numbered(spark, rows)).collect()} == whole
    assert 0 < len(whole) < 400
