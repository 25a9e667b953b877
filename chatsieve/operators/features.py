"""Measures of a conversation that its score, key and statistics need.

Two routes give the same columns: ``sample_features`` works inside a nested
row, ``conversation_features`` aggregates turn rows.

Columns: ``n_messages, n_user, n_assistant, n_system, user_chars,
assistant_chars, n_words, n_distinct, key, valid``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from chatsieve.functions.keys import (
    G,
    LANES,
    P,
    content_key,
    lane,
    message_digest,
    moved,
    power,
    to_start,
)
from chatsieve.functions.text import ratio, words
from chatsieve.operators.skew import split_by_keys
from chatsieve.operators.validate import CONVERSATION_COUNTS, IS_VALID, aggregates

FEATURES = [
    "n_messages", "n_user", "n_assistant", "n_system",
    "user_chars", "assistant_chars", "n_words", "n_distinct", "key", "valid",
]

# The words of a conversation with at least this many turns are counted in a
# shuffle of their own; the texts of a shorter one are few enough for one group.
LONG_TURNS = 256

# At most this many ids of long conversations are broadcast: below a megabyte.
MAX_BROADCAST_IDS = 100_000

_LANES = [f"_lane{i}" for i in range(LANES)]


def contents_of(messages: str, role: str) -> str:
    """Contents of one role's messages, in order."""
    return f"transform(filter({messages}, m -> m.role = '{role}'), m -> m.content)"


def _chars(texts: str) -> str:
    return f"aggregate({texts}, 0L, (n, t) -> n + length(t))"


def sample_features(samples: DataFrame) -> DataFrame:
    """Add the feature columns to rows with typed ``messages``; row-local.

    Rows whose ``messages`` is NULL (invalid samples) get ``valid = false`` and
    NULL measures.
    """
    digest = message_digest("m.role", "m.content")
    # Horner's rule, from the last message to the first.
    lanes = [
        f"aggregate(reverse(_digests), 0L, (acc, d) -> (acc * {G}L + {lane('d', i)}) % {P}L)"
        for i in range(LANES)
    ]
    key = content_key("n_messages", lanes)
    return (
        samples.selectExpr(
            "*",
            f"{contents_of('messages', 'user')} AS _user",
            f"{contents_of('messages', 'assistant')} AS _said",
            f"transform(messages, m -> {digest}) AS _digests",
        )
        .selectExpr("*", f"{words("array_join(_said, ' ')")} AS _words")
        .selectExpr(
            "*",
            "CAST(size(messages) AS BIGINT) AS n_messages",
            "CAST(size(_user) AS BIGINT) AS n_user",
            "CAST(size(_said) AS BIGINT) AS n_assistant",
            "CAST(size(filter(messages, m -> m.role = 'system')) AS BIGINT)"
            " AS n_system",
            f"{_chars('_user')} AS user_chars",
            f"{_chars('_said')} AS assistant_chars",
            "CAST(size(_words) AS BIGINT) AS n_words",
            "CAST(size(array_distinct(_words)) AS BIGINT) AS n_distinct",
            f"CASE WHEN messages IS NOT NULL THEN {key} END AS key",
            "messages IS NOT NULL AS valid",
        )
        .drop("_user", "_said", "_digests", "_words")
    )


def _keyed(turns: DataFrame) -> DataFrame:
    """Add the lanes of each turn, weighted by its place."""
    digest = message_digest("role", "content")
    lanes = [f"{lane('_digest', i)} * _power % {P}L" for i in range(LANES)]
    return (
        turns.selectExpr("*", f"{digest} AS _digest", f"{power('turn')} AS _power")
        .selectExpr("*", *[f"{sql} AS {name}" for sql, name in zip(lanes, _LANES)])
        .drop("_digest")
    )


_SUMS = {
    **CONVERSATION_COUNTS,
    "n_system": "count_if(role = 'system')",
    "user_chars": "coalesce(sum(length(content)) FILTER (WHERE role = 'user'), 0L)",
    "assistant_chars": (
        "coalesce(sum(length(content)) FILTER (WHERE role = 'assistant'), 0L)"
    ),
    **{name: f"sum({name})" for name in _LANES},
}
# Rows without a conversation are no sample and may be any number.
_SAID = "collect_list(content) FILTER (WHERE role = 'assistant' AND conv_id IS NOT NULL)"


def _short_features(turns: DataFrame) -> DataFrame:
    """One exchange: the words are split and counted where the texts meet."""
    return (
        _keyed(turns)
        .groupBy("conv_id")
        .agg(*aggregates({**_SUMS, "_said": _SAID}))
        .selectExpr("*", f"{words("array_join(_said, ' ')")} AS _words")
        .selectExpr(
            "*",
            "CAST(size(_words) AS BIGINT) AS n_words",
            "CAST(size(array_distinct(_words)) AS BIGINT) AS n_distinct",
        )
        .drop("_said", "_words")
    )


def _long_features(turns: DataFrame) -> DataFrame:
    """No step gathers a conversation: each combines map-side, and distinct words
    are spread by (conversation, word)."""
    spoken = turns.where("role = 'assistant'").selectExpr(
        "conv_id", f"{words('content')} AS _words"
    )
    totals = spoken.groupBy("conv_id").agg(
        *aggregates({"n_words": "coalesce(sum(size(_words)), 0L)"})
    )
    distinct = (
        spoken.selectExpr("conv_id", "explode(array_distinct(_words)) AS word")
        .distinct()
        .groupBy("conv_id")
        .agg(*aggregates({"n_distinct": "count(*)"}))
    )
    return (
        _keyed(turns)
        .groupBy("conv_id")
        .agg(*aggregates(_SUMS))
        .join(totals, "conv_id", "left")
        .join(distinct, "conv_id", "left")
        .na.fill(0, ["n_words", "n_distinct"])
    )


def conversation_features(
    turns: DataFrame, long_turns: int = LONG_TURNS
) -> DataFrame:
    """``conv_id`` and the feature columns of every conversation of a turn table.

    One exchange in the usual case. Conversations of ``long_turns`` turns or
    more, if the table has any, take a second way that never gathers them.
    """
    long_ids = turns.where(f"turn >= {long_turns}").select("conv_id")
    if long_ids.isEmpty():
        features = _short_features(turns)
    else:
        short, long = split_by_keys(
            turns, long_ids.distinct(), "conv_id", MAX_BROADCAST_IDS
        )
        features = _short_features(short).unionByName(_long_features(long))
    plain = [c for c in FEATURES if c not in ("key", "valid")]
    return features.selectExpr("*", f"{to_start('low')} AS _start").selectExpr(
        "conv_id",
        *plain,
        f"{content_key('n_messages', [moved(l, '_start') for l in _LANES])} AS key",
        f"{IS_VALID} AS valid",
    )


# Inputs of the score: turn count, system flag and mean lengths.
MEANS = [
    "n_system > 0 AS has_system",
    "n_user + n_assistant AS turns",
    f"{ratio('user_chars', 'n_user')} AS mean_user",
    f"{ratio('assistant_chars', 'n_assistant')} AS mean_assistant",
]


def with_means(features: DataFrame) -> DataFrame:
    """Add the inputs of the score."""
    return features.selectExpr("*", *MEANS)


def role_totals(turns: DataFrame) -> DataFrame:
    """``conv_id, role, n, chars`` per role of each conversation."""
    return turns.groupBy("conv_id", "role").agg(
        *aggregates({"n": "count(*)", "chars": "sum(length(content))"})
    )
