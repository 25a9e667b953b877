"""Faults of chat samples, as stable codes.

``not_object``, ``missing_messages`` and ``messages_not_list`` end the check;
the others are reported side by side, those of message i with ``@i``.

The turns of a conversation in a turn table must have a conversation id and be numbered in a
row, from any number on: ``missing_id`` and ``missing_turn`` (NULL), ``repeated_turn@i``, ``turn_gap``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.functions.keys import is_series, power
from chatsieve.functions.text import let, quoted

# The roles a message may have, and the least number of messages.
ROLES = ["system", "user", "assistant"]
MIN_MESSAGES = 2

_KNOWN = ", ".join(quoted(role) for role in ROLES)


def is_type(value: str, prefix: str) -> str:
    """Whether the type of a VARIANT begins with ``prefix``."""
    return f"coalesce(startswith(schema_of_variant({value}), '{prefix}'), false)"


def _field(value: str, name: str) -> str:
    """A field as VARIANT: NULL if absent, a non-NULL variant for JSON null."""
    return f"try_variant_get({value}, '$.{name}', 'variant')"


def _text(value: str) -> str:
    """The text of a JSON string, NULL for any other value."""
    text = f"try_variant_get({value}, '$', 'string')"
    return f"CASE WHEN {is_type(value, 'STRING')} THEN {text} END"


def _message_faults() -> str:
    """Fault codes of message ``m`` at position ``i``, with ``role_``, ``content_``."""
    role_text = f"coalesce({_text('role_')}, '')"
    codes = f"""array_compact(array(
      CASE WHEN role_ IS NULL THEN concat('missing_role@', i)
        WHEN {role_text} NOT IN ({_KNOWN}) THEN concat('invalid_role@', i) END,
      CASE WHEN content_ IS NULL THEN concat('missing_content@', i)
        WHEN NOT {is_type("content_", "STRING")}
        THEN concat('content_not_string@', i) END))"""
    # The type of the whole message matters only where it has neither field.
    faults = f"""CASE WHEN role_ IS NULL AND content_ IS NULL
      AND NOT {is_type("m", "OBJECT")}
      THEN array(concat('message_not_object@', i)) ELSE {codes} END"""
    return let("role_", _field("m", "role"), let("content_", _field("m", "content"), faults))


def with_sample_faults(lines: DataFrame) -> DataFrame:
    """Add ``errors`` (ARRAY<STRING>, empty if valid) for the VARIANT ``sample``.

    ``errors`` is NULL where ``sample`` is, that is for malformed lines.
    """
    role_texts = f"transform(_items, m -> {let('r', _field('m', 'role'), _text('r'))})"
    in_list = f"""array_compact(concat(
      array(CASE WHEN size(_items) < {MIN_MESSAGES} THEN 'too_few_messages' END),
      flatten(transform(_items, (m, i) -> {_message_faults()})),
      array(
        CASE WHEN NOT exists(_roles, r -> r <=> 'user') THEN 'no_user' END,
        CASE WHEN NOT exists(_roles, r -> r <=> 'assistant') THEN 'no_assistant' END)
    ))"""
    return (
        lines.selectExpr(
            "*",
            "try_variant_get(sample, '$.messages', 'array<variant>') AS _items",
        )
        .selectExpr("*", f"{role_texts} AS _roles")
        .selectExpr(
            "*",
            f"""CASE WHEN _items IS NOT NULL THEN {in_list}
              WHEN {_field("sample", "messages")} IS NOT NULL
                THEN array('messages_not_list')
              WHEN {is_type("sample", "OBJECT")} THEN array('missing_messages')
              WHEN sample IS NOT NULL THEN array('not_object') END AS errors""",
        )
        .drop("_items", "_roles")
    )


# Conditions on a turn row.
BAD_ROLE = f"coalesce(role NOT IN ({_KNOWN}), true)"
BAD_CONTENT = "content IS NULL"

# Aggregates over turn rows that decide whether a conversation is valid.
CONVERSATION_COUNTS = {
    "n_messages": "count(*)",
    "n_user": "count_if(role = 'user')",
    "n_assistant": "count_if(role = 'assistant')",
    "n_bad": f"count_if({BAD_ROLE} OR {BAD_CONTENT} OR turn IS NULL)",
    "low": "min(turn)",
    "high": "max(turn)",
    "turn_sum": "try_sum(turn)",
    "turn_print": f"sum({power('turn')})",
}

# Turns in a row: as many as the span from least to greatest holds, with the sum and the
# fingerprint of such a row. One gap and one repeat always change the sum; more of both
# escape the fingerprint with a chance of 5e-10. Numbers whose sum is no BIGINT count as a gap.
_IN_A_ROW = f"""coalesce(try_subtract(high, low) = n_messages - 1
  AND turn_sum = try_add(try_multiply(low, n_messages), n_messages * (n_messages - 1) div 2)
  AND {is_series('turn_print', 'low', 'n_messages')}, false)"""

# Condition on these counts.
IS_VALID = (
    f"n_messages >= {MIN_MESSAGES} AND n_bad = 0 AND n_user > 0 AND n_assistant > 0"
    f" AND conv_id IS NOT NULL AND {_IN_A_ROW}"
)


def aggregates(named: dict[str, str]) -> list:
    """Aggregate Columns from a name-to-SQL mapping."""
    return [F.expr(sql).alias(name) for name, sql in named.items()]


def turn_faults(turns: DataFrame) -> DataFrame:
    """All faults of a turn table as ``conv_id, error`` rows.

    Faults of messages are found row by row. Turn numbers are counted by
    (conversation, turn), which spreads a conversation of any length; only the
    counts of a conversation are aggregated.
    """
    per_message = turns.selectExpr(
        "conv_id",
        f"""explode(array_compact(array(
          CASE WHEN {BAD_ROLE} THEN concat('invalid_role', coalesce(concat('@', turn), '')) END,
          CASE WHEN {BAD_CONTENT} THEN concat('content_not_string', coalesce(concat('@', turn), ''))
            END
        ))) AS error""",
    )
    per_turn = turns.groupBy("conv_id", "turn").agg(
        *aggregates(
            {
                "n": "count(*)",
                "n_user": "count_if(role = 'user')",
                "n_assistant": "count_if(role = 'assistant')",
            }
        )
    )
    repeated = per_turn.where("n > 1 AND turn IS NOT NULL AND conv_id IS NOT NULL").selectExpr(
        "conv_id", "concat('repeated_turn@', turn) AS error"
    )
    per_conversation = (
        per_turn.groupBy("conv_id")
        .agg(
            *aggregates(
                {
                    "n_messages": "sum(n)",
                    "n_user": "sum(n_user)",
                    "n_assistant": "sum(n_assistant)",
                    "n_turns": "count(turn)",
                    "n_unplaced": "sum(IF(turn IS NULL, n, 0L))",
                    "low": "min(turn)",
                    "high": "max(turn)",
                }
            )
        )
        .selectExpr(
            "conv_id",
            f"""explode(IF(conv_id IS NULL, array('missing_id'), array_compact(array(
              CASE WHEN n_messages < {MIN_MESSAGES} THEN 'too_few_messages' END,
              CASE WHEN n_user = 0 THEN 'no_user' END,
              CASE WHEN n_assistant = 0 THEN 'no_assistant' END,
              CASE WHEN n_unplaced > 0 THEN 'missing_turn' END,
              CASE WHEN n_turns > 0 AND coalesce(try_subtract(high, low) >= n_turns, true)
                THEN 'turn_gap' END
            )))) AS error""",
        )
    )
    return per_message.unionAll(repeated).unionAll(per_conversation)


def valid_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` of the conversations without a fault."""
    counts = turns.groupBy("conv_id").agg(*aggregates(CONVERSATION_COUNTS))
    return counts.where(IS_VALID).select("conv_id")
