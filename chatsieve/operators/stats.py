"""Statistics over the narrow frame of ``curate``: no text is read again.

``measures`` is one aggregate with a row for each bucket of valid samples and one for invalid
ones. All statistics are sums over these few rows, so that one scan of the curated table serves them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.functions.text import py_round, ratio
from chatsieve.operators.validate import aggregates

_SUMS = ["n_messages", "n_assistant", "n_system", "n_user", "user_chars", "assistant_chars"]


def measures(curated: DataFrame) -> DataFrame:
    """Per ``valid`` and ``bucket``: numbers of samples and, for kept ones, of messages and
    characters."""
    kept = "valid AND drop_reason IS NULL"
    return curated.groupBy("valid", "bucket").agg(
        *aggregates(
            {
                "n": "count(*)",
                "copies": "sum(copies)",
                "n_kept": f"count_if({kept})",
                **{c: f"coalesce(sum({c}) FILTER (WHERE {kept}), 0L)" for c in _SUMS},
            }
        )
    )


def counters(measured: DataFrame) -> DataFrame:
    """One row of counts, from raw samples to kept ones.

    ``invalid_removed`` is the part the other counters leave over.
    """
    return measured.selectExpr(
        "coalesce(sum(copies), 0L) AS total_raw",
        "coalesce(sum(IF(valid, 0L, copies)), 0L) AS invalid_removed",
        "coalesce(sum(IF(valid, copies - n, 0L)), 0L) AS duplicates_removed",
        "coalesce(sum(IF(valid, n - n_kept, 0L)), 0L) AS low_quality_removed",
        "coalesce(sum(n_kept), 0L) AS total_filtered",
    )


def role_distribution(measured: DataFrame) -> DataFrame:
    """``role, n``: messages per role over kept samples, roles in order."""
    return (
        measured.selectExpr(
            "sum(n_assistant) AS assistant", "sum(n_system) AS system",
            "sum(n_user) AS user",
        )
        .selectExpr(
            "stack(3, 'assistant', assistant, 'system', system, 'user', user)"
            " AS (role, n)"
        )
        .where("n > 0")
        .orderBy("role")
    )


def quality_histogram(measured: DataFrame) -> DataFrame:
    """``bucket, n`` over deduplicated samples, before the thresholds."""
    return measured.where("valid").groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket")


def averages(measured: DataFrame) -> DataFrame:
    """Mean messages per kept sample and mean lengths per message, one digit."""
    means = {
        "avg_turns": ratio("sum(n_messages)", "sum(n_kept)"),
        "avg_user_length": ratio("sum(user_chars)", "sum(n_user)"),
        "avg_assistant_length": ratio("sum(assistant_chars)", "sum(n_assistant)"),
    }
    return measured.selectExpr(*[f"{sql} AS {name}" for name, sql in means.items()]).selectExpr(
        *[f"coalesce({py_round(m, 1)}, 0D) AS {m}" for m in means]
    )
