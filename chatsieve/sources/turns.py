"""Turn tables: one row per message.

Canonical columns: ``conv_id``, ``turn`` (position from 0), ``role``,
``content``; (``conv_id``, ``turn``) is unique. This form is worked on by
aggregates and never needs a whole conversation in one row, so one
conversation may hold any share of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_turns(spark: SparkSession, path: str, content: str = "text") -> DataFrame:
    """Read a parquet turn table, of fixed schema, into the canonical columns."""
    schema = f"conv_id BIGINT, turn BIGINT, role STRING, {content} STRING"
    return (
        spark.read.schema(schema)
        .parquet(path)
        .withColumnRenamed(content, "content")
    )


def assemble(turns: DataFrame) -> DataFrame:
    """Turn rows to ``conv_id, messages`` with all messages in turn order.

    One conversation is one sample and so one row, however long. Scoring of turn
    tables never needs this form; where a conversation passes the size Spark
    allows for one row, the job fails and says so.
    """
    collected = F.expr("sort_array(collect_list(struct(turn, role, content)))")
    return (
        turns.groupBy("conv_id")
        .agg(collected.alias("messages"))
        .selectExpr(
            "conv_id",
            "transform(messages, m -> struct(m.role AS role, m.content AS content))"
            " AS messages",
        )
    )


def explode_messages(samples: DataFrame) -> DataFrame:
    """Nested rows back to turn rows."""
    return samples.selectExpr(
        "conv_id", "posexplode(messages) AS (pos, m)"
    ).selectExpr(
        "conv_id",
        "CAST(pos AS BIGINT) AS turn",
        "m.role AS role",
        "m.content AS content",
    )
