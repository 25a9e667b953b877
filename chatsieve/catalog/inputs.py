"""Inputs that Spark derives from the ``conversations`` table.

The table has no copies and hardly any faults, so the queries start from a
fixed variation of it that has both. It covers every row of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsieve.functions.text import words
from chatsieve.sources.jsonl import to_lines
from chatsieve.sources.turns import assemble, read_turns
from chatsieve.storage import scratch_path

MIN_QUALITY = 0.4
EVAL_RATIO = 0.1
SEED = 42


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_turns(spark, f"{sf_dir}/conversations.parquet")


def chat_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turn rows as they are and, added row by row: copies (shift of 1 and 2
    million), short texts (3), a bad role (4) and a missing text (5)."""
    return (
        conversations(spark, sf_dir)
        .selectExpr(
            "*",
            """explode(array_compact(array(0,
              IF(conv_id % 5 = 0, 1000000, NULL), IF(conv_id % 10 = 0, 2000000, NULL),
              IF(conv_id % 7 = 3, 3000000, NULL), IF(conv_id % 11 = 4, 4000000, NULL),
              IF(conv_id % 13 = 6, 5000000, NULL)))) AS shift""",
        )
        .selectExpr(
            "conv_id + shift AS conv_id",
            "turn",
            "IF(shift = 4000000 AND turn = 1, 'bot', role) AS role",
            """CASE WHEN shift = 5000000 AND turn = 0 THEN NULL
              WHEN shift = 3000000 THEN substring(content, 1, 3)
              ELSE content END AS content""",
        )
    )


def turn_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chat_input`` and more conversations whose turns are numbered otherwise: from 1 (shift of 10
    million), with a repeat (20), a gap (30), a missing number (40), and rows without an id."""
    return (
        chat_input(spark, sf_dir)
        .selectExpr(
            "*",
            """explode(array_compact(array(0,
              IF(conv_id % 17 = 1, 10000000, NULL), IF(conv_id % 19 = 2, 20000000, NULL),
              IF(conv_id % 23 = 3, 30000000, NULL), IF(conv_id % 29 = 4, 40000000, NULL),
              IF(conv_id % 31 = 5, -1, NULL)))) AS renumbered""",
        )
        .selectExpr(
            "IF(renumbered = -1, NULL, conv_id + renumbered) AS conv_id",
            """CASE renumbered WHEN 10000000 THEN turn + 1 WHEN 20000000 THEN IF(turn = 1, 0, turn)
              WHEN 30000000 THEN IF(turn > 0, turn + 1, turn)
              WHEN 40000000 THEN IF(turn = 0, NULL, turn) ELSE turn END AS turn""",
            "role",
            "content",
        )
    )


def chat_lines(spark: SparkSession, sf_dir: str, cut: bool = False) -> str:
    """Write ``chat_input`` as JSON Lines in conversation order; returns the path.

    With ``cut``, lines of ``conv_id % 17 = 5`` lose their last five characters, and a blank line
    stands before those of ``conv_id % 19 = 6``.
    """
    lines = to_lines(assemble(chat_input(spark, sf_dir)))
    if cut:
        lines = lines.selectExpr(
            "conv_id",
            "IF(conv_id % 17 = 5, substring(raw, 1, length(raw) - 5), raw) AS raw",
        ).selectExpr("conv_id", "IF(conv_id % 19 = 6, concat('\\n', raw), raw) AS raw")
    path = scratch_path(spark, "jsonl")
    lines.sort("conv_id").select("raw").write.text(path)
    return path


def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, base and tuned response of each user turn that an assistant turn
    follows; names repeat."""
    turns = conversations(spark, sf_dir)
    asked = turns.where("role = 'user'").selectExpr(
        "conv_id", "turn + 1 AS turn", "content AS question"
    )
    answered = turns.where("role = 'assistant'").selectExpr(
        "conv_id", "turn", "content AS answer"
    )
    first_words = f"transform(slice({words('answer')}, 1, 3), w -> upper(w))"
    return asked.join(answered, ["conv_id", "turn"]).selectExpr(
        "conv_id * 1000000 + turn AS pos",
        "concat('p', (conv_id + turn) % 40) AS name",
        "question AS user",
        "IF(conv_id % 3 = 0, 'Be brief.', NULL) AS system",
        f"IF(conv_id % 4 <> 0, concat({first_words}, array('zzzz')), NULL)"
        " AS expected_keywords",
        "IF(conv_id % 5 = 0, 64, NULL) AS max_tokens",
        """CASE (conv_id + turn) % 5 WHEN 0 THEN concat(answer, ' ', question)
          WHEN 1 THEN replace(answer, ' ', ' a ') WHEN 2 THEN ' '
          ELSE answer END AS base""",
        "answer AS tuned",
    )


def prompts(rows: DataFrame) -> DataFrame:
    return rows.select(
        "pos", "name", "user", "system", "expected_keywords", "max_tokens"
    )


def prompt_documents(rows: DataFrame) -> str:
    """Write the prompts as JSON documents with a ``prompts`` list, one for each 500
    conversations; returns the path. By position, items get faults: a list as ``user``, no ``user``,
    numbers as keywords, text as ``max_tokens``, and a text instead of an item."""
    item = "to_json(struct(name, user, system, expected_keywords, max_tokens))"
    damaged = f"""CASE pos % 11
      WHEN 1 THEN to_json(struct(name, array(user) AS user))
      WHEN 2 THEN to_json(struct(name))
      WHEN 3 THEN to_json(struct(name, user, array(1, 2) AS expected_keywords))
      WHEN 4 THEN to_json(struct(name, user, 'many' AS max_tokens))
      WHEN 5 THEN to_json(array(name)) ELSE {item} END"""
    path = scratch_path(rows.sparkSession, "documents")
    (
        rows.selectExpr("pos div 500000000 AS doc", "pos", f"{damaged} AS item")
        .groupBy("doc")
        .agg(F.expr("array_sort(collect_list(struct(pos, item))) AS items"))
        .selectExpr(
            "doc",
            "concat('{\"prompts\":[', array_join(transform(items, i -> i.item), ','), ']}') AS body",
        )
        .write.partitionBy("doc")
        .text(path)
    )
    return path


def responses(rows: DataFrame, model: str) -> DataFrame:
    return rows.selectExpr("pos", "name", f"{model} AS response")
