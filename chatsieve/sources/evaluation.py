"""Prompt and response tables, and the result sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatsieve.functions.text import strip_ws
from chatsieve.operators.validate import is_type
from chatsieve.sources.jsonl import strict_json
from chatsieve.storage import replaced

PROMPT_SCHEMA = (
    "pos BIGINT, name STRING, user STRING, system STRING, "
    "expected_keywords ARRAY<STRING>, max_tokens INT"
)
RESPONSE_SCHEMA = "pos BIGINT, name STRING, response STRING"


# Rows without a position are paired by name; equal names then share a position.
POSITION = "coalesce(pos, xxhash64(name)) AS pos"


def _read(spark: SparkSession, path: str, fmt: str, schema: str) -> DataFrame:
    rows = spark.read.schema(f"{schema}, _corrupt_record STRING").format(fmt).load(path)
    others = [c for c in rows.columns if c not in ("pos", "_corrupt_record")]
    # The reader finds faults only in fields that it has to read, so all are used.
    used = f"length(concat_ws('', pos, {', '.join(others)})) < 0"
    return rows.selectExpr(
        POSITION, *others,
        f"_corrupt_record IS NOT NULL OR name IS NULL OR {used} AS damaged",
    )


def read_prompts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Prompts in a fixed schema; absent fields become NULL.

    ``damaged`` marks rows without a name, and lines that are no JSON or have a
    list or number field of another type; a text field takes any value as JSON text.
    """
    return _read(spark, path, fmt, PROMPT_SCHEMA)


def read_responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Model responses in a fixed schema, one row per prompt position; ``damaged``
    as for prompts."""
    return _read(spark, path, fmt, RESPONSE_SCHEMA)


# Type of each field of a prompt item, as a prefix of the VARIANT's type, and the code
# of a value of another type; and the least of what an item must have.
_TYPES = {
    "name": ("STRING", "name_not_text"),
    "user": ("STRING", "user_not_text"),
    "system": ("STRING", "system_not_text"),
    "expected_keywords": ("ARRAY", "keywords_not_list"),
    "max_tokens": ("BIGINT", "max_tokens_not_integer"),
}
REQUIRED = ("name", "user")


def _item_faults() -> str:
    """Codes of one item from the variants of its fields, ``v_name`` and so on."""
    codes = []
    for name in _TYPES:
        kind, code = _TYPES[name]
        wrong = f"NOT {is_type(f'v_{name}', kind)}"
        if name in REQUIRED:
            codes.append(f"WHEN v_{name} IS NULL THEN 'missing_{name}' WHEN {wrong} THEN '{code}'")
        else:
            codes.append(f"WHEN v_{name} IS NOT NULL AND {wrong} THEN '{code}'")
    keywords = f"""transform(coalesce(v_items, CAST(array() AS ARRAY<VARIANT>)), (k, i) ->
      IF({is_type('k', 'STRING')}, NULL, concat('keyword_not_text@', i)))"""
    listed = ", ".join(f"CASE {c} END" for c in codes)
    return f"""IF({is_type('item', 'OBJECT')},
      array_compact(concat(array({listed}), {keywords})), array('not_object'))"""


def read_prompt_document(spark: SparkSession, path: str) -> DataFrame:
    """The items of JSON documents with a ``prompts`` list, one row each.

    ``document, pos`` tell the place, ``errors`` lists the faults of an item; a value of the wrong type
    is NULL. A document that is malformed, has no ``prompts``, or has no list there gives one row with
    ``pos`` NULL; a file without a byte gives none. A document is one row until its items are taken apart, so it
    may not pass the size limit of VARIANT; many documents are read side by side.
    """
    documents = spark.read.text(path, wholetext=True).selectExpr(
        "_metadata.file_path AS document", f"{strip_ws('value')} AS raw"
    )
    opened = (
        documents.selectExpr("document", f"{strict_json('raw')} AS body")
        .selectExpr("document", "body", "try_variant_get(body, '$.prompts', 'variant') AS listed")
        .selectExpr(
            "document",
            f"""CASE WHEN body IS NULL THEN 'malformed' WHEN listed IS NULL THEN 'missing_prompts'
              WHEN NOT {is_type('listed', 'ARRAY')} THEN 'prompts_not_list' END AS fault""",
            "CASE WHEN fault IS NULL THEN try_variant_get(listed, '$', 'array<variant>') END AS items",
        )
    )
    items = opened.selectExpr("document", "fault", "posexplode_outer(items) AS (place, item)").where(
        "fault IS NOT NULL OR place IS NOT NULL"
    )
    values = [f"try_variant_get(item, '$.{name}', 'variant') AS v_{name}" for name in _TYPES]
    texts = [
        f"IF({is_type(f'v_{name}', 'STRING')}, try_variant_get(v_{name}, '$', 'string'), NULL)"
        f" AS {name}"
        for name in ("name", "user", "system")
    ]
    keyword = f"IF({is_type('k', 'STRING')}, try_variant_get(k, '$', 'string'), NULL)"
    return (
        items.selectExpr("*", *values)
        .selectExpr(
            "*",
            f"IF({is_type('v_expected_keywords', 'ARRAY')},"
            " try_variant_get(v_expected_keywords, '$', 'array<variant>'), NULL) AS v_items",
        )
        .selectExpr(
            "document",
            "CAST(place AS BIGINT) AS pos",
            *texts,
            f"transform(v_items, k -> {keyword}) AS expected_keywords",
            f"IF({is_type('v_max_tokens', 'BIGINT')},"
            " try_variant_get(v_max_tokens, '$', 'int'), NULL) AS max_tokens",
            f"IF(fault IS NOT NULL, array(fault), {_item_faults()}) AS errors",
        )
    )


# The fields of a written result.
RESULT_FIELDS = [
    "prompt_name", "user_input", "base_response", "tuned_response",
    "base_score", "tuned_score", "improvement",
]


RESULT_SCHEMA = (
    "prompt_name STRING, user_input STRING, base_response STRING, "
    "tuned_response STRING, base_score DOUBLE, tuned_score DOUBLE, improvement DOUBLE"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Write comparison results as JSON Lines, replacing what is at ``path`` once all is written."""
    replaced(results.sparkSession, path, results.select(*RESULT_FIELDS).write.json)
