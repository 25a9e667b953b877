"""Prompts, response scores and the comparison of two sets of responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from chatsieve.functions import scoring
from chatsieve.functions.text import py_round, split_words, strip_ws
from chatsieve.operators.skew import hot_keys, join_unique
from chatsieve.operators.validate import aggregates

# Defaults of a prompt, and the length of a response preview.
DEFAULT_SYSTEM = ""
DEFAULT_MAX_TOKENS = 256
PREVIEW_CHARS = 500
# Prompts that meet in one copy of the base response they share.
ROWS_PER_COPY = 1_000_000


def with_prompt_defaults(prompts: DataFrame) -> DataFrame:
    """Fill absent optional fields; ``error`` names a missing required one."""
    damaged = "damaged" if "damaged" in prompts.columns else "false"
    return prompts.selectExpr(
        "pos",
        "name",
        "user",
        f"coalesce(system, '{DEFAULT_SYSTEM}') AS system",
        "coalesce(expected_keywords, CAST(array() AS ARRAY<STRING>))"
        " AS expected_keywords",
        f"coalesce(max_tokens, {DEFAULT_MAX_TOKENS}) AS max_tokens",
        f"CASE WHEN name IS NULL THEN 'missing_name' WHEN {damaged} THEN 'malformed' "
        "WHEN user IS NULL THEN 'missing_user' END AS error",
    )


def prompt_messages(prompts: DataFrame) -> DataFrame:
    """Add ``messages``: an optional system message, then the user message."""
    return prompts.selectExpr(
        "*",
        "array_compact(array("
        "IF(system <> '', struct('system' AS role, system AS content), NULL), "
        "struct('user' AS role, user AS content))) AS messages",
    )


def with_text_features(
    rows: DataFrame, response: str = "response", prefix: str = ""
) -> DataFrame:
    """Add what a response shows by itself: ``length_score``, ``diversity``,
    ``blank`` and, for the keyword search, ``lower``."""
    ws, n = f"_{prefix}words", f"_{prefix}chars"
    return (
        rows.selectExpr("*", f"lower({response}) AS {prefix}lower")
        .selectExpr(
            "*",
            f"{split_words(prefix + 'lower')} AS {ws}",
            f"length({strip_ws(response)}) AS {n}",
        )
        .selectExpr(
            "*",
            f"{scoring.length_score(n)} AS {prefix}length_score",
            f"{scoring.response_diversity(ws)} AS {prefix}diversity",
            f"coalesce({n}, 0) = 0 AS {prefix}blank",
        )
        .drop(ws, n)
    )


def with_coverage(
    rows: DataFrame, keywords: str = "expected_keywords", prefix: str = ""
) -> DataFrame:
    """Add ``coverage``; takes the place of ``lower``."""
    coverage = scoring.keyword_coverage(f"{prefix}lower", keywords)
    return rows.selectExpr("*", f"{coverage} AS {prefix}coverage").drop(f"{prefix}lower")


def with_score(rows: DataFrame, prefix: str = "") -> DataFrame:
    """Add ``score``, in place of its parts: their mean, 0 for a blank response."""
    parts = [f"{prefix}{p}" for p in ("length_score", "coverage", "diversity")]
    mean = py_round(f"({' + '.join(parts)}) / 3D", 3)
    return rows.selectExpr(
        "*", f"IF({prefix}blank, 0D, {mean}) AS {prefix}score"
    ).drop(*parts, f"{prefix}blank")


def with_response_features(rows: DataFrame, response: str = "response") -> DataFrame:
    """Add all parts of a response's score; needs ``expected_keywords``."""
    return with_coverage(with_text_features(rows, response))


def with_response_score(rows: DataFrame, response: str = "response") -> DataFrame:
    """Add ``score`` of a response; needs ``expected_keywords``."""
    return with_score(with_response_features(rows, response))


def last_per_name(base: DataFrame) -> DataFrame:
    """One base response per prompt name: the last by position, which is unique.

    The aggregate is narrow and combines map-side, so a name with any share of
    the rows reaches the reducer as one row per map task. Texts move once.
    """
    last = base.groupBy("name").agg(*aggregates({"pos": "max(pos)"}))
    return base.join(last, ["name", "pos"]).select("name", "response", "pos")


def completeness(prompts: DataFrame, base: DataFrame, tuned: DataFrame) -> DataFrame:
    """One row of counts, all 0 if each prompt has its two responses:
    ``repeated`` positions (of any table), prompts ``without_tuned`` or
    ``without_base`` response, ``damaged`` response rows.

    Names and positions only; every step combines map-side.
    """
    sides = {"p": prompts, "t": tuned, "b": base}
    rows = reduce(
        DataFrame.unionAll,
        [
            rows.selectExpr(
                "pos", "name", *(f"CAST('{s}' = '{side}' AS INT) AS {s}" for s in sides),
                f"CAST('{side}' <> 'p' AND {'damaged' if 'damaged' in rows.columns else 'name IS NULL'}"
                " AS INT) AS bad",
            )
            for side, rows in sides.items()
        ],
    )
    # Of a prompt and its tuned response the hashes of equal names cancel out.
    by_pos = rows.groupBy("pos").agg(
        *aggregates({
            "p": "sum(p)", "t": "sum(t)", "b": "sum(b)", "bad": "sum(bad)",
            "names": "coalesce(bit_xor(xxhash64(name)) FILTER (WHERE b = 0), 0L)",
        })
    ).selectExpr(
        "coalesce(sum(CAST(p > 1 OR t > 1 OR b > 1 AS BIGINT)), 0L) AS repeated",
        "coalesce(sum(IF(t = 0 OR (p = 1 AND t = 1 AND names <> 0), p, 0L)), 0L) AS without_tuned",
        "coalesce(sum(bad), 0L) AS damaged",
        "0L AS without_base",
    )
    by_name = rows.groupBy("name").agg(*aggregates({"p": "sum(p)", "b": "sum(b)"})).selectExpr(
        "0L AS repeated", "0L AS without_tuned", "0L AS damaged",
        "coalesce(sum(IF(b = 0, p, 0L)), 0L) AS without_base",
    )
    both = by_pos.unionAll(by_name)
    return both.selectExpr(*(f"sum({c}) AS {c}" for c in both.columns))


def compare(prompts: DataFrame, base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Pair, score and compare the responses of two models to each prompt.

    Each tuned row keeps its own prompt (same position); all prompts of one name
    share that name's last base response. Positions are unique in each table, and
    only prompts with both responses have a result (see ``completeness``).

    Which base response a prompt gets is found on names and positions alone. A
    response that more than ``ROWS_PER_COPY`` prompts share is copied, so that no
    task holds all of them, and measured before it is.
    """
    ids = prompts.select("pos", "name")
    last = (
        base.groupBy("name").agg(*aggregates({"base_pos": "max(pos)"}))
        .join(ids.groupBy("name").agg(*aggregates({"n": "count(*)"})), "name")
        .selectExpr("name", "base_pos", f"1 + n DIV {ROWS_PER_COPY} AS copies")
    )
    choice = join_unique(ids, last, "name", hot_keys(ids, "name")).selectExpr(
        "pos", "name", "base_pos", "pmod(xxhash64(pos), copies) AS copy"
    )
    texts = (
        with_text_features(
            base.selectExpr("pos AS base_pos", "name", "response AS base_response"),
            "base_response",
            "base_",
        )
        .drop("base_lower")
        .join(last, ["name", "base_pos"])
        .selectExpr("* EXCEPT (name, copies)", "explode(sequence(0L, copies - 1)) AS copy")
    )
    answers = tuned.selectExpr("pos", "name", "response AS tuned_response")
    paired = (
        prompts.select("pos", "name", "user", "expected_keywords")
        .join(answers, ["pos", "name"])
        .join(choice, ["pos", "name"])
    )
    joined = paired.join(texts, ["base_pos", "copy"]).selectExpr(
        "*", "lower(base_response) AS base_lower"
    )
    scored = with_score(with_coverage(joined, prefix="base_"), "base_")
    scored = with_text_features(scored, "tuned_response", "tuned_")
    scored = with_score(with_coverage(scored, prefix="tuned_"), "tuned_")
    return scored.selectExpr(
        "pos",
        "name AS prompt_name",
        "user AS user_input",
        "base_response",
        "tuned_response",
        "base_score",
        "tuned_score",
        "round(tuned_score - base_score, 3) AS improvement",
    )


def report(results: DataFrame) -> DataFrame:
    """Direction of the improvement and a preview of both responses."""
    return results.selectExpr(
        "pos",
        "prompt_name",
        "CASE WHEN improvement > 0 THEN 'up' WHEN improvement < 0 THEN 'down' "
        "ELSE 'same' END AS label",
        f"substring(base_response, 1, {PREVIEW_CHARS}) AS base_preview",
        f"substring(tuned_response, 1, {PREVIEW_CHARS}) AS tuned_preview",
    )


def summary(results: DataFrame) -> DataFrame:
    """One row: number of results, mean improvement and counts by direction.

    An improvement has three digits, so it is summed in whole thousandths: the
    mean is the same whatever the order of the rows.
    """
    return results.selectExpr(
        "count(*) AS n",
        "coalesce(sum(CAST(round(improvement * 1000) AS BIGINT)), 0L) AS milli",
        "count_if(improvement > 0) AS up",
        "count_if(improvement = 0) AS same",
        "count_if(improvement < 0) AS down",
    ).selectExpr(
        "n",
        "CAST(milli AS DOUBLE) / (1000D * CAST(greatest(n, 1L) AS DOUBLE))"
        " AS mean_improvement",
        "up",
        "same",
        "down",
    )
