"""Prompts and two sets of responses to a scored comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chatsieve.operators.evaluate import (
    compare,
    completeness,
    summary,
    with_prompt_defaults,
)
from chatsieve.sources.evaluation import POSITION, write_results
from chatsieve.storage import scratch_path, written


def positioned(rows: DataFrame) -> DataFrame:
    """``rows`` with a position; those without one are told apart by name."""
    if "pos" not in rows.columns:
        rows = rows.selectExpr("CAST(NULL AS BIGINT) AS pos", "*")
    return rows.selectExpr(POSITION, "* EXCEPT (pos)")


def compare_models(
    prompts: DataFrame, base: DataFrame, tuned: DataFrame, out: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Results, one per prompt, and their summary, both from a written table.

    Raises if a prompt or a response line is faulty, a position repeats, or a prompt
    lacks one of its responses.
    """
    prompts, base, tuned = map(positioned, (prompts, base, tuned))
    checked = with_prompt_defaults(prompts)
    bad = checked.where("error IS NOT NULL").select("pos", "error").first()
    if bad is not None:
        raise ValueError(f"prompt {bad.pos}: {bad.error}")
    faults = {k: n for k, n in completeness(checked, base, tuned).first().asDict().items() if n}
    if faults:
        raise ValueError(f"incomplete comparison: {faults}")
    results = written(
        compare(checked, base, tuned), scratch_path(prompts.sparkSession, "comparison")
    )
    if out is not None:
        write_results(results, out)
    return results, summary(results)
