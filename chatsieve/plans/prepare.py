"""Raw conversations to curated train and eval sets."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from chatsieve.operators import stats
from chatsieve.operators.curate import (
    MIN_ASSISTANT_LENGTH,
    MIN_QUALITY,
    curate,
    kept,
    with_drop_reason,
    with_quality,
)
from chatsieve.operators.features import (
    FEATURES,
    conversation_features,
    sample_features,
)
from chatsieve.operators.order import number_lines, ranked_partitions
from chatsieve.operators.render import CHATML, ChatTemplate, render_chat
from chatsieve.operators.skew import join_unique, largest_keys, without
from chatsieve.operators.split import split_cut, split_exact
from chatsieve.operators.validate import with_sample_faults
from chatsieve.sources.jsonl import (
    line_counts,
    malformed,
    parse_lines,
    read_jsonl,
    replace_splits,
    scan_lines,
    typed_messages,
    write_jsonl,
)
from chatsieve.storage import discard, qualified, scratch_path, written


@dataclass
class Prepared:
    """What a run kept, and its statistics, all as DataFrames.

    ``decisions`` has one row per kept sample: its id, ``quality``, ``bucket``
    and ``split``. The frames read the run's work tables, which stay until
    ``discard`` is called.
    """

    decisions: DataFrame
    counters: DataFrame
    roles: DataFrame
    histogram: DataFrame
    averages: DataFrame
    work_paths: list[str]
    line_counts: DataFrame | None = None
    first_errors: DataFrame | None = None

    def discard(self) -> None:
        """Delete the work tables, once the statistics have been read."""
        for path in self.work_paths:
            discard(self.decisions.sparkSession, path)


def decide(
    curated: DataFrame, id_col: str, eval_ratio: float, seed: int
) -> DataFrame:
    """Split the kept rows of a written curated table; fails if none is left."""
    rows = kept(curated)
    if rows.isEmpty():
        raise ValueError("no samples passed filtering")
    return split_exact(rows, id_col, "key", eval_ratio, seed).select(
        id_col, "quality", "bucket", "split"
    )


def _prepared(curated: DataFrame, decisions: DataFrame, paths: list[str]) -> Prepared:
    """All statistics from one scan of the curated table."""
    path = scratch_path(curated.sparkSession, "measures")
    measured = written(stats.measures(curated), path)
    return Prepared(
        decisions,
        stats.counters(measured),
        stats.role_distribution(measured),
        stats.quality_histogram(measured),
        stats.averages(measured),
        [*paths, path],
    )


def measured_lines(lines: DataFrame) -> DataFrame:
    """Validate and measure lines, row by row.

    No line is filtered out here: a filter on a parsed column would parse the
    line a second time. ``errors`` is NULL for malformed lines, ``messages`` is
    NULL for these and for faulty samples. The VARIANT goes no further.
    """
    messages = f"CASE WHEN size(errors) = 0 THEN {typed_messages()} END AS messages"
    return sample_features(
        with_sample_faults(lines).selectExpr("*", messages).drop("sample")
    )


SPLITS = ("train", "eval")


def refuse_overlap(spark: SparkSession, source: DataFrame, out: str) -> None:
    """Raise if an input file lies in a folder that the result replaces."""
    folders = [f"{qualified(spark, out).rstrip('/')}/split={s}/" for s in SPLITS]
    for file in source.inputFiles():
        if any(folder in unquote(file) for folder in folders):
            raise ValueError(f"the input {file} lies in a folder that is written")


def drop_absent_splits(spark: SparkSession, decisions: DataFrame, out: str) -> None:
    """Remove what an earlier run left of a split that has no rows now."""
    for s in SPLITS:
        if decisions.where(f"split = '{s}'").isEmpty():
            discard(spark, f"{out.rstrip('/')}/split={s}")


def prepare_jsonl(
    spark: SparkSession,
    path: str,
    out: str,
    min_quality: float = MIN_QUALITY,
    min_assistant_length: float = MIN_ASSISTANT_LENGTH,
    eval_ratio: float = 0.1,
    seed: int = 42,
    shuffled: bool = True,
) -> Prepared:
    """Curate JSON Lines at ``path`` into ``out/split=train`` and ``out/split=eval``.

    The lines are parsed once, into a work table. Deduplication, statistics and
    split read its narrow columns only. The text is read again when kept lines are written: which
    lines pass, and their split, follow from the line's own columns, and only the ids of removed
    copies are sent to the text. With ``shuffled`` it then moves once, into files whose names
    and lines are in the seeded order; otherwise it stays in place, in source order.
    A ratio outside (0, 1) keeps the source order too.
    """
    refuse_overlap(spark, spark.read.text(path), out)
    lines_path = scratch_path(spark, "lines")
    curated_path = scratch_path(spark, "curated")
    work = written(
        measured_lines(parse_lines(scan_lines(spark, path))).selectExpr(
            "path", "block", "line_id", "raw", "octet_length(raw) AS n_bytes", "parsed", *FEATURES
        ),
        lines_path,
    )
    if work.where("parsed").isEmpty():
        discard(spark, lines_path)
        raise ValueError(f"no valid samples found in {path}")
    numbered, parts_path = number_lines(work)
    paths = [lines_path, parts_path, curated_path]
    samples = numbered.where("parsed").select("ord", "n_bytes", *FEATURES)
    curated = written(
        curate(samples, "ord", "ord", min_quality, min_assistant_length), curated_path
    )
    firsts = kept(curated)
    if firsts.isEmpty():
        raise ValueError("no samples passed filtering")
    cut = split_cut(firsts, "ord", eval_ratio=eval_ratio, seed=seed)
    decisions = cut.with_split(firsts, "ord").select("ord", "quality", "bucket", "split")
    rows, n_bytes = _kept_lines(numbered, firsts, min_quality, min_assistant_length)
    rows = cut.with_split(rows, "ord")
    if shuffled and cut.shuffles:
        rows = rows.selectExpr("*", f"{cut.rank('ord')} AS rank")
        rows = ranked_partitions(rows, "rank", n_bytes, ["split"])
    write_jsonl(rows, out, partition_by="split")
    drop_absent_splits(spark, decisions, out)
    result = _prepared(curated, decisions, paths)
    result.line_counts = line_counts(work)
    result.first_errors = (
        malformed(numbered).select("path", "line_no", "reason", "raw", "ord").orderBy("ord").limit(5)
    )
    return result


def _kept_lines(
    numbered: DataFrame, firsts: DataFrame, min_quality: float, min_assistant_length: float
) -> tuple[DataFrame, int]:
    """``ord, key, raw`` of the kept lines, where they are, and about their size in bytes.

    A line is kept if it passes by its own measures and is not a later copy. Copies are found
    by their ids alone: those that pass but are not the first of their content.
    """
    passing = kept(
        with_drop_reason(with_quality(numbered), min_quality, min_assistant_length)
    )
    n_first, n_all = firsts.selectExpr("count(*)", "sum(copies)").first()
    copies = passing.select("ord").join(firsts.select("ord"), "ord", "left_anti")
    n_bytes = passing.agg({"n_bytes": "sum"}).first()[0]
    rows = without(passing.select("ord", "key", "raw"), "ord", copies, n_all - n_first)
    return rows, n_bytes


def prepare_turns(
    turns: DataFrame,
    out: str | None = None,
    min_quality: float = MIN_QUALITY,
    min_assistant_length: float = MIN_ASSISTANT_LENGTH,
    eval_ratio: float = 0.1,
    seed: int = 42,
) -> Prepared:
    """Curate a turn table; ``out`` gets the kept turns, by ``split``, as parquet."""
    features = conversation_features(turns)
    path = scratch_path(turns.sparkSession, "curated")
    curated = written(
        curate(features, "conv_id", "conv_id", min_quality, min_assistant_length), path
    )
    decisions = decide(curated, "conv_id", eval_ratio, seed)
    if out is not None:
        # One conversation may hold much of the table; its turns stay in place.
        hot = largest_keys(kept(curated), "conv_id", "n_messages")
        rows = join_unique(turns, decisions.select("conv_id", "split"), "conv_id", hot)
        refuse_overlap(turns.sparkSession, turns, out)
        replace_splits(rows.write).parquet(out)
        drop_absent_splits(turns.sparkSession, decisions, out)
    return _prepared(curated, decisions, [path])


def training_text(
    spark: SparkSession, path: str, template: str | ChatTemplate = CHATML
) -> DataFrame:
    """Re-read curated JSON Lines and render each sample: ``ord, raw, text``."""
    text = render_chat(typed_messages(), template)
    return read_jsonl(spark, path).selectExpr("ord", "raw", f"{text} AS text")
