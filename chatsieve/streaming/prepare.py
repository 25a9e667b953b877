"""The curation of JSON Lines as a stream: new files are taken up as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chatsieve.functions.text import strip_ws
from chatsieve.operators.curate import (
    MIN_ASSISTANT_LENGTH,
    MIN_QUALITY,
    kept,
    with_drop_reason,
    with_quality,
)
from chatsieve.operators.features import FEATURES
from chatsieve.operators.split import split_hash
from chatsieve.plans.prepare import measured_lines
from chatsieve.sources.jsonl import malformed, parse_lines


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parsed lines of the files in a folder, as a stream; blank lines are left out."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(path).selectExpr(f"{strip_ws('value')} AS raw")
    return parse_lines(lines.where("raw <> ''"))


def settled(rows: DataFrame, columns: list[str], computed: list[str]) -> DataFrame:
    """``columns`` and ``computed`` of ``rows``, the latter worked out once for each row.

    A filter on computed columns is otherwise moved below them, with what they are computed from
    in place of their names: lines were parsed and measured again at each use. It does not pass a
    generator, here one of a single row. (A batch run writes the measures instead.)
    """
    return rows.selectExpr(*columns, f"inline(array(struct({', '.join(computed)})))")


def curated_stream(
    lines: DataFrame,
    min_quality: float = MIN_QUALITY,
    min_assistant_length: float = MIN_ASSISTANT_LENGTH,
    eval_ratio: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """``raw, key, quality, bucket, split`` of the lines that a batch run would keep.

    Everything but deduplication is row-local, and the thresholds come first, since copies have
    the same measures. The state is the keys of all kept contents: of the copies of a
    content, the first to arrive is kept, and any one of those that arrive in one batch.
    The split is by threshold, so that a line keeps its side as more lines come.
    """
    scored = with_quality(settled(measured_lines(lines), ["raw"], FEATURES))
    decided = settled(
        with_drop_reason(scored, min_quality, min_assistant_length),
        ["raw", "key", "valid"], ["quality", "bucket", "drop_reason"],
    )
    first = kept(decided).select("raw", "key", "quality", "bucket").dropDuplicates(["key"])
    return split_hash(first, "key", eval_ratio, seed)


def prepare_stream(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    min_quality: float = MIN_QUALITY,
    min_assistant_length: float = MIN_ASSISTANT_LENGTH,
    eval_ratio: float = 0.1,
    seed: int = 42,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Curate all files of a folder that no earlier run has seen, and end.

    ``out/split=train`` and ``out/split=eval`` get new files with each batch. ``checkpoint`` holds the
    files seen and the keys kept; with it a run goes on where the last one ended or broke off, and
    nothing is written twice. For large states set the RocksDB state store on the session.
    """
    lines = stream_lines(spark, path, files_per_batch)
    rows = curated_stream(lines, min_quality, min_assistant_length, eval_ratio, seed)
    return (
        rows.select("raw", "split")
        .writeStream.format("text")
        .partitionBy("split")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )


def quarantine_stream(
    spark: SparkSession, path: str, out: str, checkpoint: str, files_per_batch: int | None = None
) -> StreamingQuery:
    """Write the malformed lines of new files, with the ``reason``, as JSON; and end."""
    return (
        malformed(stream_lines(spark, path, files_per_batch))
        .writeStream.format("json")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
