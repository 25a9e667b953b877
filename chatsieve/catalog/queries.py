"""The registered queries: ``(spark, sf_dir) -> DataFrame`` by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsieve.catalog import inputs
from chatsieve.catalog.inputs import EVAL_RATIO, MIN_QUALITY, SEED
from chatsieve.operators import evaluate, split, stats
from chatsieve.operators.curate import curate, kept, with_parts, with_quality
from chatsieve.operators.features import (
    FEATURES,
    conversation_features,
    role_totals,
    with_means,
)
from chatsieve.operators.order import number_lines
from chatsieve.operators.render import ALPACA, CHATML, INST, render_chat
from chatsieve.operators.validate import turn_faults, valid_conversations
from chatsieve.plans import prepare
from chatsieve.plans.compare import compare_models
from chatsieve.plans.prepare import measured_lines, prepare_jsonl, prepare_turns
from chatsieve.sources.evaluation import (
    read_prompt_document,
    read_prompts,
    read_responses,
    read_results,
)
from chatsieve.sources.jsonl import (
    line_counts,
    malformed,
    parse_lines,
    read_jsonl,
    scan_lines,
    typed_messages,
    write_jsonl,
)
from chatsieve.sources.turns import assemble, explode_messages
from chatsieve.storage import scratch_path, written
from chatsieve.streaming.prepare import prepare_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


# --- shared starting points -------------------------------------------------


def valid_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_features(inputs.turn_input(spark, sf_dir)).where("valid")


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = conversation_features(inputs.turn_input(spark, sf_dir))
    return curate(features, "conv_id", "conv_id", min_quality=MIN_QUALITY)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.measures(curated(spark, sf_dir))


# Ids of a line as ``to_lines`` writes them, also where its end is cut.
LINE_ID = ["""CAST(regexp_extract(raw, '"id":([0-9]+)', 1) AS BIGINT) AS conv_id"""]


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.evaluation_rows(spark, sf_dir)
    return evaluate.compare(
        evaluate.with_prompt_defaults(inputs.prompts(rows)),
        inputs.responses(rows, "base"),
        inputs.responses(rows, "tuned"),
    )


# --- sources and sinks ------------------------------------------------------


@registered
def conversation_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble(inputs.chat_input(spark, sf_dir)).selectExpr(
        "conv_id",
        "CAST(size(messages) AS BIGINT) AS n_messages",
        "array_join(transform(messages, m -> m.role), ',') AS roles",
    )


@registered
def conversation_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_messages(assemble(inputs.chat_input(spark, sf_dir)))


@registered
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_jsonl(spark, inputs.chat_lines(spark, sf_dir))
    return lines.selectExpr(
        "try_variant_get(sample, '$.id', 'bigint') AS conv_id",
        f"{typed_messages()} AS messages",
    ).selectExpr(
        "conv_id",
        "CAST(size(messages) AS BIGINT) AS n_messages",
        "aggregate(messages, 0L, (n, m) -> n + coalesce(length(m.content), 0)) AS chars",
    )


@registered
def jsonl_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parse_lines(scan_lines(spark, inputs.chat_lines(spark, sf_dir, cut=True)))
    work = written(lines.drop("sample"), scratch_path(spark, "lines"))
    first = malformed(number_lines(work)[0]).orderBy("ord").limit(5)
    return first.selectExpr(*LINE_ID, "ord AS line_no", "reason")


@registered
def jsonl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_counts(read_jsonl(spark, inputs.chat_lines(spark, sf_dir, cut=True)))


@registered
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = read_jsonl(spark, inputs.chat_lines(spark, sf_dir))
    path = scratch_path(spark, "roundtrip")
    write_jsonl(first, path)
    return explode_messages(
        read_jsonl(spark, path).selectExpr(
            *LINE_ID, f"{typed_messages()} AS messages"
        )
    )


@registered
def jsonl_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_jsonl(spark, inputs.chat_lines(spark, sf_dir))
    return measured_lines(lines).selectExpr(
        *LINE_ID, "array_join(errors, ',') AS errors"
    )


@registered
def jsonl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = measured_lines(read_jsonl(spark, inputs.chat_lines(spark, sf_dir)))
    # A filter on an unwritten frame would be evaluated on the parsed text twice.
    lines = written(
        lines.select("raw", *FEATURES), scratch_path(spark, "lines")
    )
    return with_quality(lines.where("valid")).selectExpr(
        *LINE_ID, "quality", "bucket"
    )


# --- curation ---------------------------------------------------------------


@registered
def chat_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_faults(inputs.turn_input(spark, sf_dir))


@registered
def chat_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_conversations(inputs.turn_input(spark, sf_dir))


@registered
def role_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_totals(inputs.turn_input(spark, sf_dir))


@registered
def score_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_means(valid_features(spark, sf_dir)).select(
        "conv_id", "has_system", "turns", "n_messages", "mean_user",
        "mean_assistant", "n_words", "n_distinct",
    )


@registered
def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_parts(valid_features(spark, sf_dir)).select(
        "conv_id", "s1", "s2", "s3", "s4", "s5"
    )


@registered
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_quality(valid_features(spark, sf_dir)).select("conv_id", "quality")


@registered
def quality_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_quality(valid_features(spark, sf_dir)).select("conv_id", "bucket")


@registered
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated(spark, sf_dir).where("valid").select("conv_id", "key", "copies")


@registered
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(curated(spark, sf_dir)).select("conv_id", "quality")


@registered
def drop_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated(spark, sf_dir).where("valid").select("conv_id", "drop_reason")


@registered
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counters(measured(spark, sf_dir))


@registered
def role_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.role_distribution(measured(spark, sf_dir))


@registered
def quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quality_histogram(measured(spark, sf_dir))


@registered
def dataset_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.averages(measured(spark, sf_dir))


@registered
def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(
        kept(curated(spark, sf_dir)).select("conv_id", "key"),
        scratch_path(spark, "kept"),
    )
    return split.split_exact(rows, "conv_id", "key", EVAL_RATIO, SEED).select(
        "conv_id", "split"
    )


@registered
def split_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(curated(spark, sf_dir))
    return split.split_exact(rows, "conv_id", "key", 0.0, SEED).select(
        "conv_id", "split"
    )


@registered
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(curated(spark, sf_dir))
    return split.split_hash(rows, "key", EVAL_RATIO, SEED).select("conv_id", "split")


@registered
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = inputs.conversations(spark, sf_dir)
    return assemble(turns).selectExpr("conv_id", f"{render_chat('messages')} AS text")


@registered
def prepare_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = inputs.turn_input(spark, sf_dir)
    return prepare_turns(
        turns, min_quality=MIN_QUALITY, eval_ratio=EVAL_RATIO, seed=SEED
    ).decisions


def jsonl_splits(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the train and eval lines made of all chat lines."""
    out = scratch_path(spark, "dataset")
    prepare_jsonl(
        spark, inputs.chat_lines(spark, sf_dir), out,
        min_quality=MIN_QUALITY, eval_ratio=EVAL_RATIO, seed=SEED,
    ).discard()
    return out


@registered
def prepare_jsonl_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jsonl_splits(spark, sf_dir)
    train, held = (
        read_jsonl(spark, f"{out}/split={s}").selectExpr(*LINE_ID, f"'{s}' AS split")
        for s in ("train", "eval")
    )
    return train.unionAll(held)


@registered
def training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jsonl_splits(spark, sf_dir)
    parts = []
    for s in ("train", "eval"):
        lines = written(
            scan_lines(spark, f"{out}/split={s}"), scratch_path(spark, "lines")
        )
        parts.append(
            number_lines(lines)[0].selectExpr(*LINE_ID, f"'{s}' AS split", "ord AS place")
        )
    return parts[0].unionAll(parts[1])


@registered
def training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{jsonl_splits(spark, sf_dir)}/split=train"
    texts = [
        prepare.training_text(spark, path, template).selectExpr(
            *LINE_ID, f"'{name}' AS template", "text"
        )
        for name, template in (("chatml", CHATML), ("inst", INST), ("alpaca", ALPACA))
    ]
    return texts[0].unionAll(texts[1]).unionAll(texts[2])


@registered
def stream_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, streamed file by file; which of equal contents stays is left open, so
    contents are told by their key."""
    out = scratch_path(spark, "streamed")
    prepare_stream(
        spark, inputs.chat_lines(spark, sf_dir), out, scratch_path(spark, "state"),
        min_quality=MIN_QUALITY, eval_ratio=EVAL_RATIO, seed=SEED, files_per_batch=1000,
    ).awaitTermination()
    parts = [
        measured_lines(read_jsonl(spark, f"{out}/split={s}")).selectExpr("key", f"'{s}' AS split")
        for s in ("train", "eval")
    ]
    return parts[0].unionAll(parts[1])


# --- evaluation -------------------------------------------------------------


@registered
def prompt_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = inputs.prompts(inputs.evaluation_rows(spark, sf_dir)).withColumn(
        "user", F.expr("IF(pos % 9 <> 0, user, NULL)")
    )
    return evaluate.with_prompt_defaults(prompts).selectExpr(
        "pos", "name", "system", "max_tokens",
        "CAST(size(expected_keywords) AS BIGINT) AS n_keywords", "error",
    )


@registered
def prompt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.prompts(inputs.evaluation_rows(spark, sf_dir))
    return read_prompt_document(spark, inputs.prompt_documents(rows)).selectExpr(
        "CAST(regexp_extract(document, 'doc=([0-9]+)', 1) AS BIGINT) AS doc", "pos", "name", "user",
        "system", "max_tokens", "array_join(expected_keywords, '|', '?') AS keywords",
        "array_join(errors, ',') AS errors",
    )


@registered
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = inputs.prompts(inputs.evaluation_rows(spark, sf_dir))
    return (
        evaluate.prompt_messages(evaluate.with_prompt_defaults(prompts))
        .selectExpr("pos", "name", "posexplode(messages) AS (i, m)")
        .select("pos", "name", "i", "m.role", "m.content")
    )


@registered
def response_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.evaluation_rows(spark, sf_dir)
    return evaluate.with_response_features(rows, "base").select(
        "pos", "name", "length_score", "coverage", "diversity"
    )


@registered
def response_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.evaluation_rows(spark, sf_dir)
    return evaluate.with_response_score(rows, "base").select("pos", "name", "score")


@registered
def base_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.evaluation_rows(spark, sf_dir)
    return evaluate.last_per_name(inputs.responses(rows, "base"))


@registered
def compare_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir)


@registered
def compare_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.evaluation_rows(spark, sf_dir)
    tables = {
        "prompts": inputs.prompts(rows),
        "base": inputs.responses(rows, "base"),
        "tuned": inputs.responses(rows, "tuned"),
    }
    paths = {name: scratch_path(spark, name) for name in tables}
    for name, frame in tables.items():
        frame.write.json(paths[name])
    out = scratch_path(spark, "results")
    compare_models(
        read_prompts(spark, paths["prompts"]),
        read_responses(spark, paths["base"]),
        read_responses(spark, paths["tuned"]),
        out,
    )
    return read_results(spark, out)


@registered
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report(evaluated(spark, sf_dir))


@registered
def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(evaluated(spark, sf_dir))
