from __future__ import annotations

import json
import os

import pytest

from chatsieve.catalog.inputs import chat_input
from chatsieve.operators.render import CHATML
from chatsieve.plans.prepare import prepare_jsonl, prepare_turns, training_text
from chatsieve.sources.jsonl import read_jsonl, to_lines
from chatsieve.sources.turns import assemble
from tests.conftest import SF_SMALL, sample, turn_rows


def raws(spark, path):
    return sorted(r.raw for r in read_jsonl(spark, path).collect())


def test_prepare_jsonl(spark, write_lines, tmp_path):
    good = [
        json.dumps({"n": i, **sample(user=f"Question number {i}?", system="Be kind.")})
        for i in range(20)
    ]
    copy = json.dumps({"n": 99, "extra": True, **sample(user="Question number 3?", system="Be kind.")})
    bad = [json.dumps({"messages": []}), "{broken", '"text"', json.dumps(sample(user="u", said="no"))]
    path = write_lines([*good, copy, *bad])
    out = str(tmp_path / "out")
    result = prepare_jsonl(spark, path, out, eval_ratio=0.2)
    train, held = (raws(spark, f"{out}/split={s}") for s in ("train", "eval"))
    # The first of the copies is written, as it stands in the source.
    assert sorted(train + held) == sorted(good)
    assert (len(train), len(held)) == (16, 4)
    assert tuple(result.counters.first()) == (24, 2, 1, 1, 20)
    assert tuple(result.line_counts.first()) == (25, 24, 1)
    assert [(r.line_no, r.reason, r.raw) for r in result.first_errors.collect()] == [
        (23, "unclosed", "{broken")
    ]
    assert {r.role: r.n for r in result.roles.collect()} == {
        "system": 20, "user": 20, "assistant": 20,
    }
    assert result.averages.first().avg_turns == 3.0
    assert all(os.path.exists(path) for path in result.work_paths)
    result.discard()
    assert not any(os.path.exists(path) for path in result.work_paths)
    # A second run without an eval part leaves no old one behind.
    prepare_jsonl(spark, path, out, eval_ratio=0.0)
    assert not os.path.exists(f"{out}/split=eval")
    assert raws(spark, f"{out}/split=train") == sorted(good)


def test_nothing_left_writes_nothing(spark, write_lines, tmp_path):
    out = tmp_path / "out"
    with pytest.raises(ValueError, match="no samples passed"):
        prepare_jsonl(spark, write_lines([sample(said="no")]), str(out))
    assert not out.exists()


def test_both_routes_decide_alike(spark, tmp_path):
    turns = chat_input(spark, SF_SMALL)
    source = str(tmp_path / "lines")
    to_lines(assemble(turns)).sort("conv_id").select("raw").coalesce(1).write.text(source)
    out, table = str(tmp_path / "out"), str(tmp_path / "table")
    nested = prepare_jsonl(spark, source, out, min_quality=0.4)
    flat = prepare_turns(turns, table, min_quality=0.4)
    assert nested.counters.collect() == flat.counters.collect()
    assert nested.averages.collect() == flat.averages.collect()
    assert nested.histogram.collect() == flat.histogram.collect()
    assert nested.roles.collect() == flat.roles.collect()
    decided = {r.conv_id: r.split for r in flat.decisions.collect()}
    for split in ("train", "eval"):
        lines = read_jsonl(spark, f"{out}/split={split}")
        ids = lines.selectExpr("try_variant_get(sample, '$.id', 'bigint') AS id")
        assert {r.id for r in ids.collect()} == {i for i, s in decided.items() if s == split}
    written = spark.read.parquet(table)
    assert {r.conv_id: r.split for r in written.collect()} == decided
    assert written.count() == turns.join(flat.decisions, "conv_id").count()


def test_hot_conversation_and_hot_copies(spark, tmp_path, monkeypatch):
    """A third of all turns in one conversation, a third of the rest in copies."""
    hot = [("user" if i % 2 == 0 else "assistant", f"turn {i} of the long talk") for i in range(600)]
    copy = [("user", "What is it?"), ("assistant", "It is the same answer again.")]
    own = {
        i: [("user", f"Question {i}?"), ("assistant", f"Answer number {i} it is.")]
        for i in range(100, 500)
    }
    copies = {i: copy for i in range(1000, 1200)}
    turns = turn_rows(spark, {1: hot, **own, **copies})
    plain = prepare_turns(turns, str(tmp_path / "plain"))
    monkeypatch.setattr("chatsieve.operators.skew.MIN_HOT_ROWS", 100)
    done = prepare_turns(turns, str(tmp_path / "hot"))
    assert tuple(done.counters.first()) == (601, 0, 199, 0, 402)
    assert sorted(map(tuple, done.decisions.collect())) == sorted(
        map(tuple, plain.decisions.collect())
    )
    tables = [spark.read.parquet(str(tmp_path / n)) for n in ("plain", "hot")]
    columns = ["conv_id", "turn", "role", "content", "split"]
    rows = [sorted(map(tuple, t.select(*columns).collect())) for t in tables]
    assert rows[0] == rows[1] and len(rows[0]) == 600 + 800 + 2
    assert {r[0] for r in rows[0]} == {1, *own, 1000}


def test_result_does_not_depend_on_file_splits(spark, write_lines, tmp_path):
    lines = [
        json.dumps({"n": i, **sample(user=f"Question number {i % 40}?")}) for i in range(200)
    ]
    path = write_lines(lines)
    outcomes = []
    for size in ("128MB", "1500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "1500" else "4MB")
        try:
            out = str(tmp_path / f"out{size}")
            done = prepare_jsonl(spark, path, out)
            outcomes.append(
                [raws(spark, f"{out}/split={s}") for s in ("train", "eval")]
                + done.counters.collect()
            )
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert outcomes[0] == outcomes[1]
    assert sorted(outcomes[0][0] + outcomes[0][1]) == sorted(lines[:40])


def test_training_text(spark, write_lines):
    path = write_lines([sample(user="Hi\nthere", said="It's {fine} \\ ok", system="S")])
    assert training_text(spark, path).first().text == (
        "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nHi\nthere<|im_end|>\n"
        "<|im_start|>assistant\nIt's {fine} \\ ok<|im_end|>\n"
    )
    plain = training_text(spark, path, "[{role}] {content} '").first().text
    assert plain == "[system] S '[user] Hi\nthere '[assistant] It's {fine} \\ ok '"
    assert CHATML.startswith("<|im_start|>")


def test_row_local_steps_run_on_a_stream(spark, write_lines, tmp_path):
    from chatsieve.functions.text import strip_ws
    from chatsieve.operators.curate import with_quality
    from chatsieve.operators.split import split_hash
    from chatsieve.plans.prepare import measured_lines
    from chatsieve.sources.jsonl import strict_json

    write_lines([sample(), "{bad", sample(user="Another one?")], "a.jsonl")
    lines = (
        spark.readStream.text(str(tmp_path))
        .selectExpr(f"{strip_ws('value')} AS raw")
        .selectExpr("raw", f"{strict_json('raw')} AS sample")
        .selectExpr("*", "sample IS NOT NULL AS parsed")
    )
    scored = split_hash(with_quality(measured_lines(lines)))
    query = (
        scored.select("raw", "valid", "quality", "split")
        .writeStream.format("memory")
        .queryName("scored_stream")
        .option("checkpointLocation", str(tmp_path / "_state"))
        .start()
    )
    try:
        query.processAllAvailable()
        rows = spark.table("scored_stream").collect()
    finally:
        query.stop()
    assert sorted(r.valid for r in rows) == [False, True, True]
    assert all(r.quality > 0 for r in rows if r.valid)


def test_output_replaces_its_own_folders_only(spark, write_lines, tmp_path):
    samples = [sample(user=f"Question number {i}?") for i in range(10)]
    path = write_lines(samples)
    out = tmp_path
    (out / "notes.txt").write_text("mine")
    prepare_jsonl(spark, path, str(out), eval_ratio=0.2)
    prepare_jsonl(spark, path, str(out), eval_ratio=0.2)
    assert (out / "notes.txt").read_text() == "mine" and os.path.exists(path)
    assert len(raws(spark, f"{out}/split=train")) == 8
    with pytest.raises(ValueError, match="is written"):
        prepare_jsonl(spark, f"{out}/split=train", str(out))
    assert len(raws(spark, f"{out}/split=train")) == 8


def test_a_long_conversation_is_one_sample_on_both_routes(spark, tmp_path):
    said = [("user" if i % 2 == 0 else "assistant", f"turn number {i} of many") for i in range(1003)]
    turns = turn_rows(spark, {1: said, 2: said[:2]})
    source = str(tmp_path / "lines")
    to_lines(assemble(turns)).select("raw").write.text(source)
    nested = prepare_jsonl(spark, source, str(tmp_path / "out"), min_quality=0.0, min_assistant_length=0)
    flat = prepare_turns(turns, min_quality=0.0, min_assistant_length=0)
    assert tuple(nested.counters.first()) == tuple(flat.counters.first()) == (2, 0, 0, 0, 2)


def test_statistics_take_one_scan(spark, write_lines, tmp_path, monkeypatch):
    from chatsieve.operators import stats

    seen = []
    measures = stats.measures
    monkeypatch.setattr(stats, "measures", lambda c: (seen.append(measures(c)), seen[-1])[1])
    done = prepare_jsonl(spark, write_lines([sample(user=f"Question {i}?") for i in range(9)]), str(tmp_path / "o"))
    plan = seen[0]._jdf.queryExecution().toString()
    assert plan.count("FileScan") == 1 and len(seen) == 1
    frames = (done.counters, done.roles, done.histogram, done.averages)
    scans = [f.inputFiles() for f in frames]
    assert all("measures" in path for paths in scans for path in paths)


TEMPLATES = [
    ([("system", "S"), ("user", "a"), ("assistant", "b"), ("user", "c")],
     "<s>[INST] <<SYS>>\nS\n<</SYS>>\n\na [/INST] b </s><s>[INST] c [/INST]",
     "S\n\n### Instruction:\na\n\n### Response:\nb\n\n### Instruction:\nc</s>"),
    ([("user", "{system}"), ("system", "late"), ("assistant", "it's {role}\\n")],
     "<s>[INST] {system} [/INST] it's {role}\\n </s>",
     "### Instruction:\n{system}\n\n### Note:\nlate\n\n### Response:\nit's {role}\\n</s>"),
    ([], "", ""),
    ([("system", "only")], "", ""),
]


def test_templates(spark):
    from chatsieve.operators.render import ALPACA, INST, ChatTemplate, Piece, render_chat
    from tests.conftest import sample_rows

    rows = sample_rows(spark, {i: t[0] for i, t in enumerate(TEMPLATES)} | {9: None})
    got = rows.selectExpr("conv_id", f"{render_chat('messages', INST)} AS i", f"{render_chat('messages', ALPACA)} AS a")
    assert {r.conv_id: (r.i, r.a) for r in got.collect()} == {
        **{i: t[1:] for i, t in enumerate(TEMPLATES)}, 9: (None, None)
    }
    other = ChatTemplate((Piece("<{role}>", at="not first"), Piece("{content}")), "BOS", "EOS")
    texts = rows.where("conv_id = 0").selectExpr(f"{render_chat('messages', other)} AS t").first().t
    assert texts == "BOSS<user>a<assistant>b<user>cEOS"
    with pytest.raises(ValueError):
        render_chat("messages", ChatTemplate((Piece("{system}"),)))


def test_a_failed_write_leaves_the_old_result(spark, write_lines, tmp_path):
    from chatsieve.sources.evaluation import write_results
    from chatsieve.sources.jsonl import write_jsonl

    out = str(tmp_path / "out")
    first = read_jsonl(spark, write_lines([sample()]))
    write_jsonl(first, out)
    failing = spark.range(100).selectExpr("IF(id = 99, raise_error('stop'), CAST(id AS STRING)) AS raw")
    with pytest.raises(Exception, match="stop"):
        write_jsonl(failing, out)
    assert [r.raw for r in read_jsonl(spark, out).collect()] == [first.first().raw]
    columns = "prompt_name STRING, user_input STRING, base_response STRING, tuned_response STRING"
    results = spark.createDataFrame([("p", "u", "b", "t")], columns).selectExpr(
        "*", "0.5D AS base_score", "0.7D AS tuned_score", "0.2D AS improvement"
    )
    table = str(tmp_path / "results")
    for frame in (results, results.withColumn("base_score", results.base_score * 0)):
        write_results(frame, table)
    with pytest.raises(Exception, match="stop"):
        write_results(results.selectExpr("* EXCEPT (base_score)", "CAST(raise_error('stop') AS DOUBLE) AS base_score"), table)
    assert [r.base_score for r in spark.read.json(table).collect()] == [0.0]
    assert sorted(p for p in os.listdir(tmp_path) if p.startswith("._")) == []
