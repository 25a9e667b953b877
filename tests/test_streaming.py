"""The streamed curation, in several batches and runs, against the batch one."""

from __future__ import annotations

import json
import os

import pytest

from chatsieve.operators.split import split_hash
from chatsieve.operators.curate import with_quality
from chatsieve.plans.prepare import measured_lines, prepare_jsonl
from chatsieve.sources.jsonl import parse_lines, read_jsonl
from chatsieve.streaming.prepare import curated_stream, prepare_stream, quarantine_stream
from tests.conftest import sample


def contents(spark, out):
    rows = set()
    for s in ("train", "eval"):
        lines = measured_lines(read_jsonl(spark, f"{out}/split={s}")).collect()
        rows |= {(r.key, s) for r in lines}
        assert len({r.key for r in lines}) == len(lines)
    return rows


@pytest.fixture
def files(tmp_path):
    """Three files with copies within and across them, bad lines and dropped samples."""
    folder = tmp_path / "in"
    folder.mkdir()

    def add(name):
        start = {"a": 0, "b": 40, "c": 70}[name]
        lines = [json.dumps({"n": i, **sample(user=f"Question number {i % 90}?")}) for i in range(start, start + 60)]
        lines += [lines[3], "{broken", "", json.dumps(sample(said="no")), json.dumps({"messages": []})]
        part = tmp_path / f".{name}"
        part.write_text("\n".join(lines) + "\n")
        os.rename(part, folder / f"{name}.jsonl")

    return folder, add


def test_batches_and_a_restart_equal_the_batch_run(spark, files, tmp_path):
    folder, add = files
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    batches = []
    for names in ("a", "bc", ""):
        for name in names:
            add(name)
        run = prepare_stream(spark, str(folder), out, state, files_per_batch=1)
        run.awaitTermination()
        batches.append(sum(p["numInputRows"] > 0 for p in run.recentProgress))
    assert batches == [1, 2, 0]
    whole = str(tmp_path / "whole")
    prepare_jsonl(spark, str(folder), whole)
    kept = {key for key, _ in contents(spark, whole)}
    assert len(kept) == 90
    keys = spark.createDataFrame([(k,) for k in kept], "key STRING")
    assert contents(spark, out) == {(r.key, r.split) for r in split_hash(keys).collect()}


def test_a_run_that_broke_off_goes_on(spark, files, tmp_path):
    """The state of a batch whose end was not recorded is worked out again."""
    folder, add = files
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    add("a")
    prepare_stream(spark, str(folder), out, state).awaitTermination()
    before = contents(spark, out)
    os.remove(f"{state}/commits/0")
    if os.path.exists(f"{state}/commits/.0.crc"):
        os.remove(f"{state}/commits/.0.crc")
    add("b")
    prepare_stream(spark, str(folder), out, state).awaitTermination()
    after = contents(spark, out)
    assert before < after and len(after) == 90


def test_quarantine_stream(spark, files, tmp_path):
    folder, add = files
    add("a"), add("b")
    out = str(tmp_path / "bad")
    quarantine_stream(spark, str(folder), out, str(tmp_path / "state")).awaitTermination()
    rows = spark.read.schema("raw STRING, reason STRING").json(out).collect()
    assert [tuple(r) for r in rows] == [("{broken", "unclosed")] * 2


def test_scores_on_a_stream_are_those_of_a_batch(spark, files):
    folder, add = files
    add("a")
    rows = with_quality(measured_lines(read_jsonl(spark, str(folder)))).where("valid").collect()
    assert len(rows) == 62 and all(r.quality > 0 for r in rows)


def test_a_line_is_parsed_once(spark):
    """No filter carries the parser, or the words of a line, to a second place."""
    lines = parse_lines(spark.createDataFrame([(json.dumps(sample()),)], "raw STRING"))
    plan = curated_stream(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
