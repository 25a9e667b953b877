"""Line numbers, reasons, rows that stay in place, files in the seeded order."""

from __future__ import annotations

import glob
import hashlib
import json
import random
import re

import pytest

from chatsieve.operators.order import number_lines, prefix_sums, ranked_partitions
from chatsieve.operators.skew import without
from chatsieve.plans import prepare
from chatsieve.sources.jsonl import malformed, parse_lines, read_jsonl, scan_lines
from chatsieve.storage import scratch_path, written
from tests.conftest import sample


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(6)
    folder = tmp_path / "many"
    folder.mkdir()
    expected = []
    for f in ("b", "a", "c"):
        lines = [rng.choice(["", "  ", f'"{f} {i} {"x" * (i % 60)}"', f"{{bad {f}{i}"]) for i in range(900)]
        (folder / f"{f}.jsonl").write_text("\n".join(lines) + "\n")
        expected += [(f, i, line.strip()) for i, line in enumerate(lines, 1)]
    expected.sort()
    lines = scan_lines(spark, str(folder))
    assert lines.rdd.getNumPartitions() > 8
    work = written(parse_lines(lines).drop("sample"), scratch_path(spark, "lines"))
    numbered = number_lines(work)[0].orderBy("ord").collect()
    assert [(r.path[-7], r.line_no, r.raw) for r in numbered] == expected
    assert [r.ord for r in numbered] == list(range(1, len(expected) + 1))
    bad = malformed(number_lines(work)[0]).collect()
    assert {(r.path[-7], r.line_no) for r in bad} == {(f, i) for f, i, line in expected if line[:1] == "{"}


def test_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 9)) for k in range(5000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k BIGINT, n BIGINT").repartition(7)
    got = {r.k: r.before for r in prefix_sums(frame, ["k"], "n")[0].collect()}
    total = 0
    for k, n in sorted(rows):
        assert got[k] == total
        total += n
    assert prefix_sums(frame.where("false"), ["k"], "n")[0].count() == 0


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ('{"a":1} junk', "trailing_text"), ('{"a":1}{"b":2}', "trailing_text"), ('"a" "b"', "trailing_text"),
        ('{"a":1}] x', "trailing_text"), ('{"a":[1', "unclosed"), ('"open', "unclosed"),
        ('"escape\\', "unclosed"), ('{"a":"b\\"}', "unclosed"), ('{"a":"[{"', "unclosed"),
        ("{'messages':1}", "bad_value"), ('{"a":1,}', "bad_value"), ("// c", "bad_value"),
        ("]", "bad_value"), ("tru", "bad_value"),
    ],
)
def test_reasons(spark, line, reason):
    frame = spark.createDataFrame([(line,)], "raw STRING")
    assert [r.reason for r in malformed(parse_lines(frame)).collect()] == [reason]


def exchanged(frame):
    """Column lists of what the plan shuffles."""
    text = frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text), text


@pytest.mark.parametrize("limits", [(10**6, 10**9), (0, 10**9), (0, 0)])
def test_removed_rows(spark, monkeypatch, limits):
    monkeypatch.setattr("chatsieve.operators.skew.MAX_BROADCAST_IDS", limits[0])
    monkeypatch.setattr("chatsieve.operators.skew.MAX_BITMAP_BYTES", limits[1])
    rows = spark.range(1, 100_001).selectExpr("id AS ord", "concat('text ', id) AS raw")
    removed = rows.where("ord % 7 = 3 OR ord BETWEEN 32760 AND 32780 OR ord = 65536").select("ord")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = without(rows, "ord", removed, removed.count())
        assert sorted(r.ord for r in left.collect()) == [
            i for i in range(1, 100_001) if not (i % 7 == 3 or 32760 <= i <= 32780 or i == 65536)
        ]
        moves = any("raw" in columns for columns in exchanged(left)[0])
        assert moves == (limits == (0, 0)) and left.columns == rows.columns
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def chats(n, copies):
    lines = [json.dumps({"n": i, **sample(user=f"Question number {i}?")}) for i in range(n)]
    return lines + lines[:copies]


def test_text_stays_in_place(spark, write_lines, tmp_path, monkeypatch):
    seen = []
    write = prepare.write_jsonl
    monkeypatch.setattr(prepare, "write_jsonl", lambda rows, *a, **k: (seen.append(rows), write(rows, *a, **k)))
    path = write_lines(chats(300, 40))
    for shuffled in (False, True):
        out = str(tmp_path / f"out{shuffled}")
        prepare.prepare_jsonl(spark, path, out, shuffled=shuffled)
        moves, text = exchanged(seen[-1])
        assert sum("raw" in columns for columns in moves) == shuffled
        assert "SortAggregate" not in text
        got = [r.raw for s in ("train", "eval") for r in read_jsonl(spark, f"{out}/split={s}").collect()]
        assert sorted(got) == sorted(chats(300, 0))
    # In source order, each part is a subsequence of the source.
    for s in ("train", "eval"):
        part = read_jsonl(spark, str(tmp_path / f"outFalse/split={s}")).orderBy("ord").collect()
        numbers = [json.loads(r.raw)["n"] for r in part]
        assert numbers == sorted(numbers)


def test_files_are_in_the_seeded_order(spark, write_lines, tmp_path, monkeypatch):
    monkeypatch.setattr("chatsieve.operators.order.FILE_BYTES", 4000)
    path, out = write_lines(chats(400, 50)), str(tmp_path / "out")
    done = prepare.prepare_jsonl(spark, path, out, eval_ratio=0.3, seed=5)
    keys = {r.ord: r.key for r in spark.read.parquet(next(p for p in done.work_paths if "curated" in p)).collect()}
    ranks = {
        json.loads(line)["n"]: hashlib.sha256(f"{keys[i]}|5".encode()).hexdigest()
        for i, line in enumerate(chats(400, 0), 1)
    }
    read = []
    for s in ("train", "eval"):
        files = sorted(glob.glob(f"{out}/split={s}/*.txt"))
        assert len(files) > 4
        read.append([json.loads(line)["n"] for f in files for line in open(f)])
    order = sorted(ranks, key=ranks.get)
    assert read == [order[:280], order[280:]]


def test_even_files(spark):
    rows = spark.range(20_000).selectExpr("sha2(CAST(id AS STRING), 256) AS rank", "'a' AS lead")
    sizes = [
        len(p) for p in ranked_partitions(rows, "rank", 10 * 128 * 2**20, ["lead"]).rdd.glom().collect()
    ]
    assert len(sizes) == 10 and min(sizes) > 1700
