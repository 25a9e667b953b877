from __future__ import annotations

import json
import random

import pytest
from pyspark.errors import AnalysisException

from chatsieve.plans.prepare import measured_lines, prepare_jsonl
from chatsieve.sources.jsonl import line_counts, malformed, read_jsonl, write_jsonl
from tests.conftest import sample

# line, whether it parses, its faults
PROBES = [
    (
        '{"messages":[{"role":"user","content":"a"},'
        '{"role":"assistant","content":"b","name":"z"}]}',
        [],
    ),
    ('"just a string"', ["not_object"]),
    ("5", ["not_object"]),
    ("null", ["not_object"]),
    ("[1,2]", ["not_object"]),
    ('{"text":"x"}', ["missing_messages"]),
    ('{"messages":"no"}', ["messages_not_list"]),
    ('{"messages":null}', ["messages_not_list"]),
    ('{"messages":{"a":1}}', ["messages_not_list"]),
    ('{"messages":5}', ["messages_not_list"]),
    ('{"messages":true}', ["messages_not_list"]),
    ('{"messages":[]}', ["too_few_messages", "no_user", "no_assistant"]),
    (
        '{"messages":[1,{"role":"user"},{"role":null,"content":"x"},'
        '{"role":"bot","content":5},{"content":null},'
        '{"role":["x"],"content":{"a":1}}]}',
        [
            "message_not_object@0",
            "missing_content@1",
            "invalid_role@2",
            "invalid_role@3",
            "content_not_string@3",
            "missing_role@4",
            "content_not_string@4",
            "invalid_role@5",
            "content_not_string@5",
            "no_assistant",
        ],
    ),
    ('{"messages":[{},[]]}', [
        "missing_role@0", "missing_content@0", "message_not_object@1",
        "no_user", "no_assistant",
    ]),
    ('{"messages":[{"role":"user","content":""}]}', ["too_few_messages", "no_assistant"]),
    ('{"a":1,"a":2}', ["missing_messages"]),
    ('  {"text":"spaces around"}\t', ["missing_messages"]),
    ("{'messages':1}", None),
    ("{bad", None),
    ('{"a":1,}', None),
    ('{"a":01}', None),
    ("// c", None),
    ('{"a":1} junk', None),
    ('{"a":1}{"b":2}', None),
    ('{"a":1}] junk', None),
    ('{"a":1}} junk', None),
    ("1,2", None),
    ('1,"k":2', None),
    ("1,", None),
    ("[1],[2", None),
    ('{"a":[1', None),
    ('"open', None),
    ('"escape\\', None),
]


def test_strict_parse_and_faults(spark, write_lines):
    lines = read_jsonl(spark, write_lines([p[0] for p in PROBES]))
    rows = measured_lines(lines).orderBy("ord").collect()
    assert [(r.raw, r.errors) for r in rows] == [(p[0].strip(), p[1]) for p in PROBES]
    assert [r.parsed for r in rows] == [p[1] is not None for p in PROBES]
    assert [r.valid for r in rows] == [p[1] == [] for p in PROBES]


def parses(line: str) -> bool:
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


MORE_LINES = [
    '"raw\ttab"', '"\\u00e9 \\n"', '"\\x"', '"\\u12"', "-0", "1.", ".5", "+1", "1e5", "1E+2",
    "-", "- 1", "[1,]", "[,1]", "[]", "{}", '{"a"}', '{"a":}', "tru", "true", "True", "nul",
    "[1,\u00a02]", "[1 2]", "[1, 2 ]", '{"a" : 1 }', "{a:1}", '{"a":1;}', "[1]]", "{}{}",
    '"a" "b"', "1 2", "'a'", '"a', "#c", "/* c */ 1", "1 // c", "[[[[1]]]]", '"\\ud83d\\ude00"',
    "12345678901234567890123456789012345678901234567890", "1e400", '{"a":{"a":1},"b":[{}]}',
]


def test_parse_agrees_with_python(spark, write_lines):
    lines = [p[0].strip() for p in PROBES] + MORE_LINES
    got = read_jsonl(spark, write_lines(lines)).orderBy("ord").collect()
    assert [(r.raw, r.parsed) for r in got] == [(x, parses(x)) for x in lines]


def test_parse_agrees_with_python_on_damaged_lines(spark, write_lines):
    rng = random.Random(11)
    whole = [p[0].strip() for p in PROBES[:15]] + [json.dumps(sample(system="é😀"))]
    pieces = ["]", "}", "[", "{", '"', ",", ":", "1", " ", "\\", "null", ',"k":1', '"]', "a"]
    lines = []
    for _ in range(4000):
        line = rng.choice(whole)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(line) + 1)
            line = line[:at] + rng.choice([*pieces, ""]) + line[at + rng.randint(0, 2) :]
        if line.strip():
            lines.append(line.strip())
    got = read_jsonl(spark, write_lines(lines)).orderBy("ord").collect()
    assert [(r.raw, r.parsed) for r in got] == [(x, parses(x)) for x in lines]
    assert 100 < sum(r.parsed for r in got) < len(lines) - 100


def test_last_duplicate_key_wins(spark, write_lines):
    lines = read_jsonl(spark, write_lines(['{"a":1,"a":2}']))
    assert lines.selectExpr("try_variant_get(sample, '$.a', 'int')").first()[0] == 2


def test_blank_lines_are_skipped(spark, write_lines):
    path = write_lines([sample(), "", "   ", sample(user="Second")])
    assert read_jsonl(spark, path).count() == 2


def test_quarantine_counts_and_first_five(spark, write_lines):
    lines = ["{bad %d" % i if i % 3 == 0 else json.dumps(sample()) for i in range(30)]
    frame = read_jsonl(spark, write_lines(lines))
    assert tuple(line_counts(frame).first()) == (30, 20, 10)
    first = malformed(frame).orderBy("ord").limit(5).collect()
    assert [r.raw for r in first] == ["{bad %d" % i for i in (0, 3, 6, 9, 12)]


def test_missing_and_empty_sources_fail(spark, write_lines, tmp_path):
    with pytest.raises(AnalysisException):
        read_jsonl(spark, str(tmp_path / "none.jsonl"))
    for lines in ([""], ["{bad", "also bad"]):
        with pytest.raises(ValueError, match="no valid samples"):
            prepare_jsonl(spark, write_lines(lines), str(tmp_path / "out"))


def test_order_key_is_file_order_over_many_splits(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    expected = []
    for f in range(3):
        lines = [f'"{f} {i} {"x" * (i % 50)}"' for i in range(3000)]
        (folder / f"part-{f}.jsonl").write_text("\n".join(lines) + "\n")
        expected += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        frame = read_jsonl(spark, str(folder))
        assert frame.rdd.getNumPartitions() > 8
        assert [r.raw for r in frame.orderBy("ord").select("raw").collect()] == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_round_trip_keeps_lines_as_they_are(spark, write_lines, tmp_path):
    lines = [
        '{"z":1, "messages":[{"role":"user","content":"é \\u00e9 😀","x":null}], "a":[ ]}',
        '{"id":2,"messages":[]}',
    ]
    out = str(tmp_path / "out")
    for _ in range(2):  # the second write replaces the first
        write_jsonl(read_jsonl(spark, write_lines(lines)), out)
    assert sorted(r.raw for r in read_jsonl(spark, out).collect()) == sorted(lines)


def test_long_strings_are_not_malformed(spark, write_lines):
    long = "x" * 21_000_000
    path = write_lines([sample(user=long), "{broken"])
    rows = read_jsonl(spark, path).selectExpr(
        "parsed", "length(try_variant_get(sample, '$.messages[0].content', 'string')) AS n"
    )
    assert sorted((r.parsed, r.n) for r in rows.collect()) == [(False, None), (True, 21_000_000)]
