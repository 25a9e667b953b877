from __future__ import annotations

import json

import pytest

from chatsieve.operators.evaluate import (
    compare,
    last_per_name,
    prompt_messages,
    report,
    with_prompt_defaults,
    with_response_features,
    with_response_score,
)
from chatsieve.operators.skew import hot_keys
from chatsieve.plans.compare import compare_models
from chatsieve.sources.evaluation import (
    PROMPT_SCHEMA,
    RESPONSE_SCHEMA,
    RESULT_FIELDS,
    read_prompts,
    read_responses,
)


def scores(spark, *rows):
    frame = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)],
        "pos INT, response STRING, expected_keywords ARRAY<STRING>",
    )
    scored = with_response_score(frame).orderBy("pos")
    return [r.score for r in scored.collect()]


def test_response_scores(spark):
    hundred = " ".join(f"w{i:03d}" for i in range(20))  # 99 characters, all distinct
    got = scores(
        spark,
        (None, []), ("", []), (" \n　 ", ["x"]),
        # (0.1 + 0.5 + 1.0) / 3, (0.3 + 0.5 + 1.0) / 3
        ("Yes.", []), ("Yes, that is so.", []),
        # (1.0 + 0.5 + 1.0) / 3, NULL keywords are none
        (hundred, []), (hundred, None),
        # three of four keywords, one twice, one empty: (1.0 + 0.75 + 1.0) / 3
        (hundred, ["W001", "w001", "", "absent"]),
        # (0.3 + 0.0 + 0.2 * 1.2) / 3
        ("ha Ha HA hA ha, ha, ha", ["x"]),
        # length bands count stripped text
        ("  " + "a" * 9 + " ", []), ("a" * 10, []), ("a" * 49, []), ("a" * 50, []),
        ("a" * 499, []), ("a" * 500, []), ("a" * 999, []), ("a" * 1000, []),
    )
    assert got == [
        0.0, 0.0, 0.0,
        0.533, 0.6,
        0.833, 0.833,
        0.917,
        round((0.3 + 0.0 + 2 / 7 * 1.2) / 3, 3),
        0.533, 0.6, 0.6, 0.833,
        0.833, 0.733, 0.733, 0.667,
    ]


def test_blank_response_has_no_words(spark):
    frame = spark.createDataFrame([(" ", ["a"])], "response STRING, expected_keywords ARRAY<STRING>")
    row = with_response_features(frame).first()
    assert (row.blank, row.diversity, row.coverage) == (True, 0.0, 0.0)


def prompts(spark, *rows):
    return spark.createDataFrame(list(rows), PROMPT_SCHEMA)


def responses(spark, *rows):
    return spark.createDataFrame(list(rows), RESPONSE_SCHEMA)


def test_prompt_defaults_and_faults(spark, tmp_path):
    path = tmp_path / "prompts.json"
    items = [
        {"pos": 0, "name": "a", "user": "Hello!", "system": "Be kind.",
         "expected_keywords": ["hi"], "max_tokens": 64},
        {"pos": 1, "name": "b", "user": "Code"},
        {"pos": 2, "name": "c"},
        {"pos": 3, "user": "x"},
    ]
    path.write_text("\n".join(map(json.dumps, items)))
    rows = with_prompt_defaults(read_prompts(spark, str(path))).orderBy("pos").collect()
    assert [(r.system, r.expected_keywords, r.max_tokens, r.error) for r in rows] == [
        ("Be kind.", ["hi"], 64, None),
        ("", [], 256, None),
        ("", [], 256, "missing_user"),
        ("", [], 256, "missing_name"),
    ]


def test_prompt_messages(spark):
    frame = prompt_messages(
        with_prompt_defaults(
            prompts(spark, (0, "a", "u", "s", None, None), (1, "b", "v", None, None, None))
        )
    )
    got = [[tuple(m) for m in r.messages] for r in frame.orderBy("pos").collect()]
    assert got == [[("system", "s"), ("user", "u")], [("user", "v")]]


def test_last_base_response_wins(spark):
    base = responses(spark, (0, "a", "first"), (2, "a", "last"), (1, "b", "only"))
    rows = {r.name: (r.pos, r.response) for r in last_per_name(base).collect()}
    assert rows == {"a": (2, "last"), "b": (1, "only")}


def test_comparison(spark, tmp_path):
    table = prompts(
        spark,
        (0, "a", "first", None, None, None),
        (1, "b", "second", None, ["blue"], None),
        (2, "a", "third", None, None, None),
    )
    base = responses(spark, (0, "a", "x"), (1, "b", "blue"), (2, "a", "Yes, that is so."))
    tuned = responses(spark, (0, "a", ""), (1, "b", "blue"), (2, "a", "b" * 60))
    out = str(tmp_path / "results")
    results, totals = compare_models(table, base, tuned, out)
    rows = results.orderBy("pos").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("a", "first", "Yes, that is so.", "", 0.6, 0.0, -0.6),
        ("b", "second", "blue", "blue", 0.7, 0.7, 0.0),
        ("a", "third", "Yes, that is so.", "b" * 60, 0.6, 0.833, 0.233),
    ]
    total = totals.first()
    assert (total.n, total.up, total.same, total.down) == (3, 1, 1, 1)
    assert total.mean_improvement == pytest.approx(-0.367 / 3)
    labels = report(results).orderBy("pos").collect()
    assert [r.label for r in labels] == ["down", "same", "up"]
    stored = spark.read.json(out)
    assert stored.count() == 3 and sorted(stored.columns) == sorted(RESULT_FIELDS)


def test_a_hot_name_gives_the_same_results(spark, monkeypatch):
    names = [("hot" if i % 3 else f"n{i}") for i in range(60)]
    table = prompts(spark, *[(i, n, f"q{i}", None, ["w1"], None) for i, n in enumerate(names)])
    base = responses(spark, *[(i, n, f"w{i} and more") for i, n in enumerate(names)])
    tuned = responses(spark, *[(i, n, f"w{i % 7} " * i) for i, n in enumerate(names)])
    plain = sorted(map(tuple, compare(table, base, tuned).collect()))
    assert len(plain) == 60
    monkeypatch.setattr("chatsieve.operators.skew.MIN_HOT_ROWS", 10)
    assert hot_keys(tuned, "name") == ["hot"]
    split = compare(table, base, tuned)
    assert "Union" in split._jdf.queryExecution().toString()
    assert sorted(map(tuple, split.collect())) == plain


def test_preview_is_cut_and_empty_summary(spark):
    table = prompts(spark, (0, "a", "u", None, None, None))
    answer = responses(spark, (0, "a", "é" * 700))
    results, _ = compare_models(table, answer, answer)
    row = report(results).first()
    assert row.base_preview == row.tuned_preview == "é" * 500
    results, totals = compare_models(table.limit(0), answer.limit(0), answer.limit(0))
    assert results.isEmpty() and totals.first().mean_improvement == 0.0


def test_unmatched_and_repeated_rows_stop_the_comparison(spark):
    table = prompts(
        spark, (0, "a", "u", None, None, None), (1, "b", "v", None, None, None)
    )
    both = responses(spark, (0, "a", "x"), (1, "b", "y"))
    one = responses(spark, (0, "a", "x"))
    other = responses(spark, (0, "a", "x"), (1, "c", "y"))
    nameless = responses(spark, (0, "a", "x"), (1, "b", "y"), (2, None, "z"))
    for base, tuned, counts in (
        (both, one, "'without_tuned': 1"),
        (one, both, "'without_base': 1"),
        (both, other, "'without_tuned': 1"),
        (both, both.union(one), "'repeated': 1"),
        (both.union(one), both, "'repeated': 1"),
        (nameless, both, "'damaged': 1"),
    ):
        with pytest.raises(ValueError, match=counts):
            compare_models(table, base, tuned)
    # A base response that belongs to no prompt does no harm.
    assert compare_models(table, both.union(responses(spark, (7, "zz", "q"))), both)[0].count() == 2


def test_files_without_positions_are_paired_by_name(spark, tmp_path):
    def lines(name, *items):
        path = tmp_path / name
        path.write_text("\n".join(i if isinstance(i, str) else json.dumps(i) for i in items))
        return str(path)

    table = read_prompts(spark, lines("p", {"name": "a", "user": "u"}, {"name": "b", "user": "v"}))
    base = read_responses(
        spark, lines("b", {"name": "b", "response": "y"}, {"name": "a", "response": "x"})
    )
    results, _ = compare_models(table, base, base)
    assert sorted((r.prompt_name, r.base_response) for r in results.collect()) == [
        ("a", "x"), ("b", "y"),
    ]
    cut = read_responses(
        spark,
        lines("c", {"name": "b", "response": "y"}, {"name": "a", "response": "x"}, '{"name": "b'),
    )
    with pytest.raises(ValueError, match="'damaged': 1"):
        compare_models(table, base, cut)
    odd = read_prompts(spark, lines("o", {"name": "a", "user": "u", "max_tokens": "x"}))
    with pytest.raises(ValueError, match="malformed"):
        compare_models(odd, base, base)


def test_copies_of_a_shared_base_response(spark, monkeypatch):
    table = prompts(spark, *[(i, "a", f"q{i}", None, ["w1"], None) for i in range(40)])
    tuned = responses(spark, *[(i, "a", f"w{i % 7} " * i) for i in range(40)])
    plain = sorted(map(tuple, compare(table, tuned, tuned).collect()))
    assert len(plain) == 40
    monkeypatch.setattr("chatsieve.operators.evaluate.ROWS_PER_COPY", 10)
    assert sorted(map(tuple, compare(table, tuned, tuned).collect())) == plain


def test_incomplete_prompt_stops_the_comparison(spark):
    table = prompts(spark, (3, "a", None, None, None, None))
    some = responses(spark, (3, "a", "x"))
    with pytest.raises(ValueError, match="prompt 3: missing_user"):
        compare_models(table, some, some)


def test_prompt_documents(spark, tmp_path):
    import json

    from chatsieve.sources.evaluation import read_prompt_document

    items = [
        {"name": "a", "user": "u", "system": "s", "expected_keywords": ["x", "y"], "max_tokens": 9, "more": 1},
        {"name": "b", "user": ["u"], "system": 5}, {"name": None, "user": None}, {"user": "u"}, "text", 7, None, [],
        {"name": "c", "user": "", "expected_keywords": ["x", 1, None], "max_tokens": "9"},
        {"name": "d", "user": "u", "expected_keywords": "x", "max_tokens": 1.5},
    ]
    bodies = {
        "a": json.dumps({"prompts": items}, indent=1), "b": "{", "c": "[]", "d": '{"other": []}',
        "e": '{"prompts": {"name": "x"}}', "f": '{"prompts": []}', "g": " ",
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(body)
    rows = read_prompt_document(spark, str(tmp_path)).orderBy("document", "pos").collect()
    first = [r for r in rows if r.document.endswith("a.json")]
    assert [r.pos for r in first] == list(range(10))
    assert [r.errors for r in first] == [
        [], ["user_not_text", "system_not_text"], ["name_not_text", "user_not_text"], ["missing_name"],
        *[["not_object"]] * 4, ["max_tokens_not_integer", "keyword_not_text@1", "keyword_not_text@2"],
        ["keywords_not_list", "max_tokens_not_integer"],
    ]
    assert tuple(first[0])[2:7] == ("a", "u", "s", ["x", "y"], 9)
    assert (first[1].user, first[1].system, first[8].expected_keywords) == (None, None, ["x", None, None])
    assert [(r.document[-6], r.pos, r.errors) for r in rows if not r.document.endswith("a.json")] == [
        ("b", None, ["malformed"]), ("c", None, ["missing_prompts"]), ("d", None, ["missing_prompts"]),
        ("e", None, ["prompts_not_list"]), ("g", None, ["malformed"]),
    ]
