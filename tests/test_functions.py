from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chatsieve.functions.keys import G, LANES, P, content_key, lane, message_digest, power
from chatsieve.functions.text import WHITESPACE, py_round, strip_ws, words


def evaluate(spark, values, kind, *expressions):
    rows = list(enumerate(values))
    frame = spark.createDataFrame(rows, f"i INT, x {kind}")
    out = frame.selectExpr("i", *expressions).orderBy("i").collect()
    return [tuple(row)[1:] for row in out]


def test_whitespace_is_pythons(spark):
    assert WHITESPACE == [i for i in range(0x110000) if chr(i).isspace()]
    points = [i for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF]
    chunks = [points[i : i + 4096] for i in range(0, len(points), 4096)]
    # Each character stands between letters, in a text of its own line.
    texts = ["".join(f"a{chr(p)}b\x00" for p in chunk) for chunk in chunks]
    pattern = "split(x, '\\0')"
    frame = spark.createDataFrame([(t,) for t in texts], "x STRING").selectExpr(
        f"explode({pattern}) AS c"
    )
    found = frame.where(f"size({words('c')}) = 2").selectExpr("ascii(substring(c, 2, 1))")
    assert sorted(r[0] for r in found.collect()) == WHITESPACE


@settings(
    max_examples=8,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(
    st.lists(
        st.text(st.sampled_from(["a", "B", "é", "ß", "Σ", *map(chr, WHITESPACE)])),
        min_size=20,
        max_size=60,
    )
)
def test_strip_and_words_follow_python(spark, texts):
    got = evaluate(spark, texts, "STRING", strip_ws("x"), words("x"))
    assert [g[0] for g in got] == [t.strip() for t in texts]
    assert [g[1] for g in got] == [t.lower().split() for t in texts]


def test_round_three_digits(spark):
    rng = random.Random(7)
    values = [0.5125, 0.5625, 0.3125, 0.0625, 0.0005, 0.0015, 0.001, 0.0, 1.0, 0.95]
    values += [i / 16 for i in range(64)] + [(i + 0.5) / 1000 for i in range(3000)]
    values += [0.1 + 0.1 + 0.05 + 0.2 + 0.3 * i / n for n in range(1, 60) for i in range(n)]
    values += [rng.random() * 10**e for e in range(-6, 5) for _ in range(500)]
    values += [-v for v in values[:200]]
    got = evaluate(spark, values, "DOUBLE", py_round("x", 3))
    assert [(v, g[0]) for v, g in zip(values, got) if round(v, 3) != g[0]] == []


def test_round_one_digit(spark):
    values = [0.15, 0.25, 0.75, 0.05, 0.04999, 0.0, 12.25, 12.75, 1e9 + 0.25]
    values += [a / b for b in range(1, 120) for a in range(0, 3 * b, 2)]
    values += [a / 20 for a in range(20_000)]
    got = evaluate(spark, values, "DOUBLE", py_round("x", 1))
    assert [(v, g[0]) for v, g in zip(values, got) if round(v, 1) != g[0]] == []


def test_round_keeps_null_and_refuses_other_digits(spark):
    assert spark.sql(f"SELECT {py_round('CAST(NULL AS DOUBLE)', 3)}").first()[0] is None
    with pytest.raises(ValueError):
        py_round("x", 2)


def test_key_sees_order_roles_and_borders(spark):
    def key(messages):
        rows = [(i, r, c) for i, (r, c) in enumerate(messages)]
        frame = spark.createDataFrame(rows, "i INT, r STRING, c STRING")
        lanes = [f"sum({lane('d', j)} * {power('i')} % {P}L)" for j in range(LANES)]
        return (
            frame.selectExpr("i", f"{message_digest('r', 'c')} AS d")
            .selectExpr(content_key("count(*)", lanes))
            .first()[0]
        )

    variants = [
        [("user", "a"), ("assistant", "b")],
        [("user", "b"), ("assistant", "a")],
        [("assistant", "b"), ("user", "a")],
        [("user", "a"), ("assistant", "b"), ("user", "a")],
        [("user", "a"), ("user", "a")],
        [("usera", ""), ("assistant", "b")],
        [("user", "a1:userb")],
    ]
    keys = [key(v) for v in variants]
    assert len(set(keys)) == len(variants)
    assert key(variants[0]) == keys[0]


def test_powers(spark):
    values = [0, 1, 15, 16, 2**31 - 2, 2**31, 2**62, -1, -(2**63), 2**63 - 1, 123456789]
    got = evaluate(spark, values, "BIGINT", power("x"))
    assert [g[0] for g in got] == [pow(G, v % (P - 1), P) for v in values]
