"""Nulls, empty and long texts, ties, repeated rows, extra columns, empty tables."""

from __future__ import annotations

import pytest

from chatsieve.llm import (
    decontaminate, langid, licenses, line_dedup, mixing, near_dup, pages, pii,
    quality_mil, quality_rules,
)
from tests.llm import brute

LONG = "word " * 30_000 + "token" * 20_000
SAID = "the quick brown fox jumps over the lazy dog and runs far away from every hunter " * 4
ROWS = [
    (1, None, None, None), (2, "", "", ""), (3, "  \n\t\n ", "en", "a"), (4, LONG, "en", "a"),
    (5, SAID, "en", "b"), (5, SAID, "en", "b"), (6, SAID, "de", "b"), (5, "other text", "en", None),
    (None, SAID, "en", "a"), (None, None, "en", "a"), (7, "É ñ \x00 mr@x.org 1.2.3.4\x01", "fr", "a"),
    (8, "###", "fr", "c"), (9, "MIT License", "fr", "c"),
]
KINDS = "doc_id BIGINT, text STRING, lang STRING, source STRING"
EXTRA = ["n", "w", "th", "h", "win", "fp", "at", "key", "node", "label", "kept", "copy", "rate",
         "_found", "runs", "value", "kind", "quality", "score", "held_out", "bands", "mean"]


def table(spark, rows):
    df = spark.createDataFrame(rows, KINDS)
    for name in EXTRA:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def labels(spark, rows=((5, 1, 0), (6, 1, 0), (8, 0, 0), (None, 1, 1), (4, None, None), (5, 0, 0))):
    return spark.createDataFrame(list(rows), "doc_id BIGINT, quality INT, toxic INT")


def items(spark, rows=((1, SAID), (1, SAID), (None, SAID), (2, None), (3, ""), (4, "other text"))):
    return spark.createDataFrame(list(rows), "item_id BIGINT, text STRING")


OPS = {
    "decontaminate": lambda s, d: decontaminate.contamination(d, items(s)),
    "licenses": lambda s, d: licenses.scan(d),
    "pii": lambda s, d: pii.replace(d),
    "line_dedup": lambda s, d: line_dedup.dedup_lines(d),
    "quality_rules": lambda s, d: quality_rules.judge(d, labels(s)),
    "langid": lambda s, d: langid.identify(d),
    "quality_mil": lambda s, d: quality_mil.classify(d, labels(s)),
    "near_dup": lambda s, d: near_dup.classes(d),
}


@pytest.mark.parametrize("name", OPS)
def test_one_row_per_document(spark, name):
    out = OPS[name](spark, table(spark, ROWS)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, name):
    assert OPS[name](spark, table(spark, [])).collect() == []


STAGES = {
    "quality": lambda s, d: quality_rules.drop_rejected(d, labels(s)),
    "near": lambda s, d: near_dup.keep_one(d),
    "clean": lambda s, d: decontaminate.drop_contaminated(d, items(s)),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_and_whole_rows(spark, name):
    docs = table(spark, ROWS)
    out = STAGES[name](spark, docs)
    assert out.columns == docs.columns
    assert out.subtract(docs).count() == 0
    assert STAGES[name](spark, table(spark, [])).count() == 0


def test_without_items_or_labels(spark):
    docs = table(spark, ROWS)
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items(spark, [])).collect())
    out = quality_rules.judge(docs, labels(spark, [])).collect()
    assert all(r.kept != r.base_failed for r in out)
    assert {r.score for r in quality_mil.classify(docs, labels(spark, [])).collect()} == {0.5}


def test_contamination_of_odd_rows(spark):
    out = decontaminate.contamination(table(spark, ROWS), items(spark)).collect()
    pairs = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in out}
    assert pairs == {(r[0], *brute.contamination(r[1], [tuple(i) for i in items(spark).collect()])) for r in ROWS}


def test_long_lines_and_repeated_rows(spark):
    out = line_dedup.dedup_lines(table(spark, ROWS), 10).collect()
    left = [r.text for r in out if r.text == SAID]
    # The NULL id sorts first and keeps the text; the equal rows of id 5 lose it.
    assert len(left) == 1 and [r.text for r in out if r.doc_id == 4] == [LONG]


def test_mixing_of_odd_rows(spark):
    docs = table(spark, ROWS)
    out = mixing.mix(docs, {"a": 1.0, "b": 0.0}).collect()
    assert "b" not in {r.source for r in out}
    assert mixing.mix(table(spark, []), {"a": 1.0}).count() == 0
    assert mixing.mix(docs).columns[: len(ROWS[0])] == ["doc_id", "text", "lang", "source"]


def test_pages_of_odd_rows(spark):
    kinds = "page_id BIGINT, url STRING, html STRING, text STRING, n_chars INT"
    rows = [(1, "u", None, "x", 1), (2, None, "", "x", 1), (None, "u", "<p>a", "x", 1), (2, None, "<p", "x", 1)]
    out = pages.extract(spark.createDataFrame(rows, kinds)).collect()
    assert sorted(r.text for r in out) == ["", "", "", "a"]
    assert pages.extract(spark.createDataFrame([], kinds)).count() == 0


def test_helper_columns_clash_with_none(spark):
    names = ["_cut_id", "_cut_th", "_cut", "_Lines", "_old", "_n", "_source", "_draws", "_mean", "_cdf", "__cut"]
    docs = spark.createDataFrame(ROWS, KINDS)
    for name in names:
        docs = docs.selectExpr("*", f"'x' AS {name}")
    for out in (line_dedup.dedup_lines(docs, 10), mixing.mix(docs, {"a": 1.0})):
        rows = out.collect()
        assert rows and all(r[n] == "x" for r in rows for n in names)
    plain = line_dedup.dedup_lines(spark.createDataFrame(ROWS, KINDS), 10)
    assert sorted(str(r.text) for r in line_dedup.dedup_lines(docs, 10).collect()) == sorted(str(r.text) for r in plain.collect())
