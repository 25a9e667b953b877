from __future__ import annotations

import pytest

from chatsieve.catalog.inputs import chat_input, turn_input
from chatsieve.catalog.oracle import ORACLE
from chatsieve.operators import stats
from chatsieve.operators.curate import curate, dedup_first, kept, with_parts, with_quality
from chatsieve.operators.features import conversation_features, sample_features
from tests.conftest import SF_CHECK, SF_SMALL, sample_rows, turn_rows


def text(n_words: int, n_chars: int) -> str:
    """``n_words`` equal words in ``n_chars`` characters."""
    size = (n_chars - (n_words - 1)) // n_words
    words = ["w" * size] * (n_words - 1)
    return " ".join([*words, "w" * (n_chars - len(" ".join(words)) - (n_words > 1))])


# messages -> s1, s2, s3, s4, s5, quality
SCORES = [
    # limits of the length bands: 19|20, 99|100, 499|500 and 4|5, 19|20, 99|100
    ([("user", "u" * 4), ("assistant", "a" * 19)], (0.0, 0.1, 0.0, 0.0, 0.2), 0.3),
    ([("user", "u" * 5), ("assistant", "a" * 20)], (0.1, 0.1, 0.0, 0.05, 0.2), 0.45),
    ([("user", "u" * 19), ("assistant", "a" * 99)], (0.1, 0.1, 0.0, 0.05, 0.2), 0.45),
    ([("user", "u" * 20), ("assistant", "a" * 100)], (0.2, 0.1, 0.0, 0.1, 0.2), 0.6),
    ([("user", "u" * 99), ("assistant", "a" * 499)], (0.2, 0.1, 0.0, 0.1, 0.2), 0.6),
    ([("user", "u" * 100), ("assistant", "a" * 500)], (0.3, 0.1, 0.0, 0.2, 0.2), 0.8),
    # a system message, four and six turns
    (
        [("system", "s"), ("user", "u" * 100), ("assistant", "a" * 500)],
        (0.3, 0.1, 0.1, 0.2, 0.2),
        0.9,
    ),
    ([("user", "u" * 5), ("assistant", "a" * 20)] * 2, (0.1, 0.15, 0.0, 0.05, 0.15), 0.45),
    ([("user", "u" * 5), ("assistant", "a" * 20)] * 3, (0.1, 0.2, 0.0, 0.05, 0.1), 0.45),
    # no words at all
    ([("user", "u" * 5), ("assistant", " " * 20)], (0.1, 0.1, 0.0, 0.05, 0.0), 0.25),
    # one distinct word of eight: 0.3 / 8 = 0.0375
    ([("user", "u" * 5), ("assistant", text(8, 31))], (0.1, 0.1, 0.0, 0.05, 0.075), 0.325),
    ([("user", "u"), ("assistant", "")], (0.0, 0.1, 0.0, 0.0, 0.0), 0.1),
]


def test_scores(spark):
    rows = sample_rows(spark, {i: m for i, (m, _, _) in enumerate(SCORES)})
    features = sample_features(rows)
    parts = {r.conv_id: r for r in with_parts(features).collect()}
    scores = {r.conv_id: r.quality for r in with_quality(features).collect()}
    for i, (messages, expected, total) in enumerate(SCORES):
        said = [w for r, c in messages if r == "assistant" for w in c.lower().split()]
        s5 = min(0.2, len(set(said)) / len(said) * 0.3) if said else 0.0
        assert [parts[i][f"s{j}"] for j in range(1, 5)] == list(expected[:4]), i
        assert parts[i].s5 == s5, i
        assert scores[i] == round(sum(expected[:4], 0.0) + s5, 3), i


def test_score_is_zero_if_a_side_is_missing(spark):
    rows = {1: [], 2: [("user", "u" * 200)], 3: [("assistant", "a" * 900)]}
    scored = with_quality(sample_features(sample_rows(spark, rows)))
    assert [r.quality for r in scored.collect()] == [0.0, 0.0, 0.0]


def test_bucket_limits(spark):
    from chatsieve.functions.scoring import quality_bucket

    values = [0.0, 0.399, 0.4, 0.599, 0.6, 0.799, 0.8, 1.0]
    frame = spark.createDataFrame([(v,) for v in values], "q DOUBLE")
    got = [r[0].split()[0] for r in frame.selectExpr(quality_bucket("q")).collect()]
    assert got == ["poor", "poor", "fair", "fair", "good", "good", "excellent", "excellent"]


GOOD = [("user", "What does it do?"), ("assistant", "It reads, sorts and writes lines.")]


def test_copies_keep_the_first(spark):
    turns = turn_rows(spark, {7: GOOD, 3: GOOD, 5: GOOD, 9: GOOD[:1]})
    curated = curate(conversation_features(turns), "conv_id", "conv_id")
    assert [r.conv_id for r in kept(curated).collect()] == [3]
    counters = stats.counters(stats.measures(curated)).first()
    assert (counters.total_raw, counters.duplicates_removed) == (4, 2)
    assert (counters.invalid_removed, counters.total_filtered) == (1, 1)


def test_dedup_twice_is_dedup_once(spark):
    features = conversation_features(chat_input(spark, SF_SMALL)).where("valid")
    once = dedup_first(features, "conv_id", "conv_id").drop("copies")
    twice = dedup_first(once, "conv_id", "conv_id")
    assert twice.where("copies > 1").isEmpty()
    assert twice.drop("copies").exceptAll(once.select(twice.drop("copies").columns)).isEmpty()


def test_drop_reasons(spark):
    rows = {
        1: [("user", "Hello there"), ("assistant", "Yes")],  # short, 0.05 + 0.1 + 0.2
        2: [("user", "u"), ("assistant", "")],  # 0.1
        3: [("user", "Hello there"), ("assistant", "ten chars.")],  # equal is kept
    }
    curated = curate(
        conversation_features(turn_rows(spark, rows)), "conv_id", "conv_id", 0.35
    )
    got = {r.conv_id: (r.quality, r.drop_reason) for r in curated.collect()}
    assert got == {
        1: (0.35, "short_assistant"),
        2: (0.1, "low_quality"),
        3: (0.35, None),
    }


def test_nothing_kept(spark):
    turns = turn_rows(spark, {1: GOOD[:1]})
    curated = curate(conversation_features(turns), "conv_id", "conv_id")
    assert tuple(stats.averages(stats.measures(curated)).first()) == (0.0, 0.0, 0.0)
    assert stats.role_distribution(stats.measures(curated)).collect() == []
    assert stats.quality_histogram(stats.measures(curated)).collect() == []
    assert tuple(stats.counters(stats.measures(curated)).first()) == (1, 1, 0, 0, 0)


@pytest.mark.parametrize("sf_dir", [SF_SMALL, SF_CHECK, "/root/testdata/sf0.1"])
def test_counts_on_the_tables(spark, duck, sf_dir):
    """The counts come from SQL over the same tables, so new inputs cannot break them."""
    tables = duck(sf_dir)

    def rows(name):
        return tables.execute(ORACLE[name]).fetchall()

    features = conversation_features(turn_input(spark, sf_dir))
    curated = curate(features, "conv_id", "conv_id", min_quality=0.4).cache()
    assert list(map(tuple, stats.counters(stats.measures(curated)).collect())) == rows("dataset_stats")
    histogram = [tuple(r) for r in stats.quality_histogram(stats.measures(curated)).collect()]
    assert histogram == sorted(rows("quality_histogram")) and len(histogram) >= 3
    reasons = curated.where("valid").select("conv_id", "drop_reason").collect()
    assert sorted(map(tuple, reasons), key=repr) == sorted(rows("drop_reason"), key=repr)
    c = stats.counters(stats.measures(curated)).first()
    assert c.low_quality_removed == sum(r.drop_reason is not None for r in reasons)
    assert c.total_filtered == sum(r.drop_reason is None for r in reasons)
    curated.unpersist()


def test_result_does_not_depend_on_partitioning(spark):
    def result():
        features = conversation_features(chat_input(spark, SF_SMALL).repartition(5))
        curated = curate(features, "conv_id", "conv_id", 0.4)
        return sorted(map(tuple, curated.where("valid").collect()))

    expected = result()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert result() == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
