from __future__ import annotations

import hashlib

import pytest

from chatsieve.operators.split import split_exact, split_hash, train_size


def frame(spark, n, key=lambda i: f"k{i}"):
    return spark.createDataFrame([(i, key(i)) for i in range(n)], "id BIGINT, key STRING")


def expected_train(rows, ratio, seed):
    def sha(value):
        return hashlib.sha256(f"{value}|{seed}".encode()).hexdigest()

    ranked = sorted(rows, key=lambda r: (sha(r[1]), sha(r[0])))
    return {r[0] for r in ranked[: train_size(len(rows), ratio)]}


def train_ids(df):
    return {r.id for r in df.where("split = 'train'").collect()}


@pytest.mark.parametrize("n", [1, 2, 10, 20, 5000])
@pytest.mark.parametrize("ratio", [0.1, 0.2, 0.9])
@pytest.mark.parametrize("max_tail", [10_000, 1])
def test_exact_split_equals_a_full_sort(spark, n, ratio, max_tail):
    rows = frame(spark, n).cache()
    got = split_exact(rows, "id", eval_ratio=ratio, seed=7, max_tail=max_tail)
    assert got.count() == n
    assert train_ids(got) == expected_train(rows.collect(), ratio, 7)


def test_a_third_of_the_rows_with_one_key(spark):
    rows = frame(spark, 3000, lambda i: "same" if i % 3 == 0 else f"k{i}").cache()
    for ratio in (0.1, 0.5, 0.9):
        got = split_exact(rows, "id", eval_ratio=ratio, max_tail=10)
        assert train_ids(got) == expected_train(rows.collect(), ratio, 42)


def test_seed_and_partitioning(spark):
    rows = frame(spark, 300)
    first = train_ids(split_exact(rows, "id", seed=99))
    assert train_ids(split_exact(rows.repartition(13), "id", seed=99)) == first
    assert train_ids(split_exact(rows, "id", seed=98)) != first


@pytest.mark.parametrize("ratio", [0.0, -1.0, 1.0, 2.0])
@pytest.mark.parametrize("split", ["exact", "hash"])
def test_degenerate_ratio_puts_all_into_train(spark, ratio, split):
    rows = frame(spark, 10)
    if split == "exact":
        got = split_exact(rows, "id", eval_ratio=ratio)
    else:
        got = split_hash(rows, eval_ratio=ratio)
    assert len(train_ids(got)) == 10


def test_train_size_in_floating_point():
    assert [train_size(n, 0.9) for n in (1, 10, 20)] == [1, 1, 1]
    assert [train_size(n, 0.2) for n in (1, 10, 20)] == [1, 8, 16]


def test_hash_split_is_stable_as_data_grows(spark):
    small = train_ids(split_hash(frame(spark, 1000)))
    large = train_ids(split_hash(frame(spark, 2000)))
    assert small == {i for i in large if i < 1000}
    assert 1700 < len(large) < 1900


def test_empty_input(spark):
    assert split_exact(frame(spark, 1).where("id > 5"), "id").count() == 0


def test_rows_that_share_a_whole_rank(spark):
    """As many rows with one content and one id as do not fit the tail: one side gets them all."""
    rows = spark.createDataFrame([(1, "same")] * 50 + [(None, None)] * 50, "id BIGINT, key STRING")
    got = split_exact(rows, "id", eval_ratio=0.3, max_tail=10)
    counts = {(r.id, r.split): r["count"] for r in got.groupBy("id", "split").count().collect()}
    assert sorted(counts.values()) in ([50, 50], [100]) and sum(counts.values()) == 100
    assert sum(n for (_, split), n in counts.items() if split == "train") >= 70
