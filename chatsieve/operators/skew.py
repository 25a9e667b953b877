"""Joins in which one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.storage import scratch_path, written

# A key is hot if it holds more than this many rows and more than one in
# MAX_HOT_KEYS of all rows; so there are never more than MAX_HOT_KEYS of them.
MIN_HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 1000


# Removed rows are told by a broadcast of their ids up to this many, 24 bytes each.
MAX_BROADCAST_IDS = 1_000_000
# Beyond, by a broadcast of bitmaps of this size in all.
MAX_BITMAP_BYTES = 128 * 2**20
BITMAP_BYTES = 4096


def broadcast_small(table: DataFrame, row_bytes: str, max_bytes: int) -> DataFrame:
    """``table`` marked for broadcast if the sum of ``row_bytes`` is no more than ``max_bytes``."""
    size = table.agg(F.sum(F.expr(row_bytes))).first()[0] or 0
    return F.broadcast(table) if size <= max_bytes else table


def without(rows: DataFrame, id_col: str, removed: DataFrame, n_removed: int) -> DataFrame:
    """``rows`` but for those whose id, a BIGINT from 1 on, is in ``removed``.

    Rows stay where they are as long as the ids fit a broadcast: as they are if they are few, as
    bitmaps (a bit for each id of 32,768 in a row) if they are many. Only beyond are rows
    shuffled by id, which is unique.
    """
    if not n_removed:
        return rows
    if n_removed <= MAX_BROADCAST_IDS:
        return rows.join(F.broadcast(removed), id_col, "left_anti")
    bitmaps = removed.groupBy(F.expr(f"bitmap_bucket_number({id_col}) AS _bucket")).agg(
        F.expr(f"bitmap_construct_agg(bitmap_bit_position({id_col})) AS _bits")
    )
    bitmaps = written(bitmaps, scratch_path(rows.sparkSession, "bitmaps"))
    if bitmaps.count() * BITMAP_BYTES > MAX_BITMAP_BYTES:
        return rows.join(removed, id_col, "left_anti")
    byte = "CAST(conv(hex(substring(_bits, CAST(_bit div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    kept = f"_bits IS NULL OR ({byte} & shiftleft(1, CAST(_bit % 8 AS INT))) = 0"
    return (
        rows.selectExpr(
            "*",
            f"bitmap_bucket_number({id_col}) AS _bucket",
            f"bitmap_bit_position({id_col}) AS _bit",
        )
        .join(F.broadcast(bitmaps), "_bucket", "left")
        .where(kept)
        .drop("_bucket", "_bit", "_bits")
    )


def hot_keys(rows: DataFrame, key: str, min_rows: int | None = None) -> list:
    """The hot values of ``key``: by their definition a short list.

    Costs a count and, for a large table, one narrow aggregate.
    """
    least = MIN_HOT_ROWS if min_rows is None else min_rows
    n = rows.select(key).count()
    if n <= least:
        return []
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") > max(least, n // MAX_HOT_KEYS))
    return [row[0] for row in hot.select(key).dropna().collect()]


def largest_keys(sizes: DataFrame, key: str, size: str) -> list:
    """Hot keys where the rows per key are known already: at most MAX_HOT_KEYS.

    A key that is not among them holds at most one in MAX_HOT_KEYS of all rows,
    or at most MIN_HOT_ROWS rows.
    """
    large = sizes.where(F.col(size) > MIN_HOT_ROWS).orderBy(F.col(size).desc())
    return [row[0] for row in large.select(key).limit(MAX_HOT_KEYS).collect()]


def join_unique(rows: DataFrame, table: DataFrame, key: str, hot: list) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key.

    Rows of hot keys stay where they are and meet a broadcast of the at most
    MAX_HOT_KEYS rows of ``table`` they need; all others are shuffled by key.
    """
    if not hot:
        return rows.join(table, key)
    is_hot = F.col(key).isin(hot)
    cold_part = rows.where(~is_hot).join(table, key)
    hot_part = rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key)
    return cold_part.unionByName(hot_part)


def split_by_keys(
    rows: DataFrame, keys: DataFrame, key: str, max_broadcast: int
) -> tuple[DataFrame, DataFrame]:
    """``rows`` without and with the keys in ``keys`` (distinct, one column).

    The keys are broadcast if a count shows that they are few. Otherwise hot
    keys are told apart by value, and only the rest is shuffled by key.
    """
    if keys.limit(max_broadcast + 1).count() <= max_broadcast:
        keys = F.broadcast(keys)
        return rows.join(keys, key, "left_anti"), rows.join(keys, key, "left_semi")
    hot = hot_keys(rows, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold, hot_rows = rows.where(~is_hot), rows.where(is_hot)
    listed = [row[0] for row in keys.where(F.col(key).isin(hot)).collect()]
    is_listed = F.col(key).isin(listed)
    return (
        cold.join(keys, key, "left_anti").unionAll(hot_rows.where(~is_listed)),
        cold.join(keys, key, "left_semi").unionAll(hot_rows.where(is_listed)),
    )
