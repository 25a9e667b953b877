"""Shared helpers: the tables, row keys, tables written on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsieve.storage import scratch_path, written

__all__ = ["counted_join", "keep", "keyed", "lowered", "same_key", "size_checked", "spare", "split_words", "table"]

# Bytes of a table that may be broadcast. Keys with more than this part of all rows are joined apart.
BROADCAST_BYTES, HOT_KEYS = 64_000_000, 1_000

_UPPER = "".join(map(chr, range(65, 91)))
# Listed one by one: a class of single characters is one table lookup per character.
_CLASS = "".join(f"\\\\x{c:02x}" for c in range(128) if not chr(c).isalnum())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the cluster's shared folder and read it back."""
    return written(df, scratch_path(df.sparkSession, name))


def split_words(text: str) -> str:
    """SQL of the words of a text, cut at ASCII characters that are neither letters
    nor digits; case as it stands. NULL gives no words."""
    return f"filter(split(coalesce({text}, ''), '[{_CLASS}]+'), x -> x <> '')"


def lowered(text: str) -> str:
    """SQL of a text with A-Z, and nothing else, in lower case."""
    return f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')"


def size_checked(df: DataFrame, max_rows: int) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most
    ``max_rows`` rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= max_rows else df


def counted_join(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``rows`` with the columns of ``keys``: a written table with one row per ``on`` and, in
    ``n``, the number of ``rows`` that have it.

    Small ``keys`` are broadcast, by their bytes. Otherwise those that hold more than one in
    ``HOT_KEYS`` of the rows, so fewer than that, are broadcast, and the rest is shuffled.
    """
    width = F.expr("octet_length(CAST(struct(*) AS STRING)) + 64")
    size, total = keys.agg(F.sum(width), F.sum("n")).first()
    if (size or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keys.drop("n")), on)
    often = F.col("n") > total // HOT_KEYS
    hot = F.broadcast(keys.where(often).drop("n"))
    rest = rows.join(hot.select(on), on, "left_anti").join(keys.where(~often).drop("n"), on)
    return rows.join(hot, on).unionByName(rest)


def spare(columns: list[str], *names: str) -> list[str]:
    """Names of helper columns, with as many underscores before them as no given column has."""
    given = {c.lower() for c in columns}
    while given.intersection(names):
        names = tuple("_" + n for n in names)
    return list(names)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``th`` (hash of the text) and ``text``.

    Rows are told apart by ``doc_id`` and text, so repeated rows share one key
    and one result, and repeated ids with other texts do not.
    """
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text, F.lit(7)).alias("th"), text.alias("text"))


def same_key(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["th"] == right["th"])
