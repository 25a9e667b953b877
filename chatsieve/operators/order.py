"""Orders over whole tables: running sums, line numbers, files in a given order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatsieve.operators.skew import broadcast_small
from chatsieve.storage import scratch_path, written

# A broadcast of file parts and their first lines is at most this large.
MAX_OFFSET_BYTES = 64 * 2**20

# Files of ordered rows hold about this many bytes; more only where the numbers in
# their names would not sort any more.
FILE_BYTES = 128 * 2**20
MAX_FILES = 50_000

# Hex digits of a rank that say which file a row goes to: 52 bits, exact in a DOUBLE.
RANGE_DIGITS = 13


def prefix_sums(rows: DataFrame, order: list[str], value: str) -> tuple[DataFrame, str]:
    """Add ``before``: the sum of ``value`` over the rows that sort before, and the
    path of the table that holds the result. ``order`` must be unique.

    Rows are dealt by ranges and summed within them; only one number a range comes
    to the driver.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "ranges")
    ranges = written(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id()),
        path,
    )
    totals = ranges.groupBy("_range").agg(F.sum(value).alias("n")).orderBy("_range").collect()
    starts, total = [], 0
    for row in totals:
        starts.append((row["_range"], total))
        total += row["n"]
    offsets = spark.createDataFrame(starts, "_range INT, _start BIGINT")
    earlier = (
        Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum(value).over(earlier), F.lit(0))
    summed = (
        ranges.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_range")
        .withColumn("before", F.col("_start") + F.col("_inside"))
        .drop("_range", "_start", "_inside")
    )
    return summed, path


def number_lines(lines: DataFrame) -> tuple[DataFrame, str]:
    """Add ``ord`` (place among all lines, files by path) and ``line_no`` (in the file).

    Both count from 1 and count blank lines. ``lines`` is a written table with ``path, block,
    line_id`` of all lines as ``scan_lines`` gives them: within a part of a file, ids run on in reading
    order. Also returns the path of a work table.
    """
    parts = lines.groupBy("path", "block").agg(
        F.count("*").alias("n"), F.min("line_id").alias("first_id")
    )
    summed, path = prefix_sums(parts, ["path", "block"], "n")
    files = summed.groupBy("path").agg(F.min("before").alias("file_before"))
    offsets = (
        summed.join(files, "path")
        .selectExpr("path", "block", "before - first_id AS _to_ord", "file_before AS _in_file")
    )
    offsets = broadcast_small(offsets, "octet_length(path) + 64", MAX_OFFSET_BYTES)
    numbered = (
        lines.join(offsets, ["path", "block"])
        .selectExpr("*", "line_id + _to_ord + 1 AS ord")
        .selectExpr("*", "ord - _in_file AS line_no")
        .drop("_to_ord", "_in_file")
    )
    return numbered, path


def ranked_partitions(rows: DataFrame, rank: str, n_bytes: int, lead: list[str]) -> DataFrame:
    """Rows dealt so that files of one write sort by ``rank``, by name and by line.

    ``rank`` is a column of hex digits of a hash, so equal ranges of its values hold about equal
    numbers of rows: the range of a row is worked out from its rank, without a sample. Rows are
    sorted by ``lead`` and rank within a file.
    """
    size = max(FILE_BYTES, n_bytes // MAX_FILES)
    n = max(1, -(-n_bytes // size))
    head = f"CAST(conv(substring({rank}, 1, {RANGE_DIGITS}), 16, 10) AS DOUBLE)"
    place = F.expr(f"CAST(floor({head} / {float(16**RANGE_DIGITS)!r}D * {n}) AS INT)")
    return rows.repartitionById(n, place).sortWithinPartitions(*lead, rank)
