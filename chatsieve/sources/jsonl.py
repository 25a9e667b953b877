"""Chat samples as JSON Lines: one JSON value per line.

The line itself is carried as ``raw`` and is what gets written back, so extra
keys and key order survive. Lines are parsed into VARIANT, not into an inferred
schema, because inference coerces the very type faults that validation reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from chatsieve.functions.text import let, quoted, strip_ws
from chatsieve.storage import replaced


# The parser's own limits on strings (20 million characters) and numbers would take
# long values for damage; what remains is the size limit of VARIANT.
PARSER = (
    "map('maxStringLen', '2000000000', 'maxNumLen', '2000000000',"
    " 'maxNestingDepth', '1000', 'allowSingleQuotes', 'false', 'mode', 'PERMISSIVE')"
)


# Patterns of JSON: an escaped character, and a string without any.
ESCAPE, STRING = r"\\.", '"[^"]*"'

# Lines of this size are beyond VARIANT's limit in any case.
MAX_VARIANT_BYTES = 128 * 2**20


def strict_json(line: str) -> str:
    """VARIANT of a line that is exactly one JSON value, else NULL.

    The parser alone accepts a good prefix and ignores what follows it. So the
    line is parsed as the first element of a list whose second element is the
    line's own SHA-256, which no line can contain: that element comes out in
    second place only if one whole value, and nothing else, stands before it.
    """
    listed = f"from_json(concat('[', {line}, ',\"', seal_, '\"]'), 'variant', {PARSER})"
    value = (
        "CASE WHEN try_variant_get(listed_, '$[1]', 'string') = seal_ "
        "THEN try_variant_get(listed_, '$[0]', 'variant') END"
    )
    return let("seal_", f"sha2({line}, 256)", let("listed_", listed, value))


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines, blank ones too, as ``path, block, line_id, raw`` (stripped).

    A task numbers the rows of its file parts in reading order, whatever the order of
    the parts, so ``(path, block, line_id)`` sorts lines in file order (files by path).
    """
    return spark.read.text(path).selectExpr(
        "_metadata.file_path AS path",
        "_metadata.file_block_start AS block",
        "monotonically_increasing_id() AS line_id",
        f"{strip_ws('value')} AS raw",
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add ``sample`` (VARIANT) and ``parsed`` to rows with ``raw``.

    ``sample`` is NULL and ``parsed`` false where a line is malformed; both are NULL for blank lines.
    """
    # As in Python, the last of several equal keys counts.
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return lines.selectExpr("*", f"{strict_json('raw')} AS sample").selectExpr(
        "*", "IF(raw = '', NULL, sample IS NOT NULL) AS parsed"
    )


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines as ``ord, raw, sample, parsed``; ``ord`` sorts lines in file order."""
    lines = (
        scan_lines(spark, path)
        .selectExpr("struct(path, block, line_id AS line) AS ord", "raw")
        .where("raw <> ''")
    )
    return parse_lines(lines)


def damage(raw: str) -> str:
    """Why a line that is not one JSON value is none, as a stable code.

    ``too_large``: beyond the size limit of VARIANT; ``trailing_text``: something follows a whole
    value; ``unclosed``: the line ends inside a string, list or object; else ``bad_value``.
    """
    bare = f"regexp_replace(regexp_replace({raw}, {quoted(ESCAPE)}, ''), {quoted(STRING)}, '')"
    opened = "length(translate(bare_, ']}', '')) > length(translate(bare_, '[{', ''))"
    unclosed = let("bare_", bare, f"contains(bare_, '\"') OR {opened}")
    return f"""CASE WHEN octet_length({raw}) >= {MAX_VARIANT_BYTES} THEN 'too_large'
      WHEN try_parse_json({raw}) IS NOT NULL THEN 'trailing_text'
      WHEN {unclosed} THEN 'unclosed' ELSE 'bad_value' END"""


def malformed(lines: DataFrame) -> DataFrame:
    """Lines set aside because they are not one JSON value, with the ``reason``.

    All columns but ``sample`` and ``parsed`` are kept: after ``number_lines`` also the line's number.
    """
    bad = lines.where("NOT parsed").selectExpr("*", f"{damage('raw')} AS reason")
    return bad.drop("sample", "parsed")


def line_counts(lines: DataFrame) -> DataFrame:
    """One row: ``n_lines`` (blank ones left out), ``n_parsed``, ``n_malformed``."""
    return lines.selectExpr(
        "count(parsed) AS n_lines",
        "count_if(parsed) AS n_parsed",
        "count_if(NOT parsed) AS n_malformed",
    )


def typed_messages(sample: str = "sample") -> str:
    """``messages`` of a valid sample as ARRAY<STRUCT<role, content>>."""
    return (
        f"transform(try_variant_get({sample}, '$.messages', 'array<variant>'), "
        "m -> struct(try_variant_get(m, '$.role', 'string') AS role, "
        "try_variant_get(m, '$.content', 'string') AS content))"
    )


def to_lines(samples: DataFrame) -> DataFrame:
    """Nested rows to JSON lines ``{"id", "messages"}`` in ``raw``."""
    return samples.selectExpr(
        "conv_id",
        "to_json(struct(conv_id AS id, messages),"
        " map('ignoreNullFields', 'false')) AS raw",
    )


def write_jsonl(
    lines: DataFrame, path: str, partition_by: str | None = None
) -> None:
    """Write the ``raw`` column as text files, replacing what is at ``path`` once all is written.

    With ``partition_by`` one job writes one subfolder per value of that column
    and replaces these subfolders only.
    """
    columns = ["raw"] + ([partition_by] if partition_by else [])
    writer = lines.select(*columns).write
    if partition_by:
        replace_splits(writer, partition_by).text(path)
    else:
        replaced(lines.sparkSession, path, writer.text)


def replace_splits(writer: DataFrameWriter, column: str = "split") -> DataFrameWriter:
    """A writer that replaces the subfolders it has rows for, and nothing else.

    Spark writes into a staging folder and replaces subfolders when the job has ended well.
    """
    return (
        writer.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
    )
