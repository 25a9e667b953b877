"""Removal of repeated runs of lines by winnowing, in DataFrame functions only.

Only lines with a word take part; each is hashed. From every line a window runs
on to the first line that brings it to ``min_words`` words, another one back.
The least line hash of a window is its fingerprint, so two places that share a
run of at least ``min_words`` words share fingerprints, whatever stands around.
Fingerprints are joined over all documents; where one stands at two places or
more, its windows are extended line by line in both directions and compared by
content. A fingerprint or window that many rows share is joined by
broadcast, not in one task. Of equal windows the first place (by ``doc_id``, text hash, line) stays
and the lines of all later ones go.

So a line goes exactly if it lies in a run of consecutive lines of at least
``min_words`` words (parts between blanks) that also stands at an earlier place. The content of every
removed line stays at the first place it has.

Edge cases. NULL texts stay NULL, empty ones empty; blank lines are not
counted; those inside a removed run go with it, and if none but blank lines would
remain the text is empty.
Repeated rows (same id, same text) count as one document. A document whose own
lines repeat keeps the first run. Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatsieve.llm.tables import counted_join, keep, keyed, size_checked, spare

MIN_WORDS = 40
# Documents with cuts, and cut lines in all, that are broadcast; more are joined by shuffle.
MAX_BROADCAST, MAX_BROADCAST_LINES = 300_000, 4_000_000


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """Lines with a word of each distinct document, with their windows.

    ``doc_id, th, pos`` and two structs ``ahead``, ``back`` of ``fp, at`` (the
    least hash and its line), ``win`` (content), ``a, b`` (first and last line);
    NULL where the document ends before the window is full.
    """
    rows = (
        keyed(docs)
        .where("text IS NOT NULL")
        .selectExpr("doc_id", "th", r"posexplode_outer(split(text, '\n')) AS (pos, line)")
        .selectExpr(
            "doc_id", "th", "pos", "unhex(md5(line)) AS h",
            "size(filter(split(line, ' '), x -> x <> '')) AS n",
        )
        .where("n > 0")
        .repartition("doc_id", "th")
        .dropDuplicates(["doc_id", "th", "pos"])
    )
    doc = W.partitionBy("doc_id", "th")
    rows = rows.withColumn("upto", F.sum("n").over(doc.orderBy("pos"))).withColumn(
        "before", F.expr("upto - n")
    )
    ahead = doc.orderBy("before").rangeBetween(0, min_words - 1)
    back = doc.orderBy("upto").rangeBetween(1 - min_words, 0)
    total = F.max("upto").over(doc)

    def window(frame, full):
        return F.when(
            full,
            F.struct(
                F.min(F.struct("h", "pos")).over(frame).alias("least"),
                F.md5(F.concat_ws("", F.transform(F.collect_list("h").over(frame), F.hex)).cast("binary")).alias("win"),
                F.min("pos").over(frame).alias("a"),
                F.max("pos").over(frame).alias("b"),
            ),
        )

    return rows.select(
        "doc_id", "th", "pos",
        window(ahead, total - F.col("before") >= min_words).alias("ahead"),
        window(back, F.col("upto") >= min_words).alias("back"),
    )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies of runs: ``doc_id, th, a, b`` (first and last line, from 0)."""
    wins = keep(
        lines(docs, min_words)
        .selectExpr("doc_id", "th", "explode(array(ahead, back)) AS w")
        .where("w IS NOT NULL")
        .selectExpr(
            "w.least.h AS fp", "doc_id", "th", "w.least.pos AS at",
            "unhex(w.win) AS win", "w.a AS a", "w.b AS b",
        ),
        "line-windows",
    )
    place = "struct(doc_id, th, at)"
    several = [F.expr(f"{f} AS {name}") for f, name in (
        (f"min({place})", "lo"), (f"max({place})", "hi"), ("count(*)", "n"))]
    shared = keep(
        wins.groupBy("fp").agg(*several).where("lo <> hi").select("fp", "n"),
        "shared-fingerprints",
    )
    joined = keep(counted_join(wins, shared, "fp").drop("fp", "at"), "shared-windows")
    start = "struct(doc_id, th, a)"
    several = [F.expr(f"{f} AS {name}") for f, name in (
        (f"min({start})", "lo"), (f"max({start})", "hi"), ("count(*)", "n"))]
    first = keep(
        joined.groupBy("win").agg(*several).where("lo <> hi").select("win", "lo", "n"),
        "first-windows",
    )
    return (
        counted_join(joined, first, "win")
        .where(f"{start} > lo")
        .select("doc_id", "th", "a", "b")
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs cut out of ``text``, plus
    ``n_lines_cut`` (lines removed) and ``emptied`` (it had words, none remain)."""
    cut_id, cut_th, places, split_, old, count = spare(
        docs.columns, "_cut_id", "_cut_th", "_cut", "_lines", "_old", "_n")
    cut = keep(
        repeated_runs(docs, min_words)
        .groupBy("doc_id", "th")
        .agg(F.expr("collect_set(struct(a, b))").alias("runs"))
        .selectExpr(
            f"doc_id AS {cut_id}", f"th AS {cut_th}",
            f"array_distinct(flatten(transform(runs, r -> sequence(r.a, r.b)))) AS {places}",
        ),
        "cut-lines",
    )
    if (cut.agg(F.expr(f"sum(size({places}))")).first()[0] or 0) <= MAX_BROADCAST_LINES:
        cut = size_checked(cut, MAX_BROADCAST)
    text = F.col("text").cast("string")
    kept = (
        f"transform(array_except(sequence(0, size({split_}) - 1), {places}), i -> get({split_}, i))"
    )
    out = docs.join(
        cut,
        docs["doc_id"].eqNullSafe(F.col(cut_id))
        & (F.xxhash64(text, F.lit(7)) == F.col(cut_th)),
        "left",
    )
    names = [c for c in docs.columns if c not in ("n_lines_cut", "emptied")]
    blank = r"(NOT text RLIKE '\\S')"
    return (
        out.withColumn(split_, F.expr(rf"IF({places} IS NULL, NULL, split(text, '\n'))"))
        .withColumn(old, F.expr(f"IF({places} IS NULL, text, array_join({kept}, '\n'))"))
        .withColumn(count, F.expr(
            f"CAST(IF({places} IS NULL, 0, size({places})) AS LONG)"))
        .drop("text")
        .withColumnRenamed(old, "text")
        .withColumn("emptied", F.expr(f"{places} IS NOT NULL AND {blank}"))
        .withColumn("text", F.expr("IF(emptied, '', text)"))
        .withColumn("n_lines_cut", F.col(count))
        .select(*names, "n_lines_cut", "emptied")
    )
