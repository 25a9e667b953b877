"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words is
one window. Of the word ``GRAM``-grams inside a window the one with the least
hash is its fingerprint. A document selects the same fingerprint in every
window of as many words, so each occurrence of an item window is found from
fingerprints alone. Successive windows mostly select the same one, so a document sends on
one row for each run of them, about two for nine words. Windows of documents whose fingerprint the benchmark has are then
extended to both sides, to all their words, and compared as wholes: no
pair of equal windows is lost or added.

Edge cases. NULL or wordless texts have no words and are never contaminated;
wordless items have no window. Repeated items count one by one in ``n_items``
(once per distinct id; NULL ids are not listed). Repeated documents get equal
results. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.tables import BROADCAST_BYTES, keep, keyed, lowered, same_key, size_checked, split_words

WINDOW = 13
GRAM = 6
# Fingerprints (8 bytes each) that are broadcast at once; more are taken in blocks.
BLOCK_ROWS = 2_000_000
# Keys of contaminated documents that are broadcast; more are joined by shuffle.
MAX_BROADCAST = 300_000


def _ahead(array: str, by: int) -> str:
    return f"slice({array}, {by + 1}, size({array}))"


def _pairs(a: str, b: str, by: int, what: str) -> str:
    """SQL: combine each element of ``a`` with that of ``b`` ``by`` places on."""
    return f"zip_with({a}, {_ahead(b, by)}, (x, y) -> {what}(x, y))"


def least_grams(df: DataFrame, others: list[str]) -> DataFrame:
    """``least``: the least hash of the ``GRAM``-grams in each window of ``WINDOW``
    words ``w``. Hashes ignore case, so that words need not be lowered exactly here.

    Grams of 2, 4, 6 words and least values of 2, 4, 8 grams are made of pairs.
    """
    steps = (
        ("h", "transform(w, x -> xxhash64(lower(x)))"),
        ("g2", _pairs("h", "h", 1, "xxhash64")),
        ("g4", _pairs("g2", "g2", 2, "xxhash64")),
        ("g6", _pairs("g4", "g2", 4, "xxhash64")),
        ("m2", _pairs("g6", "g6", 1, "least")),
        ("m4", _pairs("m2", "m2", 2, "least")),
        ("m8", _pairs("m4", "m4", 4, "least")),
        ("least", f"slice(m8, 1, greatest(0, size(m8) - {WINDOW - 1}))"),
    )
    for name, sql in steps:
        also = ["g2"] if name == "g4" else []
        df = df.selectExpr(*others, *also, f"{sql} AS {name}")
    return df


def window_fingerprints(df: DataFrame, n: int, others: list[str]) -> DataFrame:
    """``least`` for windows of ``n`` words; below ``WINDOW`` the window is the gram."""
    if n == WINDOW:
        return least_grams(df, others)
    return df.selectExpr(*others, "transform(w, x -> xxhash64(lower(x))) AS h").selectExpr(
        *others,
        f"IF(size(h) < {n}, array(), transform(sequence(1, size(h) - {n - 1}),"
        f" i -> xxhash64(slice(h, i, {n})))) AS least",
    )


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, item (hash of the words), n, fp, win``: distinct windows."""
    items = keep(
        benchmark.selectExpr("item_id", f"{split_words('CAST(text AS STRING)')} AS w")
        .where("size(w) > 0")
        .selectExpr("item_id", "w", f"sha2({lowered("array_join(w, ' ')")}, 256) AS item",
                    f"least(size(w), {WINDOW}) AS n"),
        "items",
    )
    parts = [
        window_fingerprints(items.where(f"n = {n}"), n, ["item_id", "item", "n", "w"])
        .selectExpr("item_id", "item", "n", "w", "posexplode(least) AS (at, fp)")
        .selectExpr("item_id", "item", "n", "fp",
                    f"{lowered("array_join(slice(w, at + 1, n), ' ')")} AS win")
        for (n,) in sorted(tuple(r) for r in items.select("n").distinct().collect())
    ]
    if not parts:
        return items.selectExpr("item_id", "item", "n", "0L AS fp", "'' AS win")
    return reduce(DataFrame.unionByName, parts).distinct()


def selected(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """``doc_id, th, fp, spot``: each run of windows with one fingerprint, once. ``spot`` holds the
    window's length ``n`` and the first words of the run's windows, from ``at`` to before ``upto``."""
    ids = ["doc_id", "th"]
    short = [n for n in lengths if n < WINDOW]
    df = docs.selectExpr(*ids, "w")
    if WINDOW in lengths:
        df = least_grams(df, [*ids, *["w"] * bool(short)]).withColumnRenamed("least", f"l{WINDOW}")
    if short:
        df = df.withColumn("h", F.expr("transform(w, x -> xxhash64(lower(x)))"))
    for n in short:
        df = df.withColumn(f"l{n}", F.expr(
            f"IF(size(h) < {n}, array(), transform(sequence(1, size(h) - {n - 1}),"
            f" i -> xxhash64(slice(h, i, {n}))))"))
    names = [f"l{n}" for n in lengths]
    starts = [
        f"filter(transform({a}, (x, i) -> IF(i > 0 AND get({a}, i - 1) = x, NULL, i)),"
        f" x -> x IS NOT NULL) AS s_{a}" for a in names
    ]
    runs = [
        f"transform(s_{a}, (s, j) -> struct(get({a}, s) AS fp, struct({n} AS n, s AS at,"
        f" coalesce(get(s_{a}, j + 1), size({a})) AS upto) AS spot))" for a, n in zip(names, lengths)
    ]
    return (
        df.selectExpr(*ids, *names, *starts)
        # Outer, as the optimizer would add a filter that works out the runs twice.
        .selectExpr(*ids, f"explode_outer(concat({', '.join(runs)})) AS run")
        .selectExpr(*ids, "run.fp AS fp", "run.spot AS spot")
    )


def candidates(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Runs of windows of a document whose fingerprint the benchmark has:
    ``doc_id, th, spots`` (see ``selected``). All lengths are found in one pass over the texts."""
    fps = keep(windows.select("fp").distinct(), "fingerprints")
    lengths = sorted(n for (n,) in windows.select("n").distinct().collect())
    of_docs = selected(docs, lengths or [WINDOW])
    blocks = 1 + fps.count() // BLOCK_ROWS
    found = [
        of_docs.join(F.broadcast(fps.where(F.pmod("fp", F.lit(blocks)) == block)), "fp", "left_semi")
        for block in range(blocks)
    ]
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy("doc_id", "th").agg(F.expr("collect_set(spot)").alias("spots"))
    )


def covered(spans: str) -> Column:
    """Words inside an array of (from, to) structs, each counted once."""
    return F.expr(
        f"aggregate(sort_array({spans}), struct(0L AS n, 0 AS reach),"
        " (a, s) -> struct(a.n + greatest(0, s.to - greatest(s.from, a.reach)) AS n,"
        " greatest(a.reach, s.to) AS reach), a -> a.n)"
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, th, n_words, n_hit, n_items,
    items_sha256, contaminated``."""
    tokens = keyed(docs).selectExpr("doc_id", "th", f"{split_words('text')} AS w")
    windows = keep(item_windows(benchmark), "item-windows")
    spots = keep(candidates(tokens, windows), "candidates")
    # A spot takes 40 bytes, its document's key and list about 100.
    size = spots.agg(F.sum(F.expr("40 * size(spots) + 100"))).first()[0] or 0
    near = F.broadcast(spots) if size <= BROADCAST_BYTES else spots
    # Extend each candidate to its whole window and count the words of every text.
    whole = (
        "flatten(transform(spots, s -> transform(sequence(s.at, s.upto - 1),"
        " i -> struct(s.n AS n, i AS at, "
        f"{lowered("array_join(slice(w, i + 1, s.n), ' ')")} AS win))))"
    )
    counts = keep(
        tokens.join(near, same_key(tokens, near), "left").select(
            tokens["doc_id"], tokens["th"], F.expr("CAST(size(w) AS LONG)").alias("n_words"),
            F.expr(whole).alias("wins"),
        ),
        "counts",
    )
    found = keep(
        counts.where("wins IS NOT NULL")
        .selectExpr("doc_id", "th", "explode(wins) AS s")
        .selectExpr("doc_id", "th", "s.n AS n", "s.at AS at", "s.win AS win")
        .join(windows.select("n", "win").distinct(), ["n", "win"]),
        "occurrences",
    )
    hit = (
        found.groupBy("doc_id", "th")
        .agg(F.expr("collect_set(struct(at AS from, at + n AS to))").alias("spans"))
        .select("doc_id", "th", covered("spans").alias("n_hit"))
    )
    # Copies of an item share their windows: find items first, then their ids.
    items = (
        found.select("doc_id", "th", "win").distinct()
        .join(windows.select("win", "item").distinct(), "win")
        .select("doc_id", "th", "item").distinct()
        .join(windows.select("item", "item_id").distinct(), "item")
        .groupBy("doc_id", "th")
        .agg(F.expr("sort_array(collect_set(CAST(item_id AS STRING)))").alias("ids"))
    )
    hits = keep(
        hit.join(items, same_key(hit, items), "left").select(
            hit["doc_id"], hit["th"], "n_hit",
            F.expr("coalesce(ids, CAST(array() AS ARRAY<STRING>))").alias("ids"),
        ),
        "hits",
    )
    return (
        counts.join(hits, same_key(counts, hits), "left")
        .select(
            counts["doc_id"], counts["th"], "n_words",
            F.expr("coalesce(n_hit, 0L)").alias("n_hit"),
            F.expr("CAST(coalesce(size(ids), 0) AS LONG)").alias("n_items"),
            F.expr("sha2(coalesce(array_join(ids, ','), ''), 256)").alias("items_sha256"),
        )
        .withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept."""
    bad = contamination(docs, benchmark).where("contaminated").select("doc_id", "th").distinct()
    bad = size_checked(keep(bad, "contaminated"), MAX_BROADCAST)
    key = F.xxhash64(docs["text"].cast("string"), F.lit(7))
    return docs.join(
        bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (key == bad["th"]), "left_anti"
    )
