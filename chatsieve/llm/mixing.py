"""Mixing sources to target weights by Poisson replication.

A source with weight ``w`` should make up the share ``w / sum(w)`` of ``total``
words; its target repetition rate is that number over the words it has. Each
document is taken as often as a Poisson variable of that mean says, which is
found by inverting the distribution at a uniform number hashed from seed,
``doc_id`` and text. Means over ``MAX_MEAN`` are a sum of several variables
with smaller means, each with a number of its own. Copies are then put in a
global random order by a hash of seed, document and copy.

Edge cases. NULL sources are a source of their own; NULL or empty texts count
as one word, so every source has a positive size. A source without a weight
gets ``default_weight``; weight 0 removes a source. Repeated rows draw the same
count each. An empty table gives an empty one. Other columns are kept; columns
named ``copy``, ``n_copies`` or ``mix_order`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.tables import keep, spare

SEED = 42
# Target weights of the registered query and the pipeline; other sources have weight 1.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5, "src3": 0.25}
MAX_MEAN = 32.0
# Steps of the inverted distribution: P(X > 200) is below 1e-80 at mean 32.
STEPS = 200
# Sources whose rates are broadcast; with more they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def uniform(*parts: str) -> str:
    """SQL of a number in [0, 1) from the MD5 of the parts: 48 bits."""
    return (
        f"CAST(conv(substring(md5(concat_ws('|', {', '.join(parts)})), 1, 12), 16, 10)"
        " AS DOUBLE) / 281474976710656D"
    )


def rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: float | None = None,
    default_weight: float = 1.0,
) -> DataFrame:
    """``source, words, rate`` of each source; ``total`` is that of the input
    by default."""
    spark = docs.sparkSession
    size = r"greatest(1, coalesce(regexp_count(CAST(text AS STRING), '\\S+'), 0))"
    sources = docs.groupBy("source").agg(F.expr(f"sum({size})").cast("double").alias("words"))
    if weights:
        given = spark.createDataFrame(
            [(k, float(v)) for k, v in weights.items()], "_name STRING, weight DOUBLE"
        )
        sources = sources.join(
            given, sources["source"].cast("string").eqNullSafe(given["_name"]), "left"
        )
    else:
        sources = sources.withColumn("weight", F.lit(None).cast("double"))
    sources = sources.withColumn("weight", F.expr(f"coalesce(weight, {default_weight}D)"))
    whole = sources.agg(F.sum("weight").alias("_w"), F.sum("words").alias("_all"))
    row = whole.first()
    goal = float(total if total is not None else row["_all"] or 0.0)
    per_weight = goal / row["_w"] if row["_w"] else 0.0
    return sources.selectExpr("source", "words", f"weight * {per_weight!r}D / words AS rate")


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: float | None = None,
    default_weight: float = 1.0,
    seed: int = SEED,
    shuffle: bool = True,
) -> DataFrame:
    """Rows of ``docs`` with ``copy`` (from 1), ``n_copies``, ``mix_order``."""
    names = [c for c in docs.columns if c not in ("copy", "n_copies", "mix_order")]
    source, draws, mean, sums = spare(docs.columns, "_source", "_draws", "_mean", "_cdf")
    # Per mean: probabilities as running sums, by the recurrence p(n) = p(n-1) m / n.
    cdf = (
        f"aggregate(sequence(1, {STEPS}),"
        f" struct(exp(-{mean}) AS p, exp(-{mean}) AS s, array(exp(-{mean})) AS sums),"
        f" (a, n) -> struct(a.p * {mean} / n AS p, a.s + a.p * {mean} / n AS s,"
        f" array_append(a.sums, a.s + a.p * {mean} / n) AS sums), a -> a.sums)"
    )
    table = keep(
        rates(docs, weights, total, default_weight)
        .selectExpr(f"source AS {source}", "rate",
                    f"CAST(greatest(1, ceil(rate / {MAX_MEAN}D)) AS INT) AS {draws}")
        .selectExpr("*", f"rate / {draws} AS {mean}")
        .selectExpr(source, draws, f"{cdf} AS {sums}"),
        "rates",
    )
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    u = uniform(f"'{seed}'", "coalesce(CAST(doc_id AS STRING), '')",
                "md5(coalesce(CAST(text AS STRING), ''))", "CAST(k AS STRING)")
    # The first n whose running sum passes u; with sums sorted, a count of the others.
    draw = f"get(transform(array({u}), v -> size(filter({sums}, s -> s <= v))), 0)"
    order = ("md5(concat_ws('|', 'order', '{}', coalesce(CAST(doc_id AS STRING), ''),"
             " CAST(copy AS STRING)))").format(seed)
    out = (
        docs.select(*names)
        .join(table, docs["source"].eqNullSafe(F.col(source)))
        .withColumn("n_copies", F.expr(
            f"CAST(aggregate(sequence(1, {draws}), 0, (n, k) -> n + {draw}) AS LONG)"))
        .where("n_copies > 0")
        .withColumn("copy", F.expr("explode(sequence(1L, n_copies))"))
        .withColumn("mix_order", F.expr(order))
        .select(*names, "copy", "n_copies", "mix_order")
    )
    if not shuffle:
        return out
    return out.repartitionByRange("mix_order").sortWithinPartitions("mix_order")
