"""Quality rules: an isolation forest over rule statistics.

Each document gets rule statistics: the shares of symbols, repeated word windows,
repeated lines, capitals and shouted or quoted marks, the mean length of words and of
lines, and the size. The forest sees how far a statistic is from the median of the rows labelled good,
and takes what all but ``ORDINARY`` of these rows stay within for equally ordinary; both are
quantiles that Spark works out over all labelled rows (all rows that pass the base rules, if no
label is good). A forest of random splits is grown on a bounded
sample of documents drawn by hash; rare combinations are isolated after few
splits, so a short mean path means an anomaly. The largest score that still
passes is calibrated on all labelled rows. Documents that fail the two base
rules are rejected anyway.

Edge cases. NULL and empty texts have no words: all counts are 0 and they
fail the base rule. Without labels of both kinds no document is rejected by
the forest. Labels are taken per ``doc_id``, the largest if repeated, NULL
ignored. Repeated rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.arrays import SPACE_TABLE, Words, chunks, mix
from chatsieve.llm.tables import keep, keyed, size_checked

TREES, SAMPLE = 64, 256
BINS = 1000
SEED = 42
MIN_WORDS = 50
# Rejected documents whose keys are broadcast; with more they are joined by shuffle.
MAX_BROADCAST = 300_000

KEY = ("doc_id", "th")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "f_symbol", "f_repeat", "f_dup", "f_upper", "f_mark", "f_word", "f_line", "f_size",
)
# Share of good rows whose statistic may be further from the median than an ordinary one.
ORDINARY = 0.001
# Accuracy of the quantiles: ranks are off by no more than 1 in so many rows.
ACCURACY = 100_000


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _class(b"#*$%&|<>")
_UPPER = _class(bytes(range(65, 91)))
_LOWER = _class(bytes(range(97, 123)))
_MARK = _class(b"!?\"'()[]{}=~^_\\/@+")
_LINE = _class(b"\n")


def repeated_words(words: Words) -> np.ndarray:
    """Words of each text in 3-word windows that its text has twice or more."""
    h, doc, n = words.hash, words.doc, len(words.hash)
    if n < 3:
        return np.zeros(len(words.count), np.int64)
    three = mix(h[:-2] + mix(h[1:-1] + mix(h[2:])))
    at = np.flatnonzero(doc[2:] == doc[:-2])
    order = at[np.lexsort((three[at], doc[at]))]
    same = (three[order[1:]] == three[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = twice.copy()
    cover[1:] |= twice[:-1]
    cover[2:] |= twice[:-2]
    return np.bincount(doc[cover], minlength=len(words.count))


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\v\f\r")]
    return len(lines) - len(set(lines))


def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for _, texts in chunks(batch.column("text")):
            words = Words(texts, SPACE_TABLE)
            data, n = words.data, words.count.astype(np.int64)
            chars = words.within((SPACE_TABLE[data] != 0) & (data & 0xC0 != 0x80))
            symbols = words.within(_SYMBOL[data])
            dup = np.fromiter(map(repeated_lines, texts), np.int64, len(texts))
            repeat = repeated_words(words)
            upper, lower = words.within(_UPPER[data]), words.within(_LOWER[data])
            lines = words.within(_LINE[data]) + 1
            some, signs = np.maximum(n, 1), np.maximum(chars, 1)
            features = (
                symbols / signs, repeat / some, dup / lines,
                upper / np.maximum(upper + lower, 1), words.within(_MARK[data]) / signs,
                chars / some, np.log1p(chars / lines), np.log1p(n),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(done, len(texts)) for c in KEY]
                + [pa.array(c, pa.int64()) for c in (n, chars, symbols, dup, repeat)]
                + [pa.array(f) for f in features],
                [*KEY, *COUNTS, *FEATURES],
            )
            done += len(texts)


def path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Trees as arrays: ``feature`` (-1: leaf), ``cut``, ``left`` child (the right
    one follows it), ``length`` of the path at a leaf."""

    def __init__(self, rows: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        size = min(SAMPLE, len(rows))
        depth = int(np.ceil(np.log2(max(size, 2))))
        self.norm = path_norm(size) or 1.0
        self.trees = []
        for _ in range(TREES):
            part = rows[rng.choice(len(rows), size, replace=False)]
            nodes: list[list[float]] = [[-1, 0, 0, 0]]
            todo = [(0, part, 0)]
            while todo:
                at, x, level = todo.pop()
                spread = np.flatnonzero(x.min(0) < x.max(0))
                if level >= depth or len(x) < 2 or not len(spread):
                    nodes[at] = [-1, 0, 0, level + path_norm(len(x))]
                    continue
                f = int(rng.choice(spread))
                cut = rng.uniform(x[:, f].min(), x[:, f].max())
                below = x[:, f] < cut
                nodes[at] = [f, cut, len(nodes), 0]
                todo += [(len(nodes), x[below], level + 1), (len(nodes) + 1, x[~below], level + 1)]
                nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
            tree = np.array(nodes)
            self.trees.append((tree[:, 0].astype(int), tree[:, 1], tree[:, 2].astype(int), tree[:, 3]))

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, left, length in self.trees:
            at = np.zeros(len(rows), int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[every, np.maximum(f, 0)] >= cut[at]
                at = np.where(inner, left[at] + right, at)
            total += length[at]
        return 2 ** (-total / TREES / self.norm)


def ordinary(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Median of each statistic, and the distance from it that all but ``ORDINARY`` of
    the rows stay within."""
    def quantile(exprs: list[str], share: float) -> np.ndarray:
        sql = [f"percentile_approx({e}, {share}, {ACCURACY})" for e in exprs]
        return np.array([0.0 if x is None else x for x in rows.selectExpr(*sql).first()])

    middle = quantile(list(FEATURES), 0.5)
    far = [f"abs({f} - {float(m)!r}D)" for f, m in zip(FEATURES, middle)]
    return middle, quantile(far, 1 - ORDINARY)


def oddness(rows: np.ndarray, middle: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How far statistics are from the median; what is ordinary is equal."""
    return np.maximum(np.abs(rows - middle), limit)


def forest_scores(
    forest: Forest | None, scale: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.stack([batch.column(f).to_numpy() for f in FEATURES], 1)
        rows = oddness(rows, *scale)
        score = forest.score(rows) if forest and len(rows) else np.zeros(len(rows))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in (*KEY, *COUNTS)] + [pa.array(score)],
            [*KEY, *COUNTS, "anomaly"],
        )


def best_cut(bins: dict[tuple[int, int], int]) -> float:
    """Score over which rows are rejected: the bin edge at which the share of good rows
    lost plus the share of bad rows kept is least, the highest of equals."""
    good, bad = (np.array([bins.get((q, b), 0) for b in range(BINS + 1)]) for q in (1, 0))
    if not good.sum() or not bad.sum():
        return 1.0
    lost = 1 - np.cumsum(good) / good.sum()
    kept = np.cumsum(bad) / bad.sum()
    loss = np.round(lost + kept, 12)
    best = int(np.flatnonzero(loss == loss.min()).max())
    return 1.0 if loss[best] >= 1 else (best + 1) / BINS


def judge(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id``, ``th`` (hash of the text), the counts,
    ``anomaly``, ``base_failed``, ``kept``."""
    key = f"doc_id {dict(docs.dtypes)['doc_id']}, th LONG"
    counts = ", ".join(f"{c} LONG" for c in COUNTS)
    stats = keep(
        keyed(docs).mapInArrow(
            statistics, f"{key}, {counts}, " + ", ".join(f"{f} DOUBLE" for f in FEATURES)
        ),
        "statistics",
    )
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("quality").alias("quality")
    )
    base = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words"
    passing = stats.where(f"NOT ({base})")
    good = keep(
        passing.join(marks.where("quality > 0"), "doc_id").select(*FEATURES), "good-statistics"
    )
    scale = ordinary(passing if good.isEmpty() else good)
    # Drawn by hash from documents that pass the base rules; about 8,000 rows.
    n, wanted = passing.count(), TREES * SAMPLE // 2
    share = min(1.0, wanted / max(n, 1))
    draw = f"pmod(xxhash64(th, {seed}), 1000000) < {share * 1e6}"
    sample = passing.where(draw).select(*FEATURES).toPandas().to_numpy()
    sample = oddness(sample[np.lexsort(sample.T)], *scale) if len(sample) else sample
    forest = Forest(sample, seed) if len(sample) > 1 else None
    scored = keep(
        stats.mapInArrow(partial(forest_scores, forest, scale), f"{key}, {counts}, anomaly DOUBLE")
        .withColumn("base_failed", F.expr(base)),
        "scored",
    )
    bins = (
        scored.where("NOT base_failed").join(marks, "doc_id")
        .groupBy("quality", F.expr(f"CAST(floor(anomaly * {BINS}) AS INT)").alias("bin"))
        .count().collect()
    )
    cut = best_cut({(int(r["quality"] > 0), r["bin"]): r["count"] for r in bins})
    return scored.withColumn("kept", F.expr(f"NOT base_failed AND anomaly < {cut!r}D"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without rejected rows, all columns kept."""
    bad = keep(
        judge(docs, labels).where("NOT kept").select("doc_id", "th").distinct(), "rejected"
    )
    bad = size_checked(bad, MAX_BROADCAST)
    key = F.xxhash64(docs["text"].cast("string"), F.lit(7))
    return docs.join(
        bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (key == bad["th"]), "left_anti"
    )
