"""Seeded train/eval splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.functions.keys import split_key

# Hex digits of a rank: those of two SHA-256.
RANK_DIGITS = 128
# The exact split looks at this many hex digits at a time: at most 16^3 counts
# come to the driver in each round.
DIGITS = 3
# The cut is looked up directly once no more than this many rows share a prefix.
MAX_TAIL = 10_000


def train_size(n: int, eval_ratio: float) -> int:
    """Rows of the train part, in Python's floating-point arithmetic."""
    return max(1, int(n * (1 - eval_ratio)))


def _cut(ranks: DataFrame, eval_ratio: float, max_tail: int) -> str | None:
    """The last train rank: the k-th smallest value, found by radix selection.

    Each round counts rows per next few digits below the known prefix (one
    aggregate with a bounded result) and descends into the group that holds
    the k-th row. With 16^3 groups a round, 10^11 rows need two rounds; no
    row is sorted or moved but those of the last small group. Rows that share a whole
    rank go to the same side.
    """
    prefix, k = "", None
    while True:
        below = ranks.where(F.col("rank").startswith(prefix)) if prefix else ranks
        head = F.expr(f"substring(rank, 1, {len(prefix) + DIGITS}) AS head")
        groups = below.groupBy(head).agg(F.count("*").alias("n")).collect()
        if k is None:
            n = sum(g.n for g in groups)
            k = train_size(n, eval_ratio)
            if k >= n:
                return None
        for group in sorted(groups, key=lambda g: g.head):
            if k <= group.n:
                break
            k -= group.n
        prefix = group.head
        if len(prefix) == RANK_DIGITS:
            return prefix
        if group.n <= max_tail:
            tail = ranks.where(F.col("rank").startswith(prefix))
            return tail.orderBy("rank").limit(k).agg(F.max("rank")).first()[0]


@dataclass(frozen=True)
class Cut:
    """A seeded order and where it is cut into train and eval.

    Rows rank by a seeded hash of their content and, among equal contents, by a
    seeded hash of their id; so a row's rank and side follow from its own columns.
    """

    seed: int
    # False for a ratio outside (0, 1): nothing is shuffled and all rows are train.
    shuffles: bool
    # The last train rank; None if there are no eval rows.
    last: str | None = None

    def rank(self, id_col: str, key_col: str = "key") -> str:
        return f"concat({split_key(key_col, self.seed)}, {split_key(id_col, self.seed)})"

    def with_split(self, rows: DataFrame, id_col: str, key_col: str = "key") -> DataFrame:
        """Add ``split`` to rows, row by row."""
        rank = self.rank(id_col, key_col)
        is_train = "true" if self.last is None else f"{rank} <= '{self.last}'"
        return rows.selectExpr("*", f"IF({is_train}, 'train', 'eval') AS split")


def split_cut(
    samples: DataFrame,
    id_col: str,
    key_col: str = "key",
    eval_ratio: float = 0.1,
    seed: int = 42,
    max_tail: int = MAX_TAIL,
) -> Cut:
    """The cut that makes exactly ``train_size`` rows ``train``.

    ``samples`` is read several times: hand in a written table, not a long lineage.
    """
    if not 0.0 < eval_ratio < 1.0:
        return Cut(seed, False)
    ranks = samples.selectExpr(f"{Cut(seed, True).rank(id_col, key_col)} AS rank")
    return Cut(seed, True, _cut(ranks, eval_ratio, max_tail))


def split_exact(
    samples: DataFrame,
    id_col: str,
    key_col: str = "key",
    eval_ratio: float = 0.1,
    seed: int = 42,
    max_tail: int = MAX_TAIL,
) -> DataFrame:
    """Add ``split``: exactly ``train_size`` rows are ``train``.

    ``id_col`` should be unique: rows with the same content and id share a side, so that the train
    part may be larger. NULL counts as an empty value. The result does not depend on
    partitioning. A ratio outside (0, 1) puts every row into train.
    """
    cut = split_cut(samples, id_col, key_col, eval_ratio, seed, max_tail)
    return cut.with_split(samples, id_col, key_col)


def split_hash(
    samples: DataFrame, key_col: str = "key", eval_ratio: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add ``split`` by a threshold on the seeded hash of the content.

    Row-local, and a row keeps its side as the data grows; the size of the
    parts is approximate.
    """
    if not 0.0 < eval_ratio < 1.0:
        return samples.selectExpr("*", "'train' AS split")
    head = f"CAST(conv(substring({split_key(key_col, seed)}, 1, 8), 16, 10) AS BIGINT)"
    limit = int(eval_ratio * 2**32)
    return samples.selectExpr("*", f"IF({head} < {limit}L, 'eval', 'train') AS split")
