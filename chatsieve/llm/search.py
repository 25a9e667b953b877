"""Ranked lexical search of many queries at once, with shared work done once.

Every item (query) is a set of terms; a document's score for it is the sum of its
terms' shares. Items have terms in common, so sums are shared:

1. Terms that occur in exactly the same items always appear together: each such
   shared set is one base node of the query-sharing graph.
2. The nodes of an item are put in order of how many items use them. The pair of
   neighbours that most items share becomes a node of its own, in rounds, until
   no pair is shared; each round is linear in the lists. What is left of an item's list is
   its last node. The result is a directed acyclic graph.
3. Per batch of documents, an accumulator (one partial score per document) is made
   once for each node, from its two children, and freed after its last use.

Documents are read twice. The first pass counts words where the texts are and writes
``n`` and the query terms of every document; its sums give N, L and the document
frequencies. The second scores written rows against the graph, and a task sends on no
more than the ``k`` best documents of each item. Neither pass shuffles a text.

The graph of at most ``BLOCK_TERMS`` pairs of item and term, or of one item, goes to the
tasks; more items are worked on in blocks, each against all documents.

Edge cases. NULL texts, and texts without a term, are no documents of the collection. Items
without a term have no rows, and terms that no document holds add nothing. Equal rows of
``items`` count once; different texts under one id are ranked apart. Equal rows of ``docs`` are
documents each. Equal scores go by ``doc_id``, a NULL id last. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial, reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatsieve.llm.tables import keep, lowered, split_words

K = 50
BLOCK_TERMS = 500_000
PIECE_BYTES = 1_000_000
CELLS = 2_000_000
LAST_ID = np.iinfo(np.int64).max

# Separators become spaces and A-Z small letters; bytes from 128 on are parts of words.
_WORD_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32
    for b in range(256)
)
_SPACE = b" "


def count_terms(text: str) -> Counter:
    """Terms of a text and how often each occurs, in pieces cut between terms."""
    data = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    if len(data) <= PIECE_BYTES:
        return Counter(data.split())
    counts: Counter = Counter()
    begin = 0
    while begin < len(data):
        end = data.find(_SPACE, begin + PIECE_BYTES)
        end = len(data) if end < 0 else end
        counts.update(data[begin:end].split())
        begin = end
    return counts


def postings(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Per document: its number of terms, and the query terms with their counts."""
    known = vocabulary.keys()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, text in zip(part.column(0), part.column(1)):
                found = count_terms(text.as_py() or "")
                if not found:
                    continue
                ids.append(doc_id.as_py())
                sizes.append(found.total())
                held = [(vocabulary[t], found[t]) for t in found.keys() & known]
                terms.append([t for t, _ in held])
                counts.append([n for _, n in held])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )


def sharing_graph(items: list[list[int]]) -> tuple[list[list[int]], list[tuple[int, int]], list[int]]:
    """The query-sharing graph of items given as lists of terms.

    Returns the terms of each base node, the two children of each further node (nodes are
    numbered on, so children come first), and the last node of each item.
    """
    users = defaultdict(list)
    for i, terms in enumerate(items):
        for t in set(terms):
            users[t].append(i)
    same = defaultdict(list)
    for t in sorted(users):
        same[tuple(users[t])].append(t)
    # The most used nodes stand first, so that items have long common stretches.
    shared = sorted(same, key=lambda u: (-len(u), u))
    base = [same[u] for u in shared]
    lists: list[list[int]] = [[] for _ in items]
    for node, u in enumerate(shared):
        for i in u:
            lists[i].append(node)
    pairs: list[tuple[int, int]] = []
    while True:
        counts = Counter(p for nodes in lists for p in zip(nodes, nodes[1:]))
        # A node joins one pair a round, the most shared one; all its uses change at once.
        chosen, taken = {}, set()
        for pair, n in sorted(counts.items(), key=lambda c: (-c[1], c[0])):
            if n < 2:
                break
            if taken.isdisjoint(pair):
                chosen[pair] = len(base) + len(pairs)
                pairs.append(pair)
                taken.update(pair)
        if not chosen:
            break
        lists = [_replaced(nodes, chosen) for nodes in lists]
    last = []
    for nodes in lists:
        node = nodes[0]
        for other in nodes[1:]:
            pairs.append((node, other))
            node = len(base) + len(pairs) - 1
        last.append(node)
    return base, pairs, last


def _replaced(nodes: list[int], chosen: dict[tuple[int, int], int]) -> list[int]:
    out, at = [], 0
    while at < len(nodes):
        pair = tuple(nodes[at : at + 2])
        if pair in chosen:
            out.append(chosen[pair])
            at += 2
        else:
            out.append(nodes[at])
            at += 1
    return out


class Best:
    """The ``k`` best documents of one item so far."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.ids = self.scores = np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.least)
        if not len(at):
            return
        ids = np.concatenate((self.ids, ids[at]))
        scores = np.concatenate((self.scores, scores[at]))
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def ranked(
    batches: Iterator[pa.RecordBatch], graph: tuple, weights: list[int], n_docs: int,
    n_terms: int, k: int,
) -> Iterator[pa.RecordBatch]:
    """The ``k`` best documents of this task for each item: ``item, doc_id, score``."""
    base, pairs, last = graph
    node_of = np.zeros(len(weights), np.int64)
    for node, terms in enumerate(base):
        node_of[terms] = node
    weight = np.array(weights, np.int64)
    uses = Counter([*last, *(child for pair in pairs for child in pair)])
    best = [Best(k) for _ in last]
    step = max(1, CELLS // (len(base) + len(pairs)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            ids, n = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            terms, tf = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            held = np.diff(part.column(2).offsets.to_numpy())
            doc = np.repeat(np.arange(part.num_rows), held)
            m = 50 + 50 * n * n_docs // n_terms
            share = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
            sums = np.zeros((len(base), part.num_rows), np.int64)
            np.add.at(sums, (node_of[terms], doc), share)
            nodes, left = list(sums), uses.copy()
            for pair in pairs:
                nodes.append(nodes[pair[0]] + nodes[pair[1]])
                for child in pair:
                    left[child] -= 1
                    if not left[child]:
                        nodes[child] = None
            for item, node in zip(best, last):
                item.add(ids, nodes[node])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.arange(len(best)), [len(b.ids) for b in best]), pa.int32()),
            pa.array(np.concatenate([b.ids for b in best]), pa.int64()),
            pa.array(np.concatenate([b.scores for b in best]), pa.int64()),
        ],
        names=["item", "doc_id", "score"],
    )


def _search_block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """``item, doc_id, score`` of the best documents of some items."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for r in rows for t in r.terms}))}
    graph = sharing_graph([[vocabulary[t] for t in r.terms] for r in rows])
    coded = {t.encode("utf-8", "surrogatepass"): i for t, i in vocabulary.items()}
    found = keep(
        docs.mapInArrow(
            partial(postings, vocabulary=coded),
            "doc_id BIGINT, n BIGINT, terms ARRAY<INT>, counts ARRAY<BIGINT>",
        ),
        "postings",
    )
    n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return found.selectExpr("0 AS item", "doc_id", "n AS score").where("false")
    weights = [0] * len(vocabulary)
    for term, df in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[term] = floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))
    score = partial(
        ranked, graph=graph, weights=weights, n_docs=n_docs, n_terms=n_terms, k=k
    )
    return found.mapInArrow(score, "item INT, doc_id BIGINT, score BIGINT")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item.

    ``docs`` has an integer ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).where("text IS NOT NULL")
    wanted = keep(
        items.selectExpr("item_id", "CAST(text AS STRING) AS text")
        .distinct()
        .selectExpr(
            "item_id",
            "xxhash64(CAST(item_id AS STRING), text) AS place",
            f"array_sort(array_distinct({split_words(lowered('text'))})) AS terms",
        )
        .where("size(terms) > 0"),
        "search-items",
    )
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_terms))
    out = []
    for block in range(n_blocks):
        rows = wanted.where(f"pmod(place, {n_blocks}) = {block}").collect()
        if not rows:
            continue
        # At most one row per item of the block.
        ids = spark.createDataFrame(
            [(i, r.item_id) for i, r in enumerate(rows)],
            f"item INT, item_id {wanted.schema['item_id'].dataType.simpleString()}",
        )
        best = _search_block(texts, rows, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out.append(best.join(F.broadcast(ids), "item"))
    if not out:
        kind = wanted.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank INT, doc_id BIGINT, score BIGINT")
    return reduce(DataFrame.unionByName, out).select(
        "item_id", "rank", F.expr(f"nullif(doc_id, {LAST_ID}L)").alias("doc_id"), "score"
    )
