"""Ranked search against a plain Python version, with edge rows and in blocks."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from chatsieve.llm import search
from tests.llm.test_edges import LONG, ROWS, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOW) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """Rows ``(item_id, rank, doc_id, score)``, equal ones in any order."""
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in {tuple(i) for i in items}:
        scored = []
        for doc, c in held:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) & c.keys()
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1):
            out.append((item, rank, doc, -score))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id BIGINT, text STRING"),
        spark.createDataFrame(items, "item_id BIGINT, text STRING"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("block_terms", [search.BLOCK_TERMS, 40])
def test_search(spark, monkeypatch, block_terms):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "ñandú", "X9"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(1000 + i, "w1 w2, W1.w3") for i in range(80)]
    items = [(i, "; ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)]
    items += [(50, "absent"), (51, None), (52, "..."), (0, "w1 w2")]
    monkeypatch.setattr(search, "CELLS", 500)
    monkeypatch.setattr(search, "PIECE_BYTES", 20)
    found = search.search(*frames(spark, docs, items), k=7, block_terms=block_terms)
    assert rows(found) == brute(docs, items, 7)


def test_odd_rows(spark):
    items = [(1, "word token"), (1, "word token"), (None, "MIT fox"), (2, None), (3, "other É 1 2")]
    found = search.search(table(spark, ROWS), frames(spark, [], items)[1])
    assert rows(found) == brute([(r[0], r[1]) for r in ROWS], items, 50)
    assert search.count_terms(LONG)[b"word"] == 30_000


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    none, no_items = frames(spark, [], [])
    empty_texts, _ = frames(spark, [(1, None), (2, ".")], [])
    for out in (search.search(none, items), search.search(docs, no_items), search.search(empty_texts, items)):
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []


def test_sharing_graph():
    rng = random.Random(8)
    items = [sorted(rng.sample(range(30), rng.randint(1, 20))) for _ in range(40)]
    base, pairs, last = search.sharing_graph(items)
    held = [Counter(terms) for terms in base]
    for a, b in pairs:
        held.append(held[a] + held[b])
    assert [held[node] for node in last] == [Counter(i) for i in items]
    # Work is shared: fewer sums than if each item added up its own terms.
    assert len(pairs) < sum(len(i) - 1 for i in items)
    assert search.sharing_graph([[0, 1], [0, 1], [2]]) == ([[0, 1], [2]], [], [0, 0, 1])
