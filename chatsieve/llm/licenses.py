"""License scan by an exact set-similarity join of text blocks and templates.

A block is a line of a document, or a window of words anywhere in its text, over line ends,
since notices are wrapped; a window has as many words as the template divided by
``THRESHOLD``, so that marks of comment lines may stand between. Blocks and templates are sets of words. A
block matches a template if it holds at least ``THRESHOLD`` of the template's
distinct words. Words of templates are ordered by how often all documents use
them, rarest first. Three filters leave few blocks and lose none: a match holds
a word of the template's prefix (its rarest words, one more than may be
missing); it has enough template words at all; and those that remain from the
first common word on suffice. What passes is compared exactly.

Besides, ``BASE`` phrases are looked for as consecutive words over the whole
text.

Edge cases. NULL texts are empty; without words all counts are 0 and there is
no label. A repeated row is scanned again. Lines may be of any length. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.arrays import Words, chunks

THRESHOLD = 0.8

# Phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening words of public license notices, one label each.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"
            " of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under"
            " the terms of the gnu general public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0"
              " international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without"
            " modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
)

_WORDS = sorted({w for _, t in TEMPLATES for w in t.split()})


def _hashes(words: list[str]) -> np.ndarray:
    return Words([" ".join(words).encode()]).hash if words else np.zeros(0, np.uint64)


def find(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in a sorted array, -1 if absent."""
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = np.sort(_hashes(_WORDS))
    total = np.zeros(len(known), np.int64)
    for batch in batches:
        for _, texts in chunks(batch.column("text")):
            at = find(known, Words(texts).hash)
            total += np.bincount(at[at >= 0], minlength=len(known))
    yield pa.RecordBatch.from_pydict({"word": known.view(np.int64), "n": total})


class Templates:
    """Templates as sets of words in order of their frequency over all documents."""

    def __init__(self, counts: dict[int, int], threshold: float):
        words = np.array(_WORDS, object)
        h = _hashes(_WORDS)
        order = sorted(range(len(h)), key=lambda i: (counts.get(int(h.view(np.int64)[i]), 0), words[i]))
        self.rank = {words[i]: r for r, i in enumerate(order)}
        by_hash = np.argsort(h)
        self.known = h[by_hash]
        self.known_rank = np.array([self.rank[words[i]] for i in by_hash])
        self.sets, self.widths = [], []
        self.first = np.zeros(len(h), bool)  # by rank: in some template's prefix
        for label, text in TEMPLATES:
            ranks = sorted({self.rank[w] for w in text.split()})
            need = ceil(threshold * len(ranks) - 1e-9)
            prefix = ranks[: len(ranks) - need + 1]
            self.first[prefix] = True
            self.sets.append((label, ranks, need, set(prefix)))
            self.widths.append(ceil(len(text.split()) / threshold - 1e-9))
        self.least = min(need for _, _, need, _ in self.sets)
        self.base = [(_hashes(p.split()), label) for p, label in BASE.items()]

    def matches(self, block: list[int]) -> list[tuple[str, float]]:
        """Labels and containments for a block's template words, rarest first."""
        found = []
        for label, ranks, need, prefix in self.sets:
            if len(block) < need:
                continue
            own = {r: i for i, r in enumerate(ranks)}
            at = next((j for j, r in enumerate(block) if r in own), None)
            if at is None or block[at] not in prefix:
                continue
            if min(len(block) - at, len(ranks) - own[block[at]]) < need:
                continue
            common = sum(r in own for r in block[at:])
            if common >= need:
                found.append((label, common / len(ranks)))
        return found

    def windows(
        self, place: np.ndarray, rank: np.ndarray, doc: np.ndarray
    ) -> Iterator[tuple[int, str, float]]:
        """Text number, label and containment of the windows that match; ``place, rank, doc``
        of all template words, in order."""
        for (label, ranks, need, prefix), width in zip(self.sets, self.widths):
            mine, rare = np.zeros((2, len(self.first)), bool)
            mine[ranks], rare[list(prefix)] = True, True
            own = mine[rank]
            r, d = rank[own], doc[own]
            at = place[own] + d * width  # no window spans two texts
            begin = np.searchsorted(at, at - width, "right")
            rares = np.concatenate(([0], np.cumsum(rare[r])))
            last = np.flatnonzero(
                (np.arange(len(at)) - begin + 1 >= need) & (rares[1:] > rares[begin]))
            order = np.argsort(r, kind="stable")
            same = r[order[1:]] == r[order[:-1]]
            before = np.full(len(r), -1)  # where the same word stands before
            before[order[1:][same]] = order[:-1][same]
            for i in range(0, len(last), 10_000):
                end = last[i : i + 10_000]
                word = end[:, None] - np.arange(width)
                start = begin[end][:, None]
                common = ((word >= start) & (before[word] < start)).sum(1)
                for k in np.flatnonzero(common >= need):
                    yield int(d[end[k]]), label, common[k] / len(ranks)


def scan_batches(
    templates: Templates, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for _, texts in chunks(batch.column("text")):
            words, n = Words(texts), len(texts)
            h, doc = words.hash, words.doc
            n_base = np.zeros(n, np.int64)
            lo, hi = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            for phrase, label in templates.base:
                at = np.flatnonzero(h[: max(0, len(h) - len(phrase) + 1)] == phrase[0])
                for i, p in enumerate(phrase):
                    at = at[(h[at + i] == p) & (doc[at + i] == doc[at])]
                place = at - words.first[doc[at]]
                n_base += np.bincount(doc[at], minlength=n)
                np.minimum.at(lo, doc[at], place)
                np.maximum.at(hi, doc[at], place)
                for d in np.unique(doc[at]):
                    base[d].add(label)
            own = [set(b) for b in base]
            score = np.where(n_base > 0, 1.0, 0.0)
            at = find(templates.known, h)
            place = np.flatnonzero(at >= 0)
            rank = templates.known_rank[at[place]]
            breaks = np.flatnonzero(words.data == 10)
            line = np.searchsorted(breaks, words.start[place])
            # Prefix filter, then the count of distinct template words of the line.
            hit = np.isin(line, np.unique(line[templates.first[rank]]))
            pairs = np.unique(np.stack((line[hit], rank[hit]), 1), axis=0)
            owner = dict(zip(line[hit].tolist(), doc[place[hit]].tolist()))
            cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1 if len(pairs) else []
            for block in np.split(pairs, cuts) if len(pairs) else []:
                if len(block) < templates.least:
                    continue
                d = owner[int(block[0, 0])]
                for label, share in templates.matches(block[:, 1].tolist()):
                    own[d].add(label)
                    score[d] = max(score[d], share)
            for d, label, share in templates.windows(place, rank, doc[place]):
                own[d].add(label)
                score[d] = max(score[d], share)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(done, n),
                    pa.array(words.count, pa.int64()),
                    pa.array(n_base),
                    pa.array(lo, mask=none),
                    pa.array(hi, pa.int64(), mask=none),
                    pa.array([",".join(sorted(b)) for b in base]),
                    pa.array([",".join(sorted(b)) for b in own]),
                    pa.array(score),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word",
                 "base_labels", "labels", "score"],
            )
            done += n


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score`` (the largest containment; 1 for a phrase)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = (
        docs.select("text").mapInArrow(word_counts, "word LONG, n LONG")
        .groupBy("word").agg(F.sum("n").alias("n")).collect()
    )
    templates = Templates({r["word"]: r["n"] for r in counts}, threshold)
    return docs.mapInArrow(
        partial(scan_batches, templates),
        f"doc_id {dict(docs.dtypes)['doc_id']}, n_words LONG, n_base LONG, first_word LONG,"
        " last_word LONG, base_labels STRING, labels STRING, score DOUBLE",
    )
