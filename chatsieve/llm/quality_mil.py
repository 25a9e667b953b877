"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. A passage is encoded by one
layer from ``INPUTS`` measures of its bytes and from its words: each has a learned vector,
shared by the words of one of ``BUCKETS`` hashes. Gated attention gives each
passage a weight (softmax over the document of ``w (tanh(V h) * sigmoid(U h))``);
the weighted sum of the encodings is scored. All parameters are learned together
from document labels alone, in steps of about ``STEP_PASSAGES`` passages.

Bounds: learns from about ``SAMPLE`` labelled documents, drawn by hash; of one with more than
``SAMPLE_PASSAGES`` passages that many take part, spread evenly over its whole text. That is at
most 300 MB on the driver. Everything is scored, over all passages.

Edge cases. NULL and wordless texts have one passage of zeros, and get its
score. Without labels of both kinds every score is 0.5. Labels are taken per
``doc_id``, the largest if repeated, NULL ignored. NULL ids count as the
text ''. Repeated rows get equal scores. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.arrays import SPACE_TABLE, Words, chunks, mix

PASSAGE = 64
SAMPLE = 6_000
SAMPLE_PASSAGES = 256
STEP_PASSAGES = 1_024
BUCKETS = 1_024
HIDDEN, GATE = 16, 8
STEPS, RATE, DECAY = 400, 0.02, 1e-4
SEED = 42


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Bytes of one kind, counted per byte of the passage's words.
CLASSES = {
    "upper": _class(bytes(range(65, 91))),
    "digit": _class(bytes(range(48, 58))),
    "stop": _class(b".,;:"),
    "shout": _class(b"!?"),
    "symbol": _class(b"#*$%&|<>^~=_+\\/@"),
    "quote": _class(b"\"'()[]{}-"),
    "other": _class(bytes(range(128, 256))),
}
INPUTS = len(CLASSES) + 7


class Bags:
    """Passages of documents, by document: measures ``x`` and number of words ``size``, and the
    document ``doc`` of each; ``bucket``, the hash of each word, by passage."""

    def __init__(self, x: np.ndarray, doc: np.ndarray, size: np.ndarray, bucket: np.ndarray):
        self.x, self.doc, self.size, self.bucket = x, doc, size, bucket
        self.n = int(doc[-1]) + 1 if len(doc) else 0
        self.own = np.repeat(np.arange(len(doc)), size)

    def take(self, rows: np.ndarray, doc: np.ndarray) -> Bags:
        """Some passages, as documents ``doc``."""
        size = self.size[rows]
        at = np.repeat((np.cumsum(self.size) - self.size)[rows], size)
        at += np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        return Bags(self.x[rows], doc, size, self.bucket[at])


def passages(texts: list[bytes]) -> Bags:
    """Passages of texts; a text without words has one, of zeros."""
    words = Words(texts, SPACE_TABLE)
    n_docs = len(texts)
    per = np.maximum(1, -(-words.count // PASSAGE))
    doc = np.repeat(np.arange(n_docs), per)
    out = np.zeros((len(doc), INPUTS), np.float32)
    if not len(words.hash):
        return Bags(out, doc, np.zeros(len(doc), np.int64), np.zeros(0, np.uint16))
    base = np.cumsum(per) - per
    own = base[words.doc] + (np.arange(len(words.hash)) - words.first[words.doc]) // PASSAGE
    size = np.bincount(own, minlength=len(doc))
    some = np.maximum(size, 1)
    width = words.stop - words.start
    n_bytes = np.maximum(np.bincount(own, width, len(doc)), 1)
    for i, mask in enumerate(CLASSES.values()):
        sums = np.concatenate(([0], np.cumsum(mask[words.data])))
        out[:, i] = np.bincount(own, sums[words.stop] - sums[words.start], len(doc)) / n_bytes
    at = len(CLASSES)
    h = words.hash
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    pairs = np.unique(mix(h + mix(own.astype(np.uint64))), return_index=True)[1]
    lines = np.searchsorted(np.flatnonzero(words.data == 10), words.start)
    turn = np.zeros(len(h), bool)
    turn[1:] = lines[1:] != lines[:-1]
    alone = np.isin(words.data[words.start], np.frombuffer(b"|#*$%&<>=-", np.uint8)) & (width == 1)
    mean = n_bytes / some
    spread = np.sqrt(np.maximum(np.bincount(own, width.astype(float) ** 2, len(doc)) / some - mean**2, 0))
    out[:, at] = np.bincount(own, same, len(doc)) / some
    out[:, at + 1] = np.bincount(own[pairs], minlength=len(doc)) / some
    out[:, at + 2] = mean / 10
    out[:, at + 3] = spread / 10
    out[:, at + 4] = np.bincount(own, turn, len(doc)) / some
    out[:, at + 5] = np.bincount(own, alone, len(doc)) / some
    out[:, at + 6] = np.log1p(words.count[doc]) / 10
    return Bags(out, doc, size, (words.hash % np.uint64(BUCKETS)).astype(np.uint16))


def softmax(logit: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    top = np.full(n, -np.inf)
    np.maximum.at(top, doc, logit)
    e = np.exp(logit - top[doc])
    return e / np.bincount(doc, e, n)[doc]


def sums(x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, x.shape[1]))
    np.add.at(out, doc, x)
    return out


class Attention:
    """Encoder ``E, W, e`` (measures, words, constant); gates ``V``, ``U``, ``w``; output ``c, d``."""

    def __init__(self, bags: Bags, y: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = bags.x.mean(0, dtype=float), bags.x.std(0, dtype=float) + 1e-6
        self.p = {
            "E": rng.normal(0, 0.3, (INPUTS, HIDDEN)), "W": rng.normal(0, 0.05, (BUCKETS, HIDDEN)),
            "e": np.zeros(HIDDEN),
            "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)),
            "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
        }
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step, (some, marks) in enumerate(parts(bags, y, rng), 1):
            grad = self.gradient(some, marks)
            for k, g in grad.items():
                g = g + DECAY * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= RATE * (1 - step / (STEPS + 1)) * (m[k] / (1 - 0.9**step)) / (
                    np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8
                )

    def said(self, bags: Bags) -> np.ndarray:
        """Sum of the word vectors of each passage over the root of their number."""
        out = np.zeros((len(bags.doc), HIDDEN))
        some = np.flatnonzero(bags.size)
        if len(some):
            first = (np.cumsum(bags.size) - bags.size)[some]
            total = np.add.reduceat(self.p["W"][bags.bucket], first)
            out[some] = total / np.sqrt(bags.size[some])[:, None]
        return out

    def forward(self, bags: Bags):
        p, doc, n = self.p, bags.doc, bags.n
        z = np.clip((bags.x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ p["E"] + self.said(bags) + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = softmax((t * s) @ p["w"], doc, n)
        bag = sums(a[:, None] * h, doc, n)
        return z, h, t, s, a, bag, 1 / (1 + np.exp(-(bag @ p["c"] + p["d"])))

    def gradient(self, bags: Bags, y: np.ndarray) -> dict[str, np.ndarray]:
        p, doc, n = self.p, bags.doc, bags.n
        z, h, t, s, a, bag, score = self.forward(bags)
        out = (score - y) / n
        of = out[doc]
        d_bag = of[:, None] * p["c"]
        d_a = (d_bag * h).sum(1)
        d_logit = a * (d_a - np.bincount(doc, a * d_a, n)[doc])
        d_gate = d_logit[:, None] * p["w"]
        d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
        d_h = (a[:, None] * d_bag + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - h * h)
        d_word = d_h / np.sqrt(np.maximum(bags.size, 1))[:, None]
        return {
            "E": z.T @ d_h, "e": d_h.sum(0), "V": h.T @ d_t, "U": h.T @ d_s,
            "W": np.stack([np.bincount(bags.bucket, c[bags.own], BUCKETS) for c in d_word.T], 1),
            "w": ((t * s) * d_logit[:, None]).sum(0), "c": bag.T @ out, "d": np.array([out.sum()]),
        }


def parts(
    bags: Bags, y: np.ndarray, rng: np.random.Generator
) -> Iterator[tuple[Bags, np.ndarray]]:
    """``STEPS`` groups of whole documents, of about ``STEP_PASSAGES`` passages; all documents, in a
    new order, before one comes again."""
    first = np.searchsorted(bags.doc, np.arange(len(y) + 1))
    count = np.diff(first)
    done = 0
    while True:
        order = rng.permutation(len(y))
        group = (np.cumsum(count[order]) - 1) // STEP_PASSAGES
        for some in np.split(order, np.flatnonzero(np.diff(group)) + 1):
            if done == STEPS:
                return
            done += 1
            n = count[some]
            doc = np.repeat(np.arange(len(some)), n)
            rows = first[some][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            yield bags.take(rows, doc), y[some]


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of labelled documents, for learning."""
    for batch in batches:
        marks = batch.column("quality").to_pylist()
        for begin, texts in chunks(batch.column("text")):
            bags = passages(texts)
            first = np.searchsorted(bags.doc, np.arange(len(texts) + 1))
            for i in range(len(texts)):
                n = first[i + 1] - first[i]
                some = min(n, SAMPLE_PASSAGES)
                one = bags.take(first[i] + np.arange(some) * n // some, np.zeros(some, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([marks[begin + i]], pa.int32()),
                     *(pa.array([v.tobytes()], pa.binary())
                       for v in (one.x, one.size.astype(np.uint8), one.bucket))],
                    ["y", "x", "size", "bucket"],
                )


def scored(
    model: Attention | None, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in chunks(batch.column("text")):
            n = len(texts)
            score = np.full(n, 0.5) if model is None else model.forward(passages(texts))[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(begin, n) for c in ("doc_id", "held_out")] + [pa.array(score)],
                ["doc_id", "held_out", "score"],
            )


def learn(rows: DataFrame, labels: DataFrame, seed: int = SEED) -> Attention | None:
    """Model from labelled rows; ``rows``: ``doc_id, text``."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.expr("CAST(max(quality) > 0 AS INT)").alias("quality")
    )
    share = min(1.0, SAMPLE / max(marks.count(), 1))
    some = marks.where(f"pmod(xxhash64(doc_id, {seed}), 1000000) < {share * 1e6}")
    found = (
        rows.join(some, "doc_id").select("text", "quality")
        .mapInArrow(measured, "y INT, x BINARY, size BINARY, bucket BINARY").toPandas()
    )
    found = found.sort_values(["y", "x", "bucket"], kind="stable")
    y = found["y"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    x, size, bucket = (
        np.frombuffer(b"".join(found[name]), kind)
        for name, kind in (("x", np.float32), ("size", np.uint8), ("bucket", np.uint16))
    )
    doc = np.repeat(np.arange(len(y)), [len(v) for v in found["size"]])
    return Attention(Bags(x.reshape(-1, INPUTS), doc, size.astype(np.int64), bucket), y, seed)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    rows = docs.select(
        "doc_id", F.col("text").cast("string").alias("text"),
        F.expr("crc32(coalesce(CAST(doc_id AS STRING), '')) % 3 = 1").alias("held_out"),
    )
    model = learn(rows.where("NOT held_out"), labels)
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(
        partial(scored, model), f"doc_id {kind}, held_out BOOLEAN, score DOUBLE"
    ).withColumn("predicted", F.expr("CAST(score >= 0.5 AS INT)"))
