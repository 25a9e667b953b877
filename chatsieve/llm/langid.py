"""Language identification by character language models.

One model per language: interpolated Kneser-Ney over ``ORDER`` characters. Texts
are lowered and everything but letters becomes one space. A gram is packed into
64 bits, 16 per character. Counts of the highest order come from all learning
rows; lower orders count the different characters that stand before a gram.
Probabilities of all languages are kept beside one sorted array of grams per
order, so one binary search serves all languages; grams no array has are
worked out from the weight of their context and the next lower order.

The language with the lowest cross-entropy per character wins. ``rejected`` tells
texts whose cross-entropy is above that of all but ``REJECT`` of the learning
rows of the language (calibrated on all of them); their score is halved.

All grams are kept. With more than ``MAX_GRAMS``, fewer with many languages, the model does
not fit a task and is made in blocks, by the two characters in the middle of a gram: a
block has all grams and contexts of orders 3 and 4 that its grams lead to, and those of orders 1
and 2 (at most the alphabet squared) whole. Every block scores the grams of every text that are its own, and the
sums of a text are added. Discounts and lower counts then come from aggregates over
all grams, so blocks give the same probabilities as one model.

Edge cases. NULL texts and texts without a letter give ``und`` and score 0, as
does any text if there is no learning row with a letter. Ties go to the
language that sorts first. Rows with NULL ``lang`` are not learned from. NULL
ids count as the text ''. Repeated rows count each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.tables import keep, same_key

ORDER = 4
MAX_GRAMS = 2_000_000
MAX_CELLS = 16_000_000
REJECT = 0.001
BIN = 0.01
SHARPNESS = 20.0
CHUNK_CHARS = 1_000_000
_U = np.uint64
_MASK = {n: _U((1 << 16 * n) - 1) if n < 4 else ~_U(0) for n in range(5)}


def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(texts: list[str | None], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, each text led by a space, and where texts begin.
    No two spaces are adjacent inside a text; a text without letters is one space."""
    joined = "\0".join((t or "").lower() for t in texts)
    raw = np.frombuffer(("\0" + joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    head = raw == 0
    if head.sum() != len(texts):  # a NUL inside a text
        return codes([(t or "").replace("\0", " ") for t in texts], letter)
    space = ~letter[raw]
    kept = head.copy()
    kept[1:] |= ~(space[1:] & space[:-1])
    out = np.where(space, 32, raw)[kept]
    out = np.where(out > 0xFFFF, 0xE000 + out % 0x1900, out)
    return out.astype(_U), np.flatnonzero(head[kept])


def grams(chars: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each character and the number of its text; characters
    before a text count as spaces, its leading space is no event."""
    doc = np.zeros(len(chars), np.int64)
    doc[begin[1:]] = 1
    doc = np.cumsum(doc)
    at = np.arange(len(chars)) - begin[doc]
    key = chars.copy()
    for i in range(1, ORDER):
        before = np.full(len(chars), 32, _U)
        before[i:] = chars[:-i]
        before[at < i] = 32
        key |= before << _U(16 * i)
    event = at > 0
    return key[event], doc[event]


def text_chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    size = begin = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of highest-order grams per language in one partition."""
    letter = letters()
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def fold(parts):
        keys = np.concatenate([k for k, _ in parts])
        n = np.concatenate([c for _, c in parts])
        out, at = np.unique(keys, return_inverse=True)
        return out, np.bincount(at, n).astype(np.int64)

    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for lo, hi in text_chunks(texts):
            key, doc = grams(*codes(texts[lo:hi], letter))
            names = np.array(langs[lo:hi], object)
            for lang in set(langs[lo:hi]):
                own = key[np.isin(doc, np.flatnonzero(names == lang))]
                parts = held.setdefault(lang, [])
                parts.append(np.unique(own, return_counts=True))
                if len(parts) > 8:
                    held[lang] = [fold(parts)]
    for lang, parts in held.items():
        keys, n = fold(parts)
        for i in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * len(keys[i : i + 50_000]),
                 "gram": keys[i : i + 50_000].view(np.int64), "n": n[i : i + 50_000]}
            )


def _lookup(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def discount(one: int, two: int) -> float:
    return one / (one + 2 * two) if one and two else 0.5


def middle(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each gram."""
    return (keys >> _U(16) & _U(0xFFFFFFFF)) % _U(blocks)


class Model:
    """``keys[n]``, ``prob[n]`` (grams x languages, logs), ``ctx[n]``, ``back[n]``
    (contexts of order n and the log weights of the lower order)."""

    def __init__(
        self, counts: pd.DataFrame, langs: list[str] | None = None,
        low: dict[int, pd.DataFrame] | None = None, discounts: dict[tuple[str, int], float] | None = None,
    ):
        """``counts``: ``lang, gram, n`` of the highest order. A block has only some of them; it
        needs all languages, the counts of orders 1 and 2 and the discounts of the whole."""
        self.langs = sorted(counts["lang"].unique()) if langs is None else langs
        per = []
        for lang in self.langs:
            own = counts[counts["lang"] == lang]
            keys = own["gram"].to_numpy().view(_U)
            order = np.argsort(keys)
            levels = {ORDER: (keys[order], own["n"].to_numpy()[order])}
            for n in range(ORDER - 1, 0, -1):  # continuation counts
                if low and n in low:
                    part = low[n][low[n]["lang"] == lang].sort_values("gram")
                    levels[n] = part["gram"].to_numpy().view(_U), part["n"].to_numpy()
                else:
                    levels[n] = np.unique(levels[n + 1][0] & _MASK[n], return_counts=True)
            per.append(levels)
        self.keys, self.prob, self.ctx, self.back = {}, {}, {}, {}
        size = len(self.langs)
        chars = np.unique(np.concatenate([p[1][0] for p in per]))
        self.floor = -np.log(len(chars) + 1.0)
        for n in range(1, ORDER + 1):
            keys = self.keys[n] = np.unique(np.concatenate([p[n][0] for p in per]))
            ctx = self.ctx[n] = np.unique(keys >> _U(16))
            prob, back = np.empty((len(keys), size)), np.zeros((len(ctx), size))
            for i, p in enumerate(per):
                own, c = p[n]
                of = own >> _U(16)
                heads, at = np.unique(of, return_inverse=True)
                total, kinds = np.bincount(at, c), np.bincount(at)
                if discounts is None:
                    d = discount((c == 1).sum(), (c == 2).sum())
                else:
                    d = discounts[self.langs[i], n]
                back[_lookup(ctx, heads), i] = np.log(d * kinds / total)
                seen = np.zeros(len(keys))
                seen[_lookup(keys, own)] = np.maximum(c - d, 0) / total[at]
                lower = self.lower(n, keys, i)
                prob[:, i] = np.log(seen + np.exp(back[_lookup(ctx, keys >> _U(16)), i] + lower))
            self.prob[n], self.back[n] = prob.astype(np.float32), back.astype(np.float32)

    def lower(self, n: int, keys: np.ndarray, lang: int) -> np.ndarray:
        """Log probabilities of the next lower order for grams of order ``n``."""
        if n == 1:
            return np.full(len(keys), self.floor)
        return self.prob[n - 1][_lookup(self.keys[n - 1], keys & _MASK[n - 1]), lang]

    def logs(self, keys: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Log probability of each gram in each language."""
        at = _lookup(self.keys[n], keys)
        if not len(self.keys[n]):  # a block without grams of this order
            return self.logs(keys & _MASK[n - 1], n - 1)
        out = self.prob[n][at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            ctx = _lookup(self.ctx[n], keys[miss] >> _U(16))
            back = np.where(ctx[:, None] < 0, np.float32(0), self.back[n][ctx])
            lower = self.logs(keys[miss] & _MASK[n - 1], n - 1) if n > 1 else self.floor
            out[miss] = back + lower
        return out


def log_sums(model: Model, texts: list[str | None], letter: np.ndarray, block: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each text, and sums (texts x languages) of the logs of its grams that are in
    ``block``."""
    n = len(texts)
    key, doc = grams(*codes(texts, letter))
    length = np.bincount(doc, minlength=n)
    if blocks > 1:
        own = middle(key, blocks) == _U(block)
        key, doc = key[own], doc[own]
    logs = model.logs(key)
    return length, np.stack([np.bincount(doc, logs[:, i], n) for i in range(len(model.langs))], 1)


def verdict(langs: list[str], length: np.ndarray, sums: np.ndarray) -> list[pa.Array]:
    """Best language, its entropy and score for each text."""
    mean = sums / np.maximum(length, 1)[:, None]
    top = mean.argmax(1)
    high = mean[np.arange(len(mean)), top]
    sharp = np.minimum(SHARPNESS, np.maximum(length, 1))[:, None]
    score = 1 / np.exp((mean - high[:, None]) * sharp).sum(1)
    none = length == 0
    best = np.where(none, "und", np.array(langs, object)[top])
    return [pa.array(best.tolist(), pa.string()), pa.array(-high, mask=none),
            pa.array(np.where(none, 0.0, score))]


VERDICT = ("lang_pred", "entropy", "score")


def predict(
    model: Model | None, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    letter = letters()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in text_chunks(texts):
            n = hi - lo
            if model is None:
                made = verdict(["und"], np.zeros(n), np.zeros((n, 1)))
            else:
                made = verdict(model.langs, *log_sums(model, texts[lo:hi], letter, 0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(lo, n) for c in ("doc_id", "lang", "held_out")] + made,
                ["doc_id", "lang", "held_out", *VERDICT],
            )


def block_sums(
    model: Model, block: int, blocks: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Of each text what one block gives: ``chars``, and ``s0, s1 ...`` by language."""
    letter = letters()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in text_chunks(texts):
            length, sums = log_sums(model, texts[lo:hi], letter, block, blocks)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "th")]
                + [pa.array(length, pa.int64())] + [pa.array(x, pa.float64()) for x in sums.T],
                ["doc_id", "th", "chars", *(f"s{i}" for i in range(len(model.langs)))],
            )


def block_verdicts(langs: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sums = np.stack([batch.column(f"s{i}").to_numpy() for i in range(len(langs))], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), batch.column("held_out"),
                 *verdict(langs, batch.column("chars").to_numpy(), sums)],
                ["doc_id", "lang", "held_out", *VERDICT],
            )


def gram_table(rows: DataFrame) -> DataFrame:
    """``lang, gram, n`` of the highest order, from rows with ``text`` and non-NULL ``lang``."""
    return keep(
        rows.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
        .mapInArrow(gram_counts, "lang STRING, gram LONG, n LONG")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "gram-counts",
    )


def blocks_needed(counts: DataFrame, langs: int) -> int:
    """1, or so many blocks that about half of what fits a task falls to each."""
    n, bound = counts.count(), min(MAX_GRAMS, MAX_CELLS // max(langs, 1))
    return 1 if n <= bound else 2 * -(-n // bound) + 1


def block_models(counts: DataFrame, langs: list[str], blocks: int) -> Iterator[Model]:
    """Models of all blocks, one after another."""
    levels = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):  # continuation counts
        levels[n] = keep(
            levels[n + 1].groupBy("lang", F.expr(f"gram & {int(_MASK[n])}L").alias("gram"))
            .agg(F.count("*").alias("n")),
            f"gram-counts-{n}",
        )
    discounts = {
        (r["lang"], n): discount(r["one"], r["two"])
        for n, level in levels.items()
        for r in level.groupBy("lang").agg(
            F.expr("count_if(n = 1)").alias("one"), F.expr("count_if(n = 2)").alias("two")).collect()
    }
    low = {n: levels[n].toPandas() for n in (1, 2)}
    for block in range(blocks):
        own = counts.where(f"(shiftrightunsigned(gram, 16) & 4294967295L) % {blocks} = {block}")
        yield Model(own.toPandas(), langs, low, discounts)


def learn(rows: DataFrame) -> Model | None:
    """One model of all grams, from rows with ``text`` and non-NULL ``lang``."""
    counts = gram_table(rows).toPandas()
    return Model(counts) if len(counts) else None


def scored(rows: DataFrame, kind: str) -> DataFrame:
    """``doc_id, lang, held_out, lang_pred, entropy, score`` of all rows."""
    out = f"doc_id {kind}, lang STRING, held_out BOOLEAN, lang_pred STRING, entropy DOUBLE, score DOUBLE"
    counts = gram_table(rows.where("NOT held_out"))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    blocks = blocks_needed(counts, len(langs))
    if blocks == 1:
        model = Model(counts.toPandas()) if langs else None
        return keep(rows.mapInArrow(partial(predict, model), out), "languages")
    rows = rows.withColumn("th", F.xxhash64("text", F.lit(7)))
    sums = [f"s{i}" for i in range(len(langs))]
    fields = f"doc_id {kind}, th LONG, chars LONG, " + ", ".join(f"{s} DOUBLE" for s in sums)
    parts = [
        keep(rows.select("doc_id", "th", "text").mapInArrow(partial(block_sums, model, i, blocks), fields), "block-sums")
        for i, model in enumerate(block_models(counts, langs, blocks))
    ]
    # Rows with one key have one text: the mean over rows times the blocks is the sum over blocks.
    added = reduce(DataFrame.union, parts).groupBy("doc_id", "th").agg(
        F.first("chars").alias("chars"), *(F.expr(f"avg({s}) * {blocks}").alias(s) for s in sums))
    keys = rows.select("doc_id", "th", "lang", "held_out")
    return keep(
        keys.join(added, same_key(keys, added)).select(keys["doc_id"], "lang", "held_out", "chars", *sums)
        .mapInArrow(partial(block_verdicts, langs), out),
        "languages",
    )


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, entropy,
    rejected``. Learns from rows that are not held out."""
    rows = docs.select(
        "doc_id", F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.expr("crc32(coalesce(CAST(doc_id AS STRING), '')) % 3 = 1").alias("held_out"),
    )
    out = scored(rows, dict(docs.dtypes)["doc_id"])
    limits = (
        out.where("NOT held_out AND lang = lang_pred AND entropy IS NOT NULL")
        .groupBy("lang_pred", F.expr(f"CAST(floor(entropy / {BIN}) AS INT)").alias("bin"))
        .count().toPandas()
    )
    cases = ["WHEN false THEN 0D"]
    for lang, own in limits.groupby("lang_pred"):
        own = own.sort_values("bin")
        over = own["count"].sum() - own["count"].cumsum()
        top = own["bin"][over <= REJECT * own["count"].sum()].iloc[0]
        quoted = lang.replace("\\", "\\\\").replace("'", "\\'")
        cases.append(f"WHEN lang_pred = '{quoted}' THEN {float((top + 1) * BIN)!r}D")
    return (
        out.withColumn("rejected", F.expr(f"coalesce(entropy > CASE {' '.join(cases)} END, false)"))
        .withColumn("score", F.expr("IF(rejected, score / 2, score)"))
        .select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")
    )
