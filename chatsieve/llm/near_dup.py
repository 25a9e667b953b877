"""Near-duplicate documents by improved consistent weighted sampling.

Shingles are five words (A-Z lowered); a text of fewer words is one shingle. A
shingle weighs its count in the text times its inverse document frequency, scaled to 1 (in
every document) to 2 (in one). Frequencies are counted over all documents in ``BUCKETS``
hashed buckets, so that the table stays small. The bounded range keeps a group of copies that holds a
large share of all rows together: what its members share is common, yet weighs at least half of
what tells them apart.

For each of ``BANDS * ROWS`` hash functions a text draws one shingle so that
two texts draw the same with a chance equal to their weighted Jaccard
similarity. Texts that agree in all rows of a band meet in a bucket. At the
threshold 0.8 a pair misses all ten bands of three rows with chance 0.0008.

Equal word lists are one node from the start. Buckets of up to ``SMALL`` nodes are compared whole.
In larger ones every node meets the centre: the node whose buckets hold most nodes, which is
the original of spread-out variants, since its samples are the ones that most of them share.
This joins most copies of a large bucket. What is left is done without a loss, in two steps:

- Nodes of large buckets that still hold more than one component are dealt by their rarest shingles:
  those that come before 0.8 of the text's weight is left. Two texts that reach the threshold share
  one of them (the prefix filter), and texts that only share a passage do not. Groups are
  compared as buckets were.
- Nodes of such groups that still are large and hold more than one component are compared with all others of
  their family (groups with common nodes), two blocks of bounded size at a time, by a product of
  matrices. Only members of the most frequent component are not compared with one another.

So any two texts that meet in a bucket and reach the threshold get one class, whatever the
size of their bucket; only the samples' own chance to meet in none stays.

A pair is linked if its weighted Jaccard similarity, or the plain one of its shingles, is 0.8 or more; both
are worked out from the texts. Only pairs whose sizes rule out both are not looked into: the smaller
text has less than 0.8 of the weight, and of the number of shingles, of the larger. Links make components (transitive), and later steps compare only nodes of different components.

The class of a document is the least ``doc_id`` of its component.

Edge cases. NULL texts and texts without words have no shingle: each such row is
a class of its own (its ``doc_id``). Repeated rows share a class, of which
``keep_one`` keeps one row. NULL ids stand before others. Other columns are ignored
by ``classes``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.arrays import CHUNK_BYTES, Words, chunks, mix
from chatsieve.llm.tables import keep, keyed, same_key, size_checked

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
BUCKETS = 1 << 18
# Groups of so few nodes are compared whole; in others every node meets the centre.
SMALL = 32
# About as many nodes and bytes of text are in a block of a family.
BLOCK_NODES, BLOCK_BYTES = 256, 4_000_000
# Columns of the matrices of two blocks at a time.
COLUMNS = 2048
# Nodes whose keys are broadcast to fetch their texts; with more they are joined by shuffle.
MAX_BROADCAST = 1_000_000
# Pairs whose texts are taken from a batch at a time.
PAIRS = 256
_U = np.uint64

# Quantiles of Gamma(2, 1), at the middle of each of 65536 steps, from a fine table of its
# distribution function 1 - (1 + x) exp(-x).
_X = np.concatenate((np.geomspace(1e-6, 0.01, 20_000), np.linspace(0.01, 30, 400_000)[1:]))
_Q = (np.arange(65536) + 0.5) / 65536
GAMMA = np.interp(_Q, 1 - (1 + _X) * np.exp(-_X), _X).astype(np.float32)
LOG_GAMMA = np.log(GAMMA)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, text number, count; by text."""
    h, doc = words.grams(SHINGLE)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _U(40)).astype(np.int64) & (BUCKETS - 1)


def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per bucket in one partition; bucket -1 counts all documents."""
    total = np.zeros(BUCKETS, np.int64)
    docs = 0
    for batch in batches:
        for _, texts in chunks(batch.column("text")):
            words = Words(texts)
            h, doc, _ = shingles(words)
            pairs = np.unique(doc * BUCKETS + bucket(h))
            total += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
            docs += int((words.count > 0).sum())
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict(
        {"bucket": np.append(at, -1).astype(np.int32), "n": np.append(total[at], docs)}
    )


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per bucket, and all documents that have words. ``BUCKETS`` numbers."""
    counts = keep(
        docs.select("text").mapInArrow(bucket_counts, "bucket INT, n LONG")
        .groupBy("bucket").agg(F.sum("n").alias("n")), "frequencies",
    ).toArrow()
    df = np.zeros(BUCKETS + 1)
    # Bucket -1, the number of documents, is the last.
    df[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return df[:-1], df[-1]


def idf_table(docs: DataFrame) -> np.ndarray:
    """Weight of each bucket, from 1 to 2, from all documents. ``BUCKETS`` numbers."""
    df, n_docs = frequencies(docs)
    n_docs = max(n_docs, 1.0)
    idf = np.log((1 + n_docs) / (1 + np.minimum(df, n_docs)))
    return (1 + idf / np.log(1 + n_docs)).astype(np.float32)


def samples(h: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of the sample (shingle, level) of each text and hash function.

    ``first`` is where each text's shingles begin; result: texts x functions.
    """
    log_w = np.log(weight).astype(np.float32)
    sizes = np.diff(np.append(first, len(h)))
    out = np.empty((len(first), BANDS * ROWS), _U)
    place = np.arange(len(h))
    for k in range(BANDS * ROWS):
        z = mix(h + _U((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        r = GAMMA[z & _U(0xFFFF)]
        log_c = LOG_GAMMA[(z >> _U(16)) & _U(0xFFFF)]
        beta = ((z >> _U(32)).astype(np.uint32) >> np.uint32(8)).astype(np.float32)
        beta /= np.float32(1 << 24)
        level = np.floor(log_w / r + beta)
        log_a = log_c - r * (level - beta) - r
        least = np.minimum.reduceat(log_a, first)
        at = np.where(log_a == np.repeat(least, sizes), place, len(h))
        win = np.minimum.reduceat(at, first)
        out[:, k] = mix(h[win] ^ mix(level[win].astype(np.int64).view(_U) + _U(k)))
    return out


def signatures(
    idf: np.ndarray, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """``node`` (16 bytes that stand for the word list, NULL without words), ``bands`` (one
    key per band), ``heft`` (weight of all shingles) and ``kinds`` (number of distinct ones), beside
    ``doc_id`` and ``th``."""
    for batch in batches:
        done = 0
        for _, coded in chunks(batch.column("text")):
            words = Words(coded)
            h, doc, n = shingles(words)
            some = np.flatnonzero(words.count)
            keys = np.zeros((len(coded), BANDS), _U)
            weight = n * idf[bucket(h)].astype(np.float64)
            if len(h):
                first = np.searchsorted(doc, some)
                drawn = samples(h, weight, first)
                for b in range(BANDS):
                    key = np.full(len(some), b, _U)
                    for r in range(ROWS):
                        key = mix(key * _U(31) + drawn[:, b * ROWS + r])
                    keys[some, b] = key
            node = [None] * len(coded)
            if len(some):
                at = np.arange(len(words.hash), dtype=_U) - words.first[words.doc].astype(_U)
                one = np.add.reduceat(mix(words.hash + at), words.first[some])
                two = np.add.reduceat(mix(words.hash ^ mix(at + _U(99))), words.first[some])
                for i, pair in zip(some, np.stack((one, two), 1)):
                    node[i] = pair.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(done, len(coded)),
                    batch.column("th").slice(done, len(coded)),
                    pa.array(node, pa.binary()),
                    pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                    pa.array(np.bincount(doc, weight, len(coded)).astype(np.float64)),
                    pa.array(np.bincount(doc, minlength=len(coded)).astype(np.int64)),
                ],
                ["doc_id", "th", "node", "bands", "heft", "kinds"],
            )
            done += len(coded)


def similarity(
    idf: np.ndarray, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Weighted and plain Jaccard similarity of texts ``ta`` and ``tb``; keeps ``a, b``
    of pairs of which either reaches the threshold."""
    parts = (b.slice(i, PAIRS) for b in batches for i in range(0, b.num_rows, PAIRS))
    for batch in parts:
        left, right = (batch.column(c).to_pylist() for c in ("ta", "tb"))
        both = [t for pair in zip(left, right) for t in pair]
        good = np.zeros(len(left), bool)
        # Groups must not part a pair: encode pairs as wholes.
        size = start = 0
        cuts = []
        for i in range(len(left)):
            size += len(left[i]) + len(right[i])
            if size > CHUNK_BYTES:
                cuts.append((start, i + 1))
                start, size = i + 1, 0
        cuts.append((start, len(left)))
        for lo, hi in cuts:
            if lo == hi:
                continue
            coded = [t.encode("utf-8", "surrogatepass") for t in both[2 * lo : 2 * hi]]
            h, doc, n = shingles(Words(coded))
            w = n * idf[bucket(h)].astype(np.float64)
            pair, side = doc // 2, doc % 2
            order = np.lexsort((side, h, pair))
            h, pair, w, side = h[order], pair[order], w[order], side[order]
            twin = np.zeros(len(h), bool)
            twin[:-1] = (h[:-1] == h[1:]) & (pair[:-1] == pair[1:])
            at = np.flatnonzero(twin)
            for x in (w, np.ones(len(w))):
                inner = np.bincount(pair[at], np.minimum(x[at], x[at + 1]), hi - lo)
                whole = np.bincount(pair, x, hi - lo)
                good[lo:hi] |= inner >= (THRESHOLD - 1e-9) * (whole - inner)
        keep_ = pa.array(good)
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).filter(keep_) for c in ("a", "b")], ["a", "b"]
        )


def measured(groups: DataFrame) -> DataFrame:
    """Per group ``g``: its size ``n``, whether it is ``mixed`` (has two labels or more), its most
    frequent label ``lead`` and ``others``, the number of nodes with another."""
    return (
        groups.groupBy("g", "label").agg(F.count("*").alias("same"))
        .groupBy("g").agg(
            F.sum("same").alias("n"), (F.count("*") > 1).alias("mixed"),
            F.expr("max(struct(same, label)) AS top"),
        )
        .selectExpr("g", "n", "mixed", "top.label AS lead", "n - top.same AS others")
    )


def candidates(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of nodes with different labels to compare in ``groups`` (``g, node,
    label, weight``): all of a small group, and those with the centre of a large one."""
    rows = groups.join(sizes.where("mixed").select("g", "n"), "g")
    whole = (
        rows.where(f"n <= {SMALL}").groupBy("g")
        .agg(F.sort_array(F.collect_list(F.struct("node", "label"))).alias("x"))
        .selectExpr("explode(flatten(transform(x, (p, i) -> transform(filter(slice(x, i + 2, size(x)),"
                    " q -> q.label <> p.label), q -> struct(p.node AS a, q.node AS b))))) AS pair")
        .select("pair.a", "pair.b")
    )
    large = rows.where(f"n > {SMALL}")
    centres = keep(
        large.groupBy("g").agg(F.expr("max(struct(weight, node, label))").alias("c"))
        .selectExpr("g", "c.node AS centre", "c.label AS led"), "centres",
    )
    star = (
        large.select("g", "node", "label").join(centres, "g").where("label <> led")
        .selectExpr("least(centre, node) AS a", "greatest(centre, node) AS b")
    )
    return whole.union(star).distinct()


def linked(pairs: DataFrame, extents: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """Those of ``pairs`` that are near-duplicates; texts are fetched only for pairs whose sizes
    leave it open."""
    part = THRESHOLD - 1e-6
    likely = keep(
        pairs.join(extents.selectExpr("node AS a", "heft AS wa", "kinds AS na"), "a")
        .join(extents.selectExpr("node AS b", "heft AS wb", "kinds AS nb"), "b")
        .where(f"least(wa, wb) >= {part} * greatest(wa, wb) OR least(na, nb) >= {part} * greatest(na, nb)")
        .select("a", "b"), "likely",
    )
    return keep(
        likely.join(texts.selectExpr("node AS a", "text AS ta"), "a")
        .join(texts.selectExpr("node AS b", "text AS tb"), "b")
        .mapInArrow(partial(similarity, idf), "a BINARY, b BINARY"),
        "links",
    )


def rare_shingles(
    idf: np.ndarray, df: np.ndarray, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """``g, node, weight``: the rarest shingles ``g`` of each text, one row for each.

    All texts order their shingles by ``df`` and hash. Taken are those from which on a text has no
    less than the threshold's part of its weight, and of its number of shingles: if two texts have none
    of these in common, what they have in common is less than that. Shingles of one text only are left out.
    """
    for batch in batches:
        for done, coded in chunks(batch.column("text")):
            h, doc, n = shingles(Words(coded))
            seen = df[bucket(h)]
            order = np.lexsort((h, seen, doc))
            h, doc, n, seen = h[order], doc[order], n[order], seen[order]
            first = np.searchsorted(doc, np.arange(len(coded)))
            taken = np.zeros(len(h), bool)
            for x in (n * idf[bucket(h)].astype(np.float64), np.ones(len(h))):
                sums = np.concatenate(([0.0], np.cumsum(x)))
                before = sums[:-1] - sums[first[doc]]
                whole = np.bincount(doc, x, len(coded))[doc]
                taken |= whole - before >= (THRESHOLD - 1e-6) * whole
            at = np.flatnonzero(taken & (seen > 1))
            nodes, weights = (batch.column(c).take(pa.array(done + doc[at])) for c in ("node", "weight"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[at].view(np.int64)), nodes, weights], ["g", "node", "weight"]
            )


def levels(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of texts, each as often as it occurs: key, text number, hash, whether it is the first."""
    parts = []
    for done, coded in chunks(texts):
        h, doc, n = shingles(Words(coded))
        level = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        h = np.repeat(h, n)
        parts.append((mix(h + mix(level.astype(_U))), done + np.repeat(doc, n), h, level == 0))
    return tuple(np.concatenate(x) for x in zip(*parts))


def spanning(idf: np.ndarray, block: pa.Table) -> pa.Table:
    """Links ``a, b`` between two blocks (or in one) that connect what similar texts of different
    labels connect: as many as it takes, from all pairs."""
    block = block.combine_chunks().sort_by("node")
    side = block.column("block").to_numpy()
    left = np.flatnonzero(side == block.column("lo")[0].as_py())
    right = np.flatnonzero(side == block.column("hi")[0].as_py())
    n = len(side)
    key, doc, h, once = levels(block.column("text").combine_chunks())
    weight = idf[bucket(h)].astype(np.float64)
    # Similarity by weight, and by number of shingles.
    measures = (weight, once.astype(np.float64))
    whole = [np.bincount(doc, x, n) for x in measures]
    inner = [np.zeros((len(left), len(right))) for _ in measures]
    order = np.argsort(key, kind="stable")
    new = np.diff(key[order], prepend=~key[order[:1]]) != 0
    column = np.cumsum(new) - 1
    # Only what several texts have counts.
    several = np.bincount(column)[column] > 1
    order, column = order[several], column[several]
    column = np.unique(column, return_inverse=True)[1]
    for lo in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        some = slice(*np.searchsorted(column, (lo, lo + COLUMNS)))
        at, of = order[some], column[some] - lo
        has = np.zeros((n, int(of.max()) + 1))
        has[doc[at], of] = 1
        for x, sums in zip(measures, inner):
            each = np.zeros(has.shape[1])
            each[of] = x[at]
            sums += (has[left] * each) @ has[right].T
    good = np.zeros(inner[0].shape, bool)
    for sums, size in zip(inner, whole):
        good |= sums >= (THRESHOLD - 1e-9) * (size[left][:, None] + size[right][None, :] - sums)
    node, label = (block.column(c).to_pylist() for c in ("node", "label"))
    names = np.unique(np.array(label, object), return_inverse=True)[1]
    good &= names[left][:, None] != names[right][None, :]
    links = []
    for i, j in zip(*np.nonzero(good)):
        i, j = left[i], right[j]
        if names[i] != names[j]:
            names[names == names[j]] = names[i]
            links.append((min(node[i], node[j]), max(node[i], node[j])))
    return pa.table(
        [pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"]
    )


def block_links(groups: DataFrame, large: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """Links ``a, b`` that finish the ``large`` groups: all nodes of a family of groups are compared
    but those of its most frequent label with one another."""
    rows = keep(groups.join(large.select("g"), "g").select("g", "node", "label"), "left")
    firsts = rows.groupBy("g").agg(F.min("node").alias("a"))
    family = smallest_labels(rows.join(firsts, "g").selectExpr("a", "node AS b"))
    nodes = keep(
        rows.select("node", "label").distinct()
        .join(family.selectExpr("node", "label AS g"), "node").join(texts, "node"), "families",
    )
    sizes = keep(
        nodes.groupBy("g", "label").agg(
            F.count("*").alias("n"), F.expr("sum(octet_length(text)) AS bytes"))
        .groupBy("g").agg(
            F.expr("max(struct(n, label, bytes)) AS top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        .selectExpr(
            "g", "top.label AS lead",
            f"1 + greatest(top.n div {BLOCK_NODES}, top.bytes div {BLOCK_BYTES}) AS k",
            f"1 + greatest((n - top.n) div {BLOCK_NODES}, (bytes - top.bytes) div {BLOCK_BYTES}) AS k_others",
        ), "family-sizes",
    )
    sizes = size_checked(sizes, MAX_BROADCAST)
    return keep(
        nodes.join(sizes, "g")
        .selectExpr(
            "*",
            "IF(label = lead, pmod(xxhash64(node), k), k + pmod(xxhash64(node), k_others)) AS block",
            # Blocks of the most frequent label, the first k, meet only the others.
            "explode(sequence(IF(label = lead, k, 0L), k + k_others - 1)) AS met",
        )
        .selectExpr(
            "g", "least(block, met) AS lo", "greatest(block, met) AS hi", "block", "node", "label", "text"
        )
        .groupBy("g", "lo", "hi")
        .applyInArrow(lambda block: spanning(idf, block), "a BINARY, b BINARY"), "block-links",
    )


def smallest_labels(edges: DataFrame) -> DataFrame:
    """Component of each node of an edge list: ``node, label`` (least node).

    A node takes the least label of its neighbours, of itself and of the node that is its label, until
    nothing changes; the last doubles the reach of each step. Work per step is linear in the
    edges, and a node with many of them is combined map-side.
    """
    edges = edges.where("a <> b")
    both = keep(edges.union(edges.selectExpr("b", "a")).distinct(), "edges")
    labels = keep(both.groupBy("a").agg(F.expr("least(a, min(b))").alias("label")).selectExpr(
        "a AS node", "label"), "labels")
    state = None
    while True:
        now = labels.agg(F.expr("bit_xor(xxhash64(node, label))")).first()[0]
        if now == state:
            return labels
        state = now
        reach = both.union(labels.selectExpr("node", "label"))
        of = labels.selectExpr("node AS b", "label")
        labels = keep(
            reach.join(of, "b").selectExpr("a AS node", "label").union(labels)
            .groupBy("node").agg(F.min("label").alias("label")), "labels",
        )


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (as of ``smallest_labels``) after more ``links``: only the components that these
    connect are worked on, each as one node that goes by its label."""
    ends = (
        links.join(labels.selectExpr("node AS a", "label AS of_a"), "a", "left")
        .join(labels.selectExpr("node AS b", "label AS of_b"), "b", "left")
        .selectExpr("coalesce(of_a, a) AS a", "coalesce(of_b, b) AS b")
    )
    merged = smallest_labels(ends)
    new = merged.join(labels.select("node"), "node", "left_anti")
    return keep(
        labels.join(merged.selectExpr("node AS label", "label AS now"), "label", "left")
        .selectExpr("node", "coalesce(now, label) AS label").union(new), "labels",
    )


def with_labels(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``groups`` with the component of each node; a node without a link is its own. Written, as
    each step reads it several times."""
    if labels is None:
        return groups.withColumn("label", F.col("node"))
    return keep(
        groups.join(labels, "node", "left").withColumn("label", F.expr("coalesce(label, node)")),
        "groups",
    )


def members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (``doc_id, th, node``), and of each node ``class_id``, ``class_th`` (least row of
    its class), ``class_size``, ``n_links`` and ``exact``."""
    spark = docs.sparkSession
    docs = keyed(docs)
    idf = idf_table(docs)
    signed = keep(
        docs.mapInArrow(
            partial(signatures, idf),
            f"doc_id {dict(docs.dtypes)['doc_id']}, th LONG, node BINARY, bands ARRAY<LONG>,"
            " heft DOUBLE, kinds LONG",
        ),
        "signed",
    )
    nodes = keep(
        signed.where("node IS NOT NULL").groupBy("node").agg(
            F.expr("any_value(bands)").alias("bands"), F.expr("any_value(heft)").alias("heft"),
            F.expr("any_value(kinds)").alias("kinds"), F.expr("min(struct(doc_id, th))").alias("at"),
        ), "nodes",
    )
    # A key already depends on its band.
    rows = nodes.selectExpr("node", "explode(bands) AS g")
    shared = keep(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = keep(rows.join(shared, "g"), "met")
    weights = keep(met.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    groups = keep(
        met.join(weights, "node").selectExpr("g", "node", "weight", "array(g) AS keys"), "buckets"
    )
    extents = keep(nodes.join(weights, "node", "left_semi").select("node", "heft", "kinds", "at"), "extents")
    # Texts of nodes that share a bucket, each once.
    wanted = size_checked(
        extents.selectExpr("node", "at.doc_id AS doc_id", "at.th AS th"), MAX_BROADCAST
    )
    texts = keep(
        docs.join(wanted, same_key(docs, wanted))
        .groupBy("node").agg(F.expr("any_value(text)").alias("text")), "pair-texts",
    )
    links = labels = None

    def linked_by(found: DataFrame) -> DataFrame | None:
        nonlocal links, labels
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = smallest_labels(found) if labels is None else joined_labels(labels, found)
        return labels

    current = with_labels(groups, None)
    sizes = keep(measured(current), "sizes")
    pairs = keep(candidates(current, sizes), "pairs")
    current = with_labels(groups, linked_by(linked(pairs, extents, texts, idf)))
    large = keep(measured(current).where(f"mixed AND n > {SMALL}"), "large")
    if not large.isEmpty():
        hot = groups.join(large.select("g"), "g").select("node", "weight").distinct()
        hot = keep(hot.join(texts, "node"), "hot-texts")
        groups = keep(
            hot.mapInArrow(
                partial(rare_shingles, idf, frequencies(hot)[0]), "g LONG, node BINARY, weight LONG"
            ), "rare",
        )
        current = with_labels(groups, labels)
        sizes = keep(measured(current), "sizes")
        tested = pairs
        pairs = keep(candidates(current, sizes).join(tested, ["a", "b"], "left_anti"), "pairs")
        current = with_labels(groups, linked_by(linked(pairs, extents, texts, idf)))
        large = keep(measured(current).where(f"mixed AND n > {SMALL}"), "large")
        if not large.isEmpty():
            linked_by(block_links(current, large, texts, idf))
    if labels is None:
        empty = "node BINARY, label BINARY"
        labels = spark.createDataFrame([], empty)
        links = spark.createDataFrame([], "a BINARY, b BINARY")
    degree = (
        links.distinct().selectExpr("explode(array(a, b)) AS node")
        .groupBy("node").agg(F.count("*").alias("n_links"))
    )
    of_node = (
        signed.where("node IS NOT NULL").groupBy("node")
        .agg(F.expr("min(struct(doc_id, th))").alias("least"), F.count("*").alias("copies"))
        .join(labels, "node", "left").join(degree, "node", "left")
        .selectExpr("node", "least", "copies", "coalesce(label, node) AS label",
                    "coalesce(n_links, 0L) AS n_links")
    )
    of_node = keep(of_node, "nodes-labelled")
    groups = of_node.groupBy("label").agg(
        F.min("least").alias("first"), F.sum("copies").alias("class_size")
    )
    of_node = keep(
        of_node.join(groups, "label").selectExpr(
            "node", "first.doc_id AS class_id", "first.th AS class_th", "class_size", "n_links",
            "copies > 1 AS exact",
        ),
        "members",
    )
    return signed.select("doc_id", "th", "node"), of_node


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, n_links, exact``.

    ``n_links``: verified links of the document's word list to others;
    ``exact``: another document has the same words.
    """
    rows, of_node = members(docs)
    return rows.join(of_node, "node", "left").selectExpr(
        "doc_id",
        "IF(node IS NULL, doc_id, class_id) AS class_id",
        "coalesce(class_size, 1L) AS class_size",
        "coalesce(n_links, 0L) AS n_links",
        "coalesce(exact, false) AS exact",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, that with the least ``doc_id`` (and text hash, if ids
    repeat), all columns kept. Rows without words stay."""
    rows, of_node = members(docs)
    extra = keep(
        rows.join(of_node, "node").where("class_size > 1")
        .groupBy("doc_id", "th", "class_id", "class_th").agg(F.count("*").alias("n"))
        .selectExpr("doc_id AS _id", "th AS _th", "doc_id <=> class_id AND th = class_th AS stays", "n")
        .where("NOT stays OR n > 1"),
        "extra",
    )
    th = F.xxhash64(docs["text"].cast("string"), F.lit(7))

    def key(of: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(of["_id"]) & (th == of["_th"])

    gone = size_checked(extra.where("NOT stays").select("_id", "_th"), MAX_BROADCAST)
    out = docs.join(gone, key(gone), "left_anti")
    # Equal rows: only they are moved, to leave one.
    again = extra.where("stays").select("_id", "_th")
    if again.isEmpty():
        return out
    again = size_checked(again, MAX_BROADCAST)
    return out.join(again, key(again), "left_anti").unionByName(
        out.join(again, key(again), "left_semi").dropDuplicates(["doc_id", "text"])
    )
