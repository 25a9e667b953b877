"""Word hashes of many texts at once, in numpy, for use inside tasks.

Texts of a batch are joined to one byte string and cut into words by a table
of bytes, without a loop over words. A word's hash is a polynomial over its
bytes, taken from running sums, and finally mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Some 60 bytes are held for each byte of a chunk.
CHUNK_BYTES = 256_000
# Texts taken out of a batch at a time.
CHUNK_TEXTS = 256

_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """Maps separators to 0 and, with ``lower``, A-Z to a-z. A NUL that is no
    separator becomes 255, which UTF-8 never has."""
    out = np.arange(256, dtype=np.uint8)
    out[0] = 255
    if lower:
        out[65:91] += 32
    out[list(separators)] = 0
    return out


WORD_TABLE = byte_table(
    bytes(b for b in range(128) if not chr(b).isalnum()), lower=True
)
SPACE_TABLE = byte_table(b" \t\n\v\f\r", lower=False)


class Words:
    """Words of texts: ``hash``, byte ``start`` and ``stop``, ``doc``; and per
    text ``first`` and ``count`` of its words, ``begin`` and ``end`` bytes."""

    def __init__(self, texts: list[bytes], table: np.ndarray = WORD_TABLE):
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.begin = np.cumsum(sizes + 1) - sizes
        self.end = self.begin + sizes
        self.data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        plain = table[self.data]
        inside = np.concatenate(([False], plain != 0, [False]))
        # The line feed between texts is 0 in every table: no word spans two texts.
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.stop = edge[::2], edge[1::2]
        power = np.full(len(plain), _PRIME, _U)
        power[0] = 1
        power = np.multiply.accumulate(power)
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[plain] * power)))
        back = np.full(len(plain), _INVERSE, _U)
        back[0] = 1
        back = np.multiply.accumulate(back)
        self.hash = mix((sums[self.stop] - sums[self.start]) * back[self.start])
        self.first = np.searchsorted(self.start, self.begin)
        self.count = np.searchsorted(self.start, self.end) - self.first
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def within(self, mask: np.ndarray) -> np.ndarray:
        """Number of bytes of each text for which ``mask`` is true."""
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)))
        return sums[self.end] - sums[self.begin]

    def text(self, word: int) -> bytes:
        return self.data[self.start[word] : self.stop[word]].tobytes()

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``n`` consecutive words and their texts' numbers; a text of
        fewer words, but not none, has one gram of all its words."""
        h, doc, size = self.hash, self.doc, len(self.hash)
        if not size:
            return h, doc
        out = np.zeros(size, _U)
        for i in range(min(n, size)):
            part = mix(h[i:] + _U(i + 1)) * _U(2 * i + 3)
            same = doc[i:] == doc[: size - i]
            out[: size - i] += np.where(same, part, _U(0))
        at = np.arange(size) - self.first[doc]
        ok = (at + n <= self.count[doc]) | (at == 0)
        return mix(out[ok]), doc[ok]


def chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Encoded texts of a column in groups of about ``CHUNK_BYTES``, with the first's number. A
    longer text is a group alone. NULL counts as empty. Few texts leave the column at a time."""
    group: list[bytes] = []
    size = begin = 0
    for at in range(0, len(column), CHUNK_TEXTS):
        for i, text in enumerate(column.slice(at, CHUNK_TEXTS).to_pylist(), at):
            coded = (text or "").encode("utf-8", "surrogatepass")
            if group and size + len(coded) > CHUNK_BYTES:
                yield begin, group
                group, size, begin = [], 0, i
            group.append(coded)
            size += len(coded)
    if group:
        yield begin, group
