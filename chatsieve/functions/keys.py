"""Content keys: the same messages in the same order give the same key.

Each message gets a SHA-256 digest of its role and content, read as numbers ``h``
below a prime P. A conversation's key is made of the sums of ``h * G^place mod P``, next
to its message count. Sums need no order, so the key is an ordinary
partial aggregate: a conversation with a third of all turns is combined map-side and
never gathered in one task. Places may start anywhere: the sums of turns numbered from
``low`` are those of turns numbered from 0, times ``G^low``, which is divided out at the end.

The sum of ``G^turn`` alone tells whether turns are numbered without a gap or a repeat: then, and
but for a chance of 1 in P only then, it is that of the geometric series.
"""

from __future__ import annotations

from collections.abc import Sequence

P = 2**31 - 1
G = 48271  # a primitive root of P: powers repeat after P - 1 only

# A digest is read as eight lanes of 7 hex digits (28 bits, below P).
LANES = 8
LANE_DIGITS = 7

# Powers by each half byte of the exponent.
_POWERS = [[pow(G, i << 4 * k, P) for i in range(16)] for k in range(8)]


def power(exponent: str) -> str:
    """``G^exponent mod P`` for any BIGINT, from the half bytes of the exponent; NULL
    counts as 0."""
    parts = []
    for k, table in enumerate(_POWERS):
        whole = f"pmod(coalesce({exponent}, 0L), {P - 1}L)"
        digit = f"CAST(shiftright({whole}, {4 * k}) & 15 AS INT)"
        parts.append(f"array({', '.join(f'{x}L' for x in table)})[{digit}]")
    first, *rest = parts
    for part in rest:
        first = f"({first} * {part} % {P}L)"
    return first


def to_start(low: str) -> str:
    """The factor that moves sums over turns numbered from ``low`` to numbers from 0."""
    return power(f"{P - 1}L - pmod({low}, {P - 1}L)")


def moved(total: str, factor: str) -> str:
    return f"(pmod({total}, {P}L) * {factor} % {P}L)"


def is_series(total: str, low: str, n: str) -> str:
    """Whether a sum of ``G^turn`` is that of ``n`` turns in a row from ``low``."""
    series = f"(({power(n)} + {P - 1}L) * {pow(G - 1, -1, P)}L % {P}L)"
    return f"{moved(total, to_start(low))} = {series}"


def message_digest(role: str, content: str) -> str:
    """SHA-256 of an unambiguous text: the role is preceded by its length."""
    return f"sha2(concat(CAST(length({role}) AS STRING), ':', {role}, {content}), 256)"


def lane(digest: str, i: int) -> str:
    """Lane ``i`` of a digest as BIGINT."""
    start = 1 + i * LANE_DIGITS
    return f"CAST(conv(substring({digest}, {start}, {LANE_DIGITS}), 16, 10) AS BIGINT)"


def content_key(n_messages: str, lanes: Sequence[str]) -> str:
    """Key of a whole conversation from its message count and summed lanes."""
    parts = ", ".join(f"CAST({p} AS STRING)" for p in [n_messages, *lanes])
    return f"sha2(concat_ws('|', {parts}), 256)"


def split_key(key: str, seed: int) -> str:
    """Seeded pseudo-random 64-digit hex key of a content key or an id; also of NULL."""
    return f"sha2(concat(coalesce(CAST({key} AS STRING), ''), '|{seed}'), 256)"
