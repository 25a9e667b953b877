"""Quality scores of conversations and of model responses.

The band limits and weights below are fixed values; sums are taken left to
right in DOUBLE, since the rounding step sees the last bit.
"""

from __future__ import annotations

from chatsieve.functions.text import py_round, quoted, ratio

# Fixed values: (upper limit, points); the last entry is for everything above.
ASSISTANT_LENGTH_BANDS = [(20, 0.0), (100, 0.1), (500, 0.2), (None, 0.3)]
TURN_BANDS = [(2, 0.0), (4, 0.1), (6, 0.15), (None, 0.2)]
SYSTEM_BONUS = 0.1
USER_LENGTH_BANDS = [(5, 0.0), (20, 0.05), (100, 0.1), (None, 0.2)]
DIVERSITY_WEIGHT, DIVERSITY_LIMIT = 0.3, 0.2
QUALITY_BUCKETS = [
    (0.4, "poor (0.0-0.4)"),
    (0.6, "fair (0.4-0.6)"),
    (0.8, "good (0.6-0.8)"),
    (None, "excellent (0.8-1.0)"),
]
RESPONSE_LENGTH_BANDS = [(10, 0.1), (50, 0.3), (500, 1.0), (1000, 0.7), (None, 0.5)]
NO_KEYWORDS_SCORE = 0.5
RESPONSE_DIVERSITY_WEIGHT = 1.2


def literal(value: float | int | str) -> str:
    """SQL literal; floats are DOUBLE, not DECIMAL."""
    if isinstance(value, str):
        return quoted(value)
    return f"{value!r}D" if isinstance(value, float) else str(value)


def banded(x: str, bands: list[tuple]) -> str:
    """Value of the first band whose upper limit exceeds ``x``; NULL for NULL."""
    *limited, (_, rest) = bands
    whens = " ".join(
        f"WHEN {x} < {literal(limit)} THEN {literal(value)}" for limit, value in limited
    )
    return f"CASE WHEN {x} IS NULL THEN NULL {whens} ELSE {literal(rest)} END"


def quality_parts() -> dict[str, str]:
    """The five parts s1..s5 of a conversation's score, from feature columns."""
    diversity = f"{ratio('n_distinct', 'n_words')} * {literal(DIVERSITY_WEIGHT)}"
    return {
        "s1": banded("mean_assistant", ASSISTANT_LENGTH_BANDS),
        "s2": banded("turns", TURN_BANDS),
        "s3": f"CASE WHEN has_system THEN {literal(SYSTEM_BONUS)} ELSE 0D END",
        "s4": banded("mean_user", USER_LENGTH_BANDS),
        "s5": (
            f"CASE WHEN n_words > 0 THEN least({literal(DIVERSITY_LIMIT)}, {diversity})"
            " ELSE 0D END"
        ),
    }


def quality() -> str:
    """Quality in [0, 1] from the parts, which are added in their order.

    It is 0 where the user or the assistant says nothing.
    """
    rounded = py_round("0D + s1 + s2 + s3 + s4 + s5", 3)
    return (
        f"CASE WHEN n_user > 0 AND n_assistant > 0 THEN least(1D, {rounded})"
        " ELSE 0D END"
    )


def quality_bucket(score: str) -> str:
    """Label of a quality score; a limit itself belongs to the upper bucket."""
    return banded(score, QUALITY_BUCKETS)


def length_score(n_chars: str) -> str:
    """Band value of a response's stripped length."""
    return banded(n_chars, RESPONSE_LENGTH_BANDS)


def keyword_coverage(lowered: str, keywords: str) -> str:
    """Share of keywords found in the lower-cased response; repeats count."""
    found = f"filter({keywords}, k -> contains({lowered}, lower(k)))"
    return (
        f"CASE WHEN size({keywords}) > 0 THEN "
        f"{ratio(f'size({found})', f'size({keywords})')} "
        f"ELSE {literal(NO_KEYWORDS_SCORE)} END"
    )


def response_diversity(ws: str) -> str:
    """Weighted share of distinct words, at most 1; 0 without words."""
    share = ratio(f"size(array_distinct({ws}))", f"size({ws})")
    return (
        f"CASE WHEN size({ws}) > 0 THEN "
        f"least(1D, {share} * {literal(RESPONSE_DIVERSITY_WEIGHT)}) ELSE 0D END"
    )
