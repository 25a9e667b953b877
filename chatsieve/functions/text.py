"""Text and number helpers whose results follow Python's rules."""

from __future__ import annotations

# The 29 code points that Python's str.strip and str.split treat
# as whitespace.
WHITESPACE = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009,
    0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]

# The same set as a Java pattern. Spelled out as a class of code points it
# splits text at less than a third of the speed.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def quoted(text: str) -> str:
    """A SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def strip_ws(text: str) -> str:
    """Text without whitespace at either end."""
    characters = "".join(f"\\u{point:04x}" for point in WHITESPACE)
    return f"btrim({text}, '{characters}')"


def split_words(lowered: str) -> str:
    """Whitespace-separated words of a text that is lower case already."""
    return f"filter(split({lowered}, {quoted(WHITESPACE_RUN)}), w -> w <> '')"


def words(text: str) -> str:
    """Lower-cased whitespace-separated words, in order."""
    return split_words(f"lower({text})")


def ratio(part: str, whole: str) -> str:
    """``part / whole`` as DOUBLE, NULL where ``whole`` is 0."""
    return f"(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0D))"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once.

    An expression that is used several times may be worked out at each use, and
    nested uses multiply.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def py_round(x: str, digits: int) -> str:
    """Round a DOUBLE to 1 or 3 digits as Python does: exact value, ties to even.

    Spark's ``round`` and ``bround`` work on the printed decimal, so they move
    values such as 0.0625 or 0.15 the wrong way. Here the double is taken apart
    into ``m / 2^k``. ``m <= 2^53`` leaves room for ``m * 1000`` in a BIGINT, so
    the quotient and the remainder are exact. Below 2^-10 (no tie of 1 or 3
    digits is a double there) the shift would overflow, and ``round`` is right.
    """
    if digits not in (1, 3):
        raise ValueError("py_round is exact for 1 and 3 digits only")
    ten = 10**digits
    twice_rest = "2 * (scaled_ - quot_ * unit_)"
    up = f"{twice_rest} > unit_ OR ({twice_rest} = unit_ AND quot_ % 2 = 1)"
    result = f"CAST(quot_ + CAST({up} AS BIGINT) AS DOUBLE) / {ten}D"
    exact = let(
        "unit_",
        "shiftleft(1L, CAST(52 - floor(log2(size_)) AS INT))",
        let(
            "scaled_",
            f"CAST(size_ * CAST(unit_ AS DOUBLE) AS BIGINT) * {ten}L",
            let("quot_", "scaled_ div unit_", result),
        ),
    )
    small = f"round(size_, {digits})"
    unsigned = f"CASE WHEN size_ < {2.0**-10}D THEN {small} ELSE {exact} END"
    return let("x_", x, f"{let('size_', 'abs(x_)', unsigned)} * sign(x_)")
