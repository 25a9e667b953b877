"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines: every block-level tag ends a line, white space in a
line becomes one space. Page furniture that says what it is (scripts, styles,
menus, headers, footers, forms, elements whose class, id or role names an
advert, a notice, comments and the like) leaves nothing; but a block with such a class or id
that holds an article, main or h1 element, or over half of the page's text outside links, is
a wrapper and stays (one of reader comments only with a main or h1 element). Inside an article or main element, a class or id that has
other words too (``share-price``) drops a block only if most of its text is links, inline
elements of a line stay unless they are called adverts, and a header stays if it holds a heading. The start and the end of a
page part (article, main, ...) put ``WINDOW`` empty lines into the sequence, of other
boxes one. Text lengths are summed over windows of that many lines; a stretch
begins where the sum surges from zero and ends where it dives back to it. Main text are
all stretches that have ``BLOCK`` characters outside links in some window, and at least as many
outside links as in them; if none has, the one with most. Stretches of an article or main
element go before others, and all stretches of the same outermost such element count
together. All of their lines are kept. On pages without such an element, stretches between kept ones
stay too unless most of their text is links; so do headings right before the first, and
paragraphs without links right after the last that end like a sentence.

Edge cases. NULL and empty html, and pages without text, give ''. Unclosed
elements end where an enclosing one ends, cut-off tags are dropped. Of equal
stretches the first counts. Repeated rows get equal results. Other columns are
ignored.
"""

from __future__ import annotations

import html as codec
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
# Characters outside links in a window from which on it is a block of text.
BLOCK = 86

# HTML element and attribute names.
_RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_GONE = frozenset(
    "head nav header footer aside form button select option datalist dialog menu object canvas"
    " audio video map".split()
)
_PART = frozenset("article main body".split())
_BOX = frozenset("div section table ul ol dl figure details center".split())
_LINE = frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption blockquote pre address figcaption summary hr"
    " thead tbody tfoot hgroup".split()
)
# Elements that a wrapper holds, and of those the ones that a block of comments does not.
_PROOFS, _MARKS = frozenset(("article", "main", "h1")), frozenset(("main", "h1"))
_ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}
_ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
_COMMENTS = frozenset("comment comments reply replies respond response responses disqus".split())
# Words of a class or id that say nothing about what a block holds.
_NEUTRAL = frozenset(
    "post posts article articles site page main top bottom left right box block list item items link links"
    " section wrapper wrap container bar area inner outer body content text title message button buttons"
    " icon icons user reader form inline story stories teaser".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_WORDS = _ADVERTS | _COMMENTS | frozenset(
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe signup login sidebar side nav navbar navigation menu breadcrumb breadcrumbs"
    " header footer masthead share sharing social"
    " related recommended recommendations widget skip toolbar pagination pager copyright"
    " disclaimer".split()
)
_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu menubar".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(_RAW) + r")\b[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# Ends of sentences.
_STOPS = ".!?…。！？।؟"
_CUT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


SAYS, ADVERT, COMMENT, NAMED, MAY = 5, 4, 3, 2, 1


def called(value: str) -> int:
    """What a class or id calls an element: ``ADVERT``, ``COMMENT`` or ``NAMED`` if one of its names
    has no other words, ``MAY`` if it has, or 0."""
    found = 0
    for name in value.split():
        words = {w for w in _CUT.split(_CAMEL.sub(" ", name).lower()) if w and not w.isdigit()}
        if words.isdisjoint(_WORDS):
            continue
        if not words <= _WORDS | _NEUTRAL:
            found = max(found, MAY)
        elif words & _ADVERTS:
            found = ADVERT
        else:
            found = max(found, COMMENT if words & _COMMENTS else NAMED)
    return found


def furniture(name: str, attrs: str) -> int:
    """Whether an element says that it is not part of the article: ``SAYS``, or what its class or
    id calls it (``called``), or 0."""
    if name in _GONE:
        return SAYS
    if not attrs or name in ("html", "body", "main"):
        return 0
    may = 0
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role":
            if value.strip().lower() in _ROLES:
                return SAYS
        elif key == "hidden":
            return SAYS
        elif key == "aria-hidden":
            if value.strip().lower() == "true":
                return SAYS
        else:
            may = max(may, called(value))
    if name == "article":
        return COMMENT if may == COMMENT else 0
    return may


def text_lines(page: str) -> list[tuple[str, int, int, str]]:
    """Lines of a page: text, characters outside links, number of the outermost
    enclosing article or main element (0: none), element. Empty lines mark borders."""
    lines: list[tuple[str, int, int, str]] = []
    parts: list[str] = []
    plain = 0
    stack: list[tuple[str, bool, int, int]] = []  # name, starts a dropped element, part, box
    dropped = links = count = part = box = 0
    # Blocks that a class or id calls furniture, 0 for the page: enclosing one, whether it holds
    # an element that makes it a wrapper, characters outside links and all, whether links alone
    # drop it, which elements make it a wrapper; and the innermost one of each line.
    outer, holds, size, full, loose = [0], [True], [0], [0], [False]
    proofs: list[frozenset[str]] = [_PROOFS]
    boxes: list[int] = []

    def flush(empty: int = 0, kind: str = "") -> None:
        nonlocal plain
        text = " ".join(codec.unescape("".join(parts)).split()) if parts else ""
        if text:
            lines.append((text, plain, part, kind))
            size[box] += plain
            full[box] += max(plain, len(text))
        parts.clear()
        plain = 0
        lines.extend([("", 0, part, "")] * empty)
        boxes.extend([box] * (len(lines) - len(boxes)))

    def gap(name: str) -> int:
        return WINDOW if name in _PART else 1 if name in _BOX else 0

    def leave(at: int) -> None:
        """Close all elements from ``stack[at]`` on."""
        nonlocal dropped, links, part, box
        while len(stack) > at:
            name, gone, before, around = stack.pop()
            if gone:
                dropped -= 1
            if box != around:
                flush(0, name)
                box = around
            if not dropped and (name in _LINE or gap(name)):
                flush(gap(name), name)
            links -= name == "a"
            part = before

    done = 0
    for m in _TOKEN.finditer(page):
        if m.start() > done and not dropped:
            piece = page[done : m.start()]
            parts.append(piece)
            if not links:
                plain += len(piece)
        done = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == name:
                    leave(at)
                    break
            continue
        if name == "br":
            parts.append(" ")
        if name in _VOID:
            if name == "hr" and not dropped:
                flush()
            continue
        block = name in _LINE or name in _GONE or gap(name)
        if block and stack:
            ends = _ENDS.get(name, "").split() or (["p"] if stack[-1][0] != "p" else [])
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] in ends or stack[at][0] == "p":
                    leave(at)
                    break
                if gap(stack[at][0]) or stack[at][0] in _GONE:
                    break
        says = furniture(name, m["attrs"])
        if name == "header" and part:
            says = NAMED
        within = stack[-1][0] if stack else ""
        if block:
            gone = says == SAYS
        else:  # inline
            gone = says >= ADVERT or says > 0 and not (part and any(e[0] in _LINE for e in stack))
        around = box
        if not dropped and block:
            if says and not gone:
                flush(0, within)
                box = len(outer)
                outer.append(around)
                holds.append(False)
                size.append(0)
                full.append(0)
                loose.append(says == MAY and part > 0)
                proofs.append(
                    _HEADINGS if name == "header" else _MARKS if says == COMMENT else _PROOFS
                )
            flush(0 if gone else gap(name), within)
        stack.append((name, gone, part, around))
        dropped += gone
        links += name == "a"
        if name in _PROOFS | _HEADINGS and not dropped:
            holding = box
            while holding:
                # A comment's own parts say nothing about what is around it.
                if name not in proofs[holding]:
                    if proofs[holding] is _MARKS:
                        break
                else:
                    holds[holding] = True
                holding = outer[holding]
        if name in ("article", "main") and not dropped and not part:
            count += 1
            part = count
    if not dropped and done < len(page):
        parts.append(page[done:])
        plain += 0 if links else len(page) - done
    leave(0)
    flush()
    if len(outer) == 1:
        return lines
    for i in range(len(outer) - 1, 0, -1):
        size[outer[i]] += size[i]
        full[outer[i]] += full[i]
    stays = [True]
    for i in range(1, len(outer)):
        most = proofs[i] is not _MARKS and size[i] >= BLOCK and 2 * size[i] > size[0]
        stays.append(stays[outer[i]] and (holds[i] or most or loose[i] and 2 * size[i] >= full[i]))
    return [line for line, i in zip(lines, boxes) if stays[i]]


def main_text(page: str | None) -> str:
    lines = text_lines(page or "")
    sizes = [len(line[0]) for line in lines]
    stretches: list[tuple[int, int]] = []
    begin = None
    total = sum(sizes[: WINDOW - 1])
    for i in range(len(lines)):
        # Sum over the window that begins at line i.
        total += sizes[i + WINDOW - 1] if i + WINDOW - 1 < len(lines) else 0
        if begin is None and sizes[i]:
            begin = i  # surge
        if begin is not None and not total:
            stretches.append((begin, i))  # dive
            begin = None
        total -= sizes[i]
    if begin is not None:
        stretches.append((begin, len(lines)))
    weight: dict[tuple[int, int], int] = {}
    dense: dict[tuple[int, int], bool] = {}
    members: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for n, (a, b) in enumerate(stretches):
        part = max((p for t, _, p, _ in lines[a:b] if t), default=0)
        key = (1, part) if part else (0, n)
        plain = [line[1] for line in lines[a:b]]
        weight[key] = weight.get(key, 0) + sum(plain)
        dense[key] = dense.get(key, False) or (
            max(sum(plain[i : i + WINDOW]) for i in range(len(plain))) >= BLOCK
            and 2 * sum(plain) >= sum(sizes[a:b])
        )
        members.setdefault(key, []).append((a, b))
    if not weight:
        return ""
    named = [k for k in weight if k[0]] or list(weight)
    best = [k for k in named if dense[k]] or [max(named, key=lambda k: weight[k])]
    if not best[0][0]:
        best = widened(lines, stretches, [n for _, n in best])
    return "\n\n".join(t for k in best for a, b in members[k] for t, _, _, _ in lines[a:b] if t)


def widened(
    lines: list[tuple[str, int, int, str]], stretches: list[tuple[int, int]], kept: list[int]
) -> list[tuple[int, int]]:
    """Keys of the kept stretches, of those between them, and of the title and the closing
    paragraphs that are in boxes of their own."""
    def texts(n: int) -> list[tuple[str, int, int, str]]:
        a, b = stretches[n]
        return [line for line in lines[a:b] if line[0]]

    first, last = min(kept), max(kept)
    chosen = set(kept)
    inner = [
        n for n in range(first, last + 1)
        if n in chosen or 2 * sum(t[1] for t in texts(n)) >= sum(len(t[0]) for t in texts(n))
    ]
    while first and all(t[3] in _HEADINGS and t[1] for t in texts(first - 1)):
        first -= 1
        inner.insert(0, first)
    while last + 1 < len(stretches) and all(
        t[3] == "p" and t[1] >= len(t[0]) and t[0][-1] in _STOPS and t[0][0] not in "©(" for t in texts(last + 1)
    ):
        last += 1
        inner.append(last)
    return [(0, n) for n in inner]


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(page) for page in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"),
                 pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` (code points)."""
    kinds = dict(pages.dtypes)
    return pages.selectExpr("page_id", "url", "CAST(html AS STRING) AS html").mapInArrow(
        extract_batches,
        f"page_id {kinds['page_id']}, url {kinds['url']}, text STRING, n_chars LONG",
    )
