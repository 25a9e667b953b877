"""Plain Python versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(text, items, window=13):
    w = words(text)
    hit, found = set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(window, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(item_id)
    ids = sorted(str(i) for i in found if i is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()


def line_dedup(docs, min_words):
    """docs: (doc_id, text) with distinct ids, in order of id. Every window of every length."""
    spans = []
    for doc_id, text in docs:
        used = [(p, x, len([y for y in x.split(" ") if y])) for p, x in enumerate((text or "").split("\n"))]
        used = [u for u in used if u[2]]
        for i in range(len(used)):
            for j in range(i, len(used)):
                if sum(u[2] for u in used[i : j + 1]) >= min_words:
                    spans.append((tuple(u[1] for u in used[i : j + 1]), (doc_id, used[i][0]), range(used[i][0], used[j][0] + 1)))
    first = {}
    for run, place, _ in spans:
        first[run] = min(first.get(run, place), place)
    cut = {}
    for run, place, at in spans:
        if place > first[run]:
            cut.setdefault(place[0], set()).update(at)
    out = {}
    for doc_id, text in docs:
        if text is None:
            out[doc_id] = None
            continue
        kept = [x for p, x in enumerate(text.split("\n")) if p not in cut.get(doc_id, ())]
        joined = "\n".join(kept)
        out[doc_id] = "" if doc_id in cut and not joined.strip() else joined
    return out


def licenses(text, base):
    w = words(text)
    places = [(i, label) for phrase, label in base.items() for i in range(len(w))
              if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None),
            ",".join(sorted({label for _, label in places})))


def best_containment(text, templates):
    found = []
    for label, template in templates:
        t = set(template.split())
        for line in (text or "").split("\n"):
            found.append((len(t & set(words(line))) / len(t), label))
    return found


def rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(repeat))


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
