"""SQL of the queries that SQL can express, for DuckDB; written apart from the plans."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return (
        f"regexp_extract_all(translate(coalesce({text}, ''), '{_UP}', '{_LOW}'),"
        r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )


OP1 = f"""
WITH items AS (
  SELECT item_id, w, least(13, len(w)) AS n
  FROM (SELECT item_id, {_words('text')} AS w FROM benchmark) WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)
), docs AS (
  SELECT doc_id, {_words('text')} AS w FROM documents
), spans AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM items))
), found AS (
  SELECT doc_id, i, n, item_id FROM spans JOIN wins USING (n, win)
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def line_dedup(source: str, min_words: int) -> str:
    """Rows ``doc_id, text, n_lines_cut, emptied`` for a table of ``doc_id, text``.

    Every run of lines from any line on is compared until it has ``min_words`` words,
    and every run up to any line likewise.
    """
    return f"""
WITH lines AS (
  SELECT doc_id, pos, line, len(list_filter(string_split(line, ' '), lambda x: x <> '')) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM {source} WHERE text IS NOT NULL)
), used AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM lines WHERE n > 0
), ends AS (
  SELECT a.doc_id, a.pos AS a, min(b.pos) AS b FROM used a JOIN used b
    ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.n >= {min_words}
  GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.pos), b.pos FROM used a JOIN used b
    ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.n >= {min_words}
  GROUP BY b.doc_id, b.pos
), runs AS (
  SELECT e.doc_id, e.a, e.b, string_agg(u.line, chr(10) ORDER BY u.pos) AS run
  FROM ends e JOIN used u ON u.doc_id = e.doc_id AND u.pos BETWEEN e.a AND e.b GROUP BY ALL
), firsts AS (
  SELECT run, min((doc_id, a)) AS first FROM runs GROUP BY run
), cut AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos
  FROM runs JOIN firsts USING (run) WHERE (doc_id, a) > first
), texts AS (
  SELECT l.doc_id, count(c.pos) AS n_lines_cut,
    string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS text
  FROM lines l LEFT JOIN cut c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
), done AS (
  SELECT d.doc_id, coalesce(n_lines_cut, 0) AS n_lines_cut,
    coalesce(n_lines_cut, 0) > 0 AND NOT regexp_matches(coalesce(t.text, ''), '\\S') AS emptied,
    CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text
  FROM {source} d LEFT JOIN texts t ON d.doc_id IS NOT DISTINCT FROM t.doc_id
)
SELECT doc_id, IF(emptied, '', text) AS text, n_lines_cut, emptied FROM done
"""


def mixing(source: str, columns: str, weights: dict[str, float], seed: int) -> str:
    """Rows of ``source`` with ``copy, n_copies, mix_order``, total as in the input."""
    given = ", ".join(f"('{k}', {v!r})" for k, v in weights.items())
    return f"""
WITH RECURSIVE docs AS (
  SELECT *, greatest(1, len(regexp_extract_all(coalesce(text, ''), '\\S+'))) AS _size FROM {source}
), sizes AS (
  SELECT source, CAST(sum(_size) AS DOUBLE) AS words FROM docs GROUP BY source
), weighed AS (
  SELECT source, words, CAST(coalesce(weight, 1) AS DOUBLE) AS weight
  FROM sizes LEFT JOIN (VALUES {given}) g(name, weight) ON source = name
), rates AS (
  SELECT source, weight * ((SELECT sum(words) FROM weighed) / (SELECT sum(weight) FROM weighed))
    / words AS rate FROM weighed
), draws AS (
  SELECT source, CAST(greatest(1, ceil(rate / 32)) AS BIGINT) AS k_max,
    rate / greatest(1, ceil(rate / 32)) AS mean FROM rates
), cdf AS (
  SELECT source, 0 AS n, exp(-mean) AS p, exp(-mean) AS s, mean FROM draws
  UNION ALL
  SELECT source, n + 1, p * mean / (n + 1), s + p * mean / (n + 1), mean FROM cdf WHERE n < 200
), tables AS (SELECT source, list(s ORDER BY n) AS sums FROM cdf GROUP BY source
), numbers AS (
  SELECT d.*, t.sums,
    CAST(('0x' || substr(md5(concat_ws('|', '{seed}', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')),
      CAST(k AS VARCHAR))), 1, 12)) AS BIGINT) / 281474976710656.0 AS u
  FROM (SELECT *, unnest(range(1, k_max + 1)) AS k FROM docs JOIN draws USING (source)) d
    JOIN tables t USING (source)
), counts AS (
  SELECT doc_id, CAST(sum(len(list_filter(sums, lambda s: s <= u))) AS BIGINT) AS n_copies
  FROM numbers GROUP BY doc_id
)
SELECT {columns}, copy, n_copies,
  md5(concat_ws('|', 'order', '{seed}', CAST(doc_id AS VARCHAR), CAST(copy AS VARCHAR))) AS mix_order
FROM (SELECT d.*, n_copies, unnest(range(1, n_copies + 1)) AS copy
      FROM docs d JOIN counts USING (doc_id))
"""


_TERMS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP11 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')
    || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

# CRC-32 of an ASCII text, bit by bit: a step takes in a byte, eight more (-1) shift it out.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
  string_split(place, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END))"""

_NONE = "{'c': CAST(1000000 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}"


def _edited(state: str, cost: str, edit: str, turn: str | None = None) -> str:
    """A state's best path and one more edit."""
    kept = f"list_append({state}.r, {turn})" if turn else f"{state}.r"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {kept}}}"


def _kept(state: str, initial: str) -> str:
    path = _edited(state, "late", "K", "role || ':' || text")
    return f"CASE WHEN initial = '{initial}' THEN {path} ELSE {_NONE} END"


def _given(state: str, role: str) -> str:
    path = _edited(state, "2 + late", "R", f"'{role}:' || text")
    return f"CASE WHEN initial <> '-' THEN {path} ELSE {_NONE} END"


_FROM = {"b": [], "s": ["b"], "u": ["b", "s", "a"], "a": ["u"]}


def _through(state: str) -> str:
    """The best path into a state by an edit of the row itself."""
    role = {"u": "user", "a": "assistant"}.get(state)
    paths = [_edited(state, "3", "D"), *[_kept(o, state) for o in _FROM[state]]]
    paths += [_given(o, role) for o in _FROM[state]] if role else []
    return f"list_min([{', '.join(paths)}]) AS {state}"


_INTO_USER = ", ".join(_edited(o, "2", "I", "'user:'") for o in "bsa")

OP12 = f"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place
  FROM conversations
), kinds AS (SELECT *, {_CRC} % 20 AS kind FROM source
), damaged AS (
  SELECT conv_id, turn, IF(kind = 4, 'user', role) AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(IF(kind = 3, 2, 1))) AS again
  FROM kinds WHERE kind <> 0
), places AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn
  FROM damaged
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 'truncated' END AS fault
  FROM places
), marked AS (
  SELECT *, IF(fault = 'truncated', 1, 0) AS late, left(role, 1) AS first,
    CASE WHEN fault IN ('blank', 'duplicate') THEN '-' ELSE left(role, 1) END AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS before
  FROM faults
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || first NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0 AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}} AS b,
    {_NONE} AS s, {{'c': CAST(2 AS BIGINT), 'a': 'I', 'r': ['user:']}} AS u,
    {{'c': CAST(4 AS BIGINT), 'a': 'II', 'r': ['user:', 'assistant:']}} AS a
  FROM counted
  UNION ALL
  SELECT conv_id, i, b, s, u, list_min([a, {_edited('u', '2', 'I', "'assistant:'")}]) AS a
  FROM (
    SELECT conv_id, i, b, s, list_min([u, {_INTO_USER}]) AS u, a
    FROM (
      SELECT w.conv_id, w.i + 1 AS i, {', '.join(map(_through, 'bsua'))}
      FROM walk w JOIN marked m ON m.conv_id = w.conv_id AND m.rn = w.i + 1))
), ended AS (
  SELECT conv_id, least(b, a) AS path FROM walk JOIN counted USING (conv_id) WHERE i = n
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(path.c, 0) AS cost, coalesce(path.a, '') AS audit,
  sha256(coalesce(array_to_string(path.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counted USING (conv_id)
  LEFT JOIN ended USING (conv_id)
"""

OP13 = f"""
WITH docs AS (
  SELECT * FROM (SELECT doc_id, {_TERMS} AS terms FROM documents) WHERE len(terms) > 0
), total AS (
  SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs
), queries AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), held AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM docs)
  SEMI JOIN queries USING (term) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1)))
    AS BIGINT) AS w
  FROM held, total GROUP BY term
), sizes AS (
  SELECT doc_id, 100 - 50 + ((50 * len(terms) * n_docs) // n_terms) AS m FROM docs, total
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM queries JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id)
  GROUP BY ALL
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""

# Fixed values, as in the queries: target weights by source; others have weight 1.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5, "src3": 0.25}

ORACLE = {
    "op1_decontaminate": OP1,
    "op5_line_dedup": line_dedup("documents", 40),
    "op7_mixing": mixing("documents", "doc_id, source", WEIGHTS, 42),
    "op11_chat_format": OP11,
    "op12_repair": OP12,
    "op13_search": OP13,
}
