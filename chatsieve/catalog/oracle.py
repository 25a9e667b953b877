"""The SQL equivalent of each registered query, for DuckDB.

Written from the rules, not from the Spark plans: whole word lists instead of
merged sets, ``row_number`` instead of radix selection, one message per row.
"""

from __future__ import annotations


# The 29 code points of Python's whitespace, as an RE2 class.
WHITESPACE = (
    r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

CHAT_INPUT = """
chat AS (
  SELECT conv_id, turn, role, text AS content FROM conversations
  UNION ALL SELECT conv_id + 1000000, turn, role, text
  FROM conversations WHERE conv_id % 5 = 0
  UNION ALL SELECT conv_id + 2000000, turn, role, text
  FROM conversations WHERE conv_id % 10 = 0
  UNION ALL SELECT conv_id + 3000000, turn, role, substr(text, 1, 3)
  FROM conversations WHERE conv_id % 7 = 3
  UNION ALL SELECT conv_id + 4000000, turn, CASE WHEN turn = 1 THEN 'bot' ELSE role END, text
  FROM conversations WHERE conv_id % 11 = 4
  UNION ALL SELECT conv_id + 5000000, turn, role, CASE WHEN turn <> 0 THEN text END
  FROM conversations WHERE conv_id % 13 = 6)
"""

TURN_INPUT = CHAT_INPUT.replace("chat AS", "plain AS") + """,
chat AS (
  SELECT * FROM plain
  UNION ALL SELECT conv_id + 10000000, turn + 1, role, content FROM plain WHERE conv_id % 17 = 1
  UNION ALL SELECT conv_id + 20000000, CASE WHEN turn = 1 THEN 0 ELSE turn END, role, content
  FROM plain WHERE conv_id % 19 = 2
  UNION ALL SELECT conv_id + 30000000, CASE WHEN turn > 0 THEN turn + 1 ELSE turn END, role, content
  FROM plain WHERE conv_id % 23 = 3
  UNION ALL SELECT conv_id + 40000000, CASE WHEN turn <> 0 THEN turn END, role, content
  FROM plain WHERE conv_id % 29 = 4
  UNION ALL SELECT NULL, turn, role, content FROM plain WHERE conv_id % 31 = 5)
"""

COUNTS = """
counts AS (
  SELECT conv_id, count(*) AS n_messages,
    count(*) FILTER (role = 'user') AS n_user,
    count(*) FILTER (role = 'assistant') AS n_assistant,
    count(*) FILTER (role = 'system') AS n_system,
    count(*) FILTER (role NOT IN ('system', 'user', 'assistant')
      OR content IS NULL) AS n_bad,
    count(*) - count(turn) AS n_unplaced, count(DISTINCT turn) AS n_turns,
    max(turn) - min(turn) + 1 AS span
  FROM chat GROUP BY conv_id),
valid AS (
  SELECT * FROM counts
  WHERE n_messages >= 2 AND n_bad = 0 AND n_user > 0 AND n_assistant > 0
    AND conv_id IS NOT NULL AND n_turns = n_messages AND span = n_messages)
"""


def words_sql(text: str) -> str:
    pattern = WHITESPACE + "+"
    return (
        f"list_filter(regexp_split_to_array(lower({text}), '{pattern}'), "
        "lambda w: w <> '')"
    )


def strip_sql(text: str) -> str:
    pattern = rf"\A{WHITESPACE}+|{WHITESPACE}+\z"
    return f"regexp_replace({text}, '{pattern}', '', 'g')"


def round_sql(x: str, name: str, source: str, digits: int = 3) -> str:
    """CTEs that add ``name``, the exact half-even rounding of ``x``."""
    ten = 10**digits
    return f"""
{name}_a AS (
  SELECT *, {x} AS x_, (52 - floor(log2(CASE WHEN {x} > 0 THEN {x} END)))::INT AS k_
  FROM {source}),
{name}_b AS (
  SELECT *, (1::HUGEINT << k_) AS p_,
    (x_ * (1::HUGEINT << k_)::DOUBLE)::HUGEINT * {ten} AS t_ FROM {name}_a),
{name}_c AS (
  SELECT *, CASE WHEN x_ = 0 THEN 0::DOUBLE ELSE
    (t_ // p_ + CASE WHEN 2 * (t_ % p_) > p_
      OR (2 * (t_ % p_) = p_ AND (t_ // p_) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE
    / {ten}::DOUBLE END AS {name}
  FROM {name}_b)"""


FEATURES = f"""
said AS (
  SELECT conv_id,
    string_agg(content, ' ' ORDER BY turn) FILTER (role = 'assistant') AS speech,
    sum(length(content)) FILTER (role = 'user') AS user_chars,
    sum(length(content)) FILTER (role = 'assistant') AS assistant_chars
  FROM chat GROUP BY conv_id),
features AS (
  SELECT v.*, n_user + n_assistant AS turns, n_system > 0 AS has_system,
    user_chars, assistant_chars,
    user_chars::DOUBLE / n_user::DOUBLE AS mean_user,
    assistant_chars::DOUBLE / n_assistant::DOUBLE AS mean_assistant,
    len({words_sql("speech")}) AS n_words,
    len(list_distinct({words_sql("speech")})) AS n_distinct
  FROM valid v JOIN said USING (conv_id))
"""

SCORED = f"""
parts AS (
  SELECT *,
    CASE WHEN mean_assistant < 20 THEN 0.0 WHEN mean_assistant < 100 THEN 0.1
      WHEN mean_assistant < 500 THEN 0.2 ELSE 0.3 END::DOUBLE AS s1,
    CASE WHEN turns >= 6 THEN 0.2 WHEN turns >= 4 THEN 0.15
      WHEN turns >= 2 THEN 0.1 ELSE 0.0 END::DOUBLE AS s2,
    CASE WHEN has_system THEN 0.1 ELSE 0.0 END::DOUBLE AS s3,
    CASE WHEN mean_user < 5 THEN 0.0 WHEN mean_user < 20 THEN 0.05
      WHEN mean_user < 100 THEN 0.1 ELSE 0.2 END::DOUBLE AS s4,
    CASE WHEN n_words = 0 THEN 0::DOUBLE ELSE least(0.2::DOUBLE,
      n_distinct::DOUBLE / n_words::DOUBLE * 0.3::DOUBLE) END AS s5
  FROM features),
{round_sql("(0::DOUBLE + s1 + s2 + s3 + s4 + s5)", "rounded", "parts")},
scored AS (
  SELECT *, least(1::DOUBLE, rounded) AS quality,
    CASE WHEN rounded >= 0.8::DOUBLE THEN 'excellent (0.8-1.0)'
      WHEN rounded >= 0.6::DOUBLE THEN 'good (0.6-0.8)'
      WHEN rounded >= 0.4::DOUBLE THEN 'fair (0.4-0.6)'
      ELSE 'poor (0.0-0.4)' END AS bucket
  FROM rounded_c)
"""

# The key is public (it orders the split), so it is computed here too; which
# samples are copies is decided on the messages themselves.
DEDUP = f"""
digests AS (
  SELECT conv_id, turn, sha256(length(role) || ':' || role || content) AS d FROM chat),
lanes AS (
  SELECT conv_id, count(*) AS n, {", ".join(
        f"list(('0x' || substr(d, {1 + 7 * i}, 7))::BIGINT ORDER BY turn DESC) AS l{i}"
        for i in range(8)
    )}
  FROM digests JOIN valid USING (conv_id) GROUP BY conv_id),
keys AS (
  SELECT conv_id, sha256(concat_ws('|', n, {", ".join(
        f"list_reduce(l{i}, lambda x, y: (x * 48271 + y) % 2147483647)" for i in range(8)
    )})) AS key
  FROM lanes),
contents AS (
  SELECT conv_id, list({{'r': role, 'c': content}} ORDER BY turn) AS messages
  FROM chat GROUP BY conv_id),
ranked AS (
  SELECT s.*, k.key,
    row_number() OVER (PARTITION BY c.messages ORDER BY s.conv_id) AS nth,
    count(*) OVER (PARTITION BY c.messages) AS copies
  FROM scored s JOIN keys k USING (conv_id) JOIN contents c USING (conv_id)),
deduped AS (
  SELECT *, CASE WHEN quality < 0.4::DOUBLE THEN 'low_quality'
    WHEN mean_assistant < 10 THEN 'short_assistant' END AS drop_reason
  FROM ranked WHERE nth = 1),
kept AS (SELECT * FROM deduped WHERE drop_reason IS NULL)
"""

SPLIT = """
shuffled AS (
  SELECT *, row_number() OVER (ORDER BY sha256(key || '|42'),
      sha256(conv_id || '|42')) AS place,
    greatest(1, trunc(count(*) OVER () * (1::DOUBLE - 0.1::DOUBLE))::BIGINT) AS k
  FROM kept),
parted AS (
  SELECT *, CASE WHEN place <= k THEN 'train' ELSE 'eval' END AS split FROM shuffled)
"""

# DuckDB keeps a sharp s in upper(); its capital form is two letters.
EVALUATION = f"""
rows_ AS (
  SELECT a.conv_id * 1000000 + a.turn AS pos, 'p' || ((a.conv_id + a.turn) % 40) AS name,
    q.text AS user_,
    CASE WHEN q.conv_id % 3 = 0 THEN 'Be brief.' END AS system_,
    CASE WHEN q.conv_id % 4 <> 0 THEN list_concat(
      list_transform({words_sql("a.text")}[1:3], lambda w: upper(replace(w, 'ß', 'ss'))), ['zzzz'])
      END AS keywords,
    CASE WHEN q.conv_id % 5 = 0 THEN 64 END AS max_tokens,
    CASE (a.conv_id + a.turn) % 5 WHEN 0 THEN a.text || ' ' || q.text
      WHEN 1 THEN replace(a.text, ' ', ' a ') WHEN 2 THEN ' ' ELSE a.text END AS base,
    a.text AS tuned
  FROM conversations q JOIN conversations a
    ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant')
"""


def response_parts(column: str, source: str, name: str) -> str:
    """CTE ``name`` that adds the three parts and their mean for a response."""
    words, n = words_sql(column), f"length({strip_sql(column)})"
    return f"""
{name} AS (
  SELECT *, {n} = 0 AS blank,
    CASE WHEN {n} < 10 THEN 0.1 WHEN {n} < 50 THEN 0.3 WHEN {n} < 500 THEN 1.0
      WHEN {n} < 1000 THEN 0.7 ELSE 0.5 END::DOUBLE AS length_score,
    CASE WHEN coalesce(len(keywords), 0) = 0 THEN 0.5::DOUBLE ELSE
      len(list_filter(keywords, lambda w: contains(lower({column}), lower(w))))::DOUBLE
      / len(keywords)::DOUBLE END AS coverage,
    CASE WHEN len({words}) > 0 THEN least(1::DOUBLE,
      len(list_distinct({words}))::DOUBLE / len({words})::DOUBLE * 1.2::DOUBLE)
      ELSE 0::DOUBLE END AS diversity
  FROM {source})"""


MEAN = "((length_score + coverage + diversity) / 3::DOUBLE)"

COMPARED = f"""
last_base AS (
  SELECT name, base AS response, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos DESC) AS nth
    FROM rows_) WHERE nth = 1),
paired AS (
  SELECT r.pos, r.name, r.user_, r.keywords, r.tuned, b.response AS last
  FROM rows_ r JOIN last_base b USING (name)),
{response_parts("tuned", "paired", "tuned_parts")},
{round_sql(MEAN, "tuned_r", "tuned_parts")},
tuned_scores AS (SELECT pos, CASE WHEN blank THEN 0 ELSE tuned_r END AS tuned_score FROM tuned_r_c),
{response_parts("last", "paired", "base_parts")},
{round_sql(MEAN, "base_r", "base_parts")},
base_scores AS (SELECT pos, CASE WHEN blank THEN 0 ELSE base_r END AS base_score FROM base_r_c),
compared AS (
  SELECT pos, name AS prompt_name, user_ AS user_input, last AS base_response,
    tuned AS tuned_response, base_score, tuned_score,
    round((tuned_score - base_score) * 1000)::BIGINT AS milli,
    round((tuned_score - base_score) * 1000) / 1000::DOUBLE AS improvement
  FROM paired JOIN tuned_scores USING (pos) JOIN base_scores USING (pos))
"""


def sql(select: str, *ctes: str) -> str:
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + select.strip()


_CHAT = (CHAT_INPUT,)
_TURNS = (TURN_INPUT,)
_VALID = (TURN_INPUT, COUNTS)
_SCORED = (*_VALID, FEATURES, SCORED)
_DEDUP = (*_SCORED, DEDUP)
_SPLIT = (*_DEDUP, SPLIT)
_LINE_SCORED = (CHAT_INPUT, COUNTS, FEATURES, SCORED)
_LINE_SPLIT = (*_LINE_SCORED, DEDUP, SPLIT)
_COMPARED = (EVALUATION, COMPARED)

# One line per conversation.
_LINES = """
lines AS (SELECT *, turn AS pos FROM chat)
"""
_LINE_FAULTS = """
line_faults AS (
  SELECT conv_id,
    concat_ws(',',
      CASE WHEN count(*) < 2 THEN 'too_few_messages' END,
      string_agg(concat_ws(',',
        CASE WHEN role NOT IN ('system', 'user', 'assistant')
          THEN 'invalid_role@' || pos END,
        CASE WHEN content IS NULL THEN 'content_not_string@' || pos END), ','
        ORDER BY pos) FILTER (content IS NULL
          OR role NOT IN ('system', 'user', 'assistant')),
      CASE WHEN count(*) FILTER (role = 'user') = 0 THEN 'no_user' END,
      CASE WHEN count(*) FILTER (role = 'assistant') = 0 THEN 'no_assistant' END
    ) AS errors
  FROM lines GROUP BY conv_id)
"""

ORACLE: dict[str, str] = {
    "conversation_assemble": sql(
        "SELECT conv_id, count(*) AS n_messages, "
        "string_agg(role, ',' ORDER BY turn) AS roles "
        "FROM lines GROUP BY conv_id",
        *_CHAT, _LINES,
    ),
    "conversation_explode": sql(
        "SELECT conv_id, turn, role, content FROM chat", *_CHAT
    ),
    "jsonl_scan": sql(
        "SELECT conv_id, count(*) AS n_messages, "
        "coalesce(sum(length(content)), 0)::BIGINT AS chars "
        "FROM lines GROUP BY conv_id",
        *_CHAT, _LINES,
    ),
    "jsonl_quarantine": sql(
        "SELECT conv_id, line_no, 'unclosed' AS reason FROM numbered "
        "WHERE conv_id % 17 = 5 ORDER BY conv_id LIMIT 5",
        *_CHAT, _LINES,
        """
numbered AS (
  SELECT conv_id, CAST(count(*) OVER w + sum((conv_id % 19 = 6)::INT) OVER w AS BIGINT) AS line_no
  FROM (SELECT DISTINCT conv_id FROM lines) WINDOW w AS (ORDER BY conv_id))""",
    ),
    "jsonl_counts": sql(
        "SELECT count(*) AS n_lines, "
        "count(*) FILTER (conv_id % 17 <> 5) AS n_parsed, "
        "count(*) FILTER (conv_id % 17 = 5) AS n_malformed "
        "FROM (SELECT DISTINCT conv_id FROM lines)",
        *_CHAT, _LINES,
    ),
    "jsonl_roundtrip": sql("SELECT conv_id, turn, role, content FROM chat", *_CHAT),
    "jsonl_validate": sql(
        "SELECT conv_id, errors FROM line_faults",
        *_CHAT, _LINES, _LINE_FAULTS,
    ),
    "jsonl_quality": sql(
        "SELECT conv_id, quality, bucket FROM scored", *_LINE_SCORED
    ),
    "chat_validate": sql(
        """
SELECT conv_id, 'invalid_role' || coalesce('@' || turn, '') AS error FROM chat
WHERE role NOT IN ('system', 'user', 'assistant')
UNION ALL SELECT conv_id, 'content_not_string' || coalesce('@' || turn, '') FROM chat
WHERE content IS NULL
UNION ALL SELECT NULL, 'missing_id' FROM counts WHERE conv_id IS NULL
UNION ALL SELECT conv_id, unnest(list_filter([
  CASE WHEN n_messages < 2 THEN 'too_few_messages' END, CASE WHEN n_user = 0 THEN 'no_user' END,
  CASE WHEN n_assistant = 0 THEN 'no_assistant' END, CASE WHEN n_unplaced > 0 THEN 'missing_turn' END,
  CASE WHEN span > n_turns THEN 'turn_gap' END], lambda e: e IS NOT NULL))
FROM counts WHERE conv_id IS NOT NULL
UNION ALL SELECT conv_id, 'repeated_turn@' || turn FROM chat
WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn HAVING count(*) > 1""",
        *_VALID,
    ),
    "chat_valid": sql("SELECT conv_id FROM valid", *_VALID),
    "role_messages": sql(
        "SELECT conv_id, role, count(*) AS n, sum(length(content))::BIGINT AS chars "
        "FROM chat GROUP BY conv_id, role",
        *_TURNS,
    ),
    "score_features": sql(
        "SELECT conv_id, has_system, turns, n_messages, mean_user, mean_assistant, "
        "n_words, n_distinct FROM features",
        *_VALID, FEATURES,
    ),
    "score_components": sql("SELECT conv_id, s1, s2, s3, s4, s5 FROM scored", *_SCORED),
    "quality_score": sql("SELECT conv_id, quality FROM scored", *_SCORED),
    "quality_bucket": sql("SELECT conv_id, bucket FROM scored", *_SCORED),
    "dedup_exact": sql("SELECT conv_id, key, copies FROM deduped", *_DEDUP),
    "quality_filter": sql("SELECT conv_id, quality FROM kept", *_DEDUP),
    "drop_reason": sql("SELECT conv_id, drop_reason FROM deduped", *_DEDUP),
    "dataset_stats": sql(
        """
SELECT (SELECT count(*) FROM counts) AS total_raw,
  (SELECT count(*) FROM counts) - (SELECT count(*) FROM valid) AS invalid_removed,
  (SELECT count(*) FROM valid) - (SELECT count(*) FROM deduped) AS duplicates_removed,
  (SELECT count(drop_reason) FROM deduped) AS low_quality_removed,
  (SELECT count(*) FROM kept) AS total_filtered""",
        *_DEDUP,
    ),
    "role_distribution": sql(
        "SELECT role, count(*) AS n FROM chat JOIN kept USING (conv_id) "
        "GROUP BY role ORDER BY role",
        *_DEDUP,
    ),
    "quality_histogram": sql(
        "SELECT bucket, count(*) AS n FROM deduped GROUP BY bucket ORDER BY bucket",
        *_DEDUP,
    ),
    "dataset_averages": sql(
        "SELECT coalesce(avg_turns, 0) AS avg_turns, "
        "coalesce(avg_user_length, 0) AS avg_user_length, "
        "coalesce(avg_assistant_length, 0) AS avg_assistant_length "
        "FROM avg_assistant_length_c",
        *_DEDUP,
        """
means AS (
  SELECT sum(n_messages)::DOUBLE / count(*)::DOUBLE AS m1,
    sum(user_chars)::DOUBLE / sum(n_user)::DOUBLE AS m2,
    sum(assistant_chars)::DOUBLE / sum(n_assistant)::DOUBLE AS m3 FROM kept)""",
        round_sql("m1", "avg_turns", "means", 1),
        "turns_ AS (SELECT m2, m3, avg_turns FROM avg_turns_c)",
        round_sql("m2", "avg_user_length", "turns_", 1),
        "users_ AS (SELECT m3, avg_turns, avg_user_length FROM avg_user_length_c)",
        round_sql("m3", "avg_assistant_length", "users_", 1),
    ),
    "split_exact": sql("SELECT conv_id, split FROM parted", *_SPLIT),
    "split_degenerate": sql("SELECT conv_id, 'train' AS split FROM kept", *_DEDUP),
    "split_hash": sql(
        "SELECT conv_id, CASE WHEN ('0x' || substr(sha256(key || '|42'), 1, 8))::BIGINT "
        ">= trunc(0.1::DOUBLE * 4294967296)::BIGINT THEN 'train' ELSE 'eval' END "
        "AS split FROM kept",
        *_DEDUP,
    ),
    "chat_render": """
SELECT conv_id, string_agg('<|im_start|>' || role
  || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""",
    "prepare_jsonl_dataset": sql("SELECT conv_id, split FROM parted", *_LINE_SPLIT),
    "training_order": sql(
        "SELECT conv_id, split, row_number() OVER (PARTITION BY split ORDER BY place) AS place "
        "FROM parted",
        *_LINE_SPLIT,
    ),
    "training_text": sql(
        """
SELECT conv_id, 'chatml' AS template, string_agg('<|im_start|>' || role || chr(10) || content
  || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text FROM training GROUP BY conv_id
UNION ALL
SELECT conv_id, 'inst', string_agg(CASE
    WHEN role = 'user' AND nth = 1 AND lead IS NOT NULL THEN '<s>[INST] <<SYS>>' || chr(10)
      || lead || chr(10) || '<</SYS>>' || chr(10) || chr(10) || content || ' [/INST]'
    WHEN role = 'user' THEN '<s>[INST] ' || content || ' [/INST]'
    WHEN role = 'assistant' THEN ' ' || content || ' </s>' ELSE '' END, '' ORDER BY turn)
FROM spoken GROUP BY conv_id
UNION ALL
SELECT conv_id, 'alpaca', string_agg(
    CASE WHEN nth = 1 AND lead IS NOT NULL THEN lead || chr(10) || chr(10) ELSE '' END || '### '
    || CASE role WHEN 'user' THEN 'Instruction' WHEN 'assistant' THEN 'Response' ELSE 'Note' END
    || ':' || chr(10) || content
    || CASE WHEN nth = n THEN '</s>' ELSE chr(10) || chr(10) END, '' ORDER BY turn)
FROM spoken GROUP BY conv_id""",
        *_LINE_SPLIT,
        """
training AS (
  SELECT conv_id, turn, role, content,
    first_value(CASE WHEN role = 'system' THEN content END)
      OVER (PARTITION BY conv_id ORDER BY turn) AS lead,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place
  FROM chat JOIN parted USING (conv_id) WHERE split = 'train'),
spoken AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM training WHERE NOT (place = 1 AND role = 'system'))""",
    ),
    "stream_dataset": sql(
        "SELECT key, CASE WHEN ('0x' || substr(sha256(key || '|42'), 1, 8))::BIGINT "
        ">= trunc(0.1::DOUBLE * 4294967296)::BIGINT THEN 'train' ELSE 'eval' END "
        "AS split FROM kept",
        *_LINE_SCORED, DEDUP,
    ),
    "prepare_dataset": sql(
        "SELECT conv_id, quality, bucket, split FROM parted", *_SPLIT
    ),
    "prompt_validate": sql(
        """
SELECT pos, name, coalesce(system_, '') AS system, coalesce(max_tokens, 256) AS max_tokens,
  coalesce(len(keywords), 0) AS n_keywords,
  CASE WHEN pos % 9 = 0 THEN 'missing_user' END AS error FROM rows_""",
        EVALUATION,
    ),
    "prompt_items": sql(
        """
SELECT pos // 500000000 AS doc, row_number() OVER (PARTITION BY pos // 500000000 ORDER BY pos) - 1 AS pos,
  CASE WHEN pos % 11 <> 5 THEN name END AS name,
  CASE WHEN pos % 11 NOT IN (1, 2, 5) THEN user_ END AS user,
  CASE WHEN pos % 11 NOT IN (1, 2, 3, 4, 5) THEN system_ END AS system,
  CASE WHEN pos % 11 NOT IN (1, 2, 3, 4, 5) THEN max_tokens END AS max_tokens,
  CASE WHEN pos % 11 = 3 THEN '?|?' WHEN pos % 11 NOT IN (1, 2, 4, 5)
    THEN array_to_string(keywords, '|') END AS keywords,
  CASE pos % 11 WHEN 1 THEN 'user_not_text' WHEN 2 THEN 'missing_user'
    WHEN 3 THEN 'keyword_not_text@0,keyword_not_text@1' WHEN 4 THEN 'max_tokens_not_integer'
    WHEN 5 THEN 'not_object' ELSE '' END AS errors
FROM rows_""",
        EVALUATION,
    ),
    "prompt_messages": sql(
        """
SELECT pos, name, 0 AS i, 'system' AS role, system_ AS content
FROM rows_ WHERE system_ <> ''
UNION ALL
SELECT pos, name, CASE WHEN system_ <> '' THEN 1 ELSE 0 END, 'user', user_ FROM rows_""",
        EVALUATION,
    ),
    "response_features": sql(
        "SELECT pos, name, length_score, coverage, diversity FROM parts",
        EVALUATION, response_parts("base", "rows_", "parts"),
    ),
    "response_score": sql(
        "SELECT pos, name, CASE WHEN blank THEN 0 ELSE r END AS score FROM r_c",
        EVALUATION,
        response_parts("base", "rows_", "parts"),
        round_sql(MEAN, "r", "parts"),
    ),
    "base_last_wins": sql(
        "SELECT name, response, pos FROM last_base", *_COMPARED
    ),
    "compare_responses": sql("SELECT * EXCLUDE (milli) FROM compared", *_COMPARED),
    "compare_pipeline": sql(
        "SELECT prompt_name, user_input, base_response, tuned_response, base_score, "
        "tuned_score, improvement FROM compared",
        *_COMPARED,
    ),
    "comparison_report": sql(
        """
SELECT pos, prompt_name, CASE WHEN milli > 0 THEN 'up' WHEN milli < 0 THEN 'down'
    ELSE 'same' END AS label,
  substr(base_response, 1, 500) AS base_preview,
  substr(tuned_response, 1, 500) AS tuned_preview FROM compared""",
        *_COMPARED,
    ),
    "comparison_summary": sql(
        """
SELECT count(*) AS n,
  coalesce(sum(milli), 0)::DOUBLE / (1000 * greatest(count(*), 1))::DOUBLE
    AS mean_improvement,
  count(*) FILTER (milli > 0) AS up, count(*) FILTER (milli = 0) AS same,
  count(*) FILTER (milli < 0) AS down FROM compared""",
        *_COMPARED,
    ),
}
