r"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Detected are e-mail addresses, IPv4 and IPv6 addresses, payment card numbers and IBANs with right
check digits, US social security numbers, telephone numbers (international, and US ones without a country code),
secrets in hexadecimal, access tokens that a known prefix tells, street addresses, and names that follow a title or "my
name is". Other names without a title are not detected. An entity is a
type and a normal form (case and separators do not matter), so that all its
mentions get one surrogate in the whole corpus. The given and the family part of a name are
entities of their own: "Mr Smith", "Mr. Smith" and "Mr John Smith" share a family name. The surrogate comes from a keyed
SHA-256 of type, normal form and attempt, and keeps what the mention looks
like: separators, number of digits, letter case, valid octets and check digits, the country code,
the title, the prefix of a token, script, and the gender that the title implies (without one, the
given name: a known one, or its ending).

Distinctness is checked over all entities: of entities with one surrogate all
but the first move to the next attempt, and so does one whose surrogate is
itself an entity, until none is left. A surrogate depends on the key, the
entity and the attempt alone, so documents are rewritten where they are;
only attempts above 0, which few entities have, are joined.

Edge cases. NULL texts stay NULL with 0 entities. Repeated rows get equal
results. Other columns are kept, whatever their names; ``n_entities`` and ``entities`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.tables import keep

KEY = "chatsieve"
MAX_ATTEMPTS = 64

# Titles before names.
TITLES = ("Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra|"
          "Господин|Госпожа|Κύριος|Κυρία")
# Lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK",
    21: "CH|CR|HR|LI|LV", 22: "BG|BH|DE|GB|GE|IE|ME|RS", 23: "AE|GI|IL|IQ|TL",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "PT", 26: "IS|TR", 27: "FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|CY|DO|GT|HU|LB|PL", 29: "BR|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC",
}
IBAN = "|".join(rf"(?:{c})\d\d(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
# Prefixes of access tokens, and what follows them.
TOKENS = {
    "AKIA": "[0-9A-Z]{16}", "ASIA": "[0-9A-Z]{16}", "gh[pousr]_": "[A-Za-z0-9]{30,}",
    "github_pat_": r"\w{20,}", "sk-": "[A-Za-z0-9_-]{20,}", "xox[abprs]-": "[A-Za-z0-9-]{10,}",
    "eyJ": r"[\w-]{8,}\.[\w-]{8,}\.[\w-]*+",
}
TOKEN = "|".join(TOKENS)
HEX4 = "[0-9A-Fa-f]{1,4}"
NAME = r"\p{Lu}[\p{L}'’-]+"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square"
# Patterns, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\w.+%À-ÿ-])[\w.+%À-ÿ-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "token": r"\b(?:" + "|".join(f"{p}{rest}" for p, rest in TOKENS.items()) + r")(?!\w)",
    "secret": r"\b(?:[0-9a-f]{32,}|[0-9A-F]{32,})\b",
    "ip": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b(?!\.\d)",
    "ip6": rf"(?<![\w:.])(?=[0-9A-Fa-f]{{0,3}}\d)(?:(?:{HEX4}:){{7}}{HEX4}"
           rf"|(?:{HEX4}:){{1,6}}(?::{HEX4}){{1,6}})(?![\w:])",
    "iban": rf"\b(?:{IBAN})\b",
    "card": r"\b(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}|3[47]\d\d[ -]\d{6}[ -]\d{5})\b",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}\b(?!-\d)",
    "phone": r"(?:(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}\b"
             r"|(?<![\w(+.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[.-]\d{4}\b(?![.-]\d))",
    "street": rf"\b\d{{1,5}} (?:{NAME} ){{1,3}}(?:{STREETS})\b",
    "name": rf"(?:\b(?:{TITLES})\.? {NAME}(?: {NAME})?|(?<=\b[Mm]y name is ){NAME}(?: {NAME})?)",
}
# Every mention has one of these; texts without them are not searched further.
HINTS = ("[0-9@]", rf"\b(?:{TITLES})\.? \p{{Lu}}", r"y name is \p{Lu}", rf"\b(?:{TOKEN})")
# Given names that do not end like others of their gender.
FEMALE_NAMES = ("alice agnes anne ann astrid beatrice birgit carmen caroline catherine charlotte chloe claire doris edith"
                " elisabeth elizabeth emily esther gertrud grace heather helen ingrid irene isabel jane janet jennifer"
                " joan judith julie karen kate katherine kim linda lucy margaret marie mary megan nancy nicole rachel"
                " rose ruth sarah sharon sophie susan sylvie yvonne любовь нинель").split()
MALE_NAMES = "luca nikita joshua andrea ezra elia mustafa илья никита саша миша фома лука кузьма".split()
# Titles that say the gender of a name.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "Κυρία")
# Syllables of surrogate names, and endings by gender (m, f).
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe fi fo ga ge ka ke la le li lo ma me mi mo na ne ni no"
              " ra re ri ro", "n", "na"),
    "cyrillic": ("ба бе би бо да де ди до фа фе фи фо га ге ка ке ла ле ли ло ма ме ми мо на не ни"
                 " но ра ре ри ро", "н", "на"),
    "greek": ("βα βε βι βο δα δε δι δο φα φε φι φο γα γε κα κε λα λε λι λο μα με μι μο να νε νι"
              " νο ρα ρε ρι ρο", "ς", "να"),
}

# Group 1 of the card pattern is group 1 of the whole; no other pattern has groups.
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_HEX, _DIGITS = "abcdef", "012345"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _once(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` for a value that is made once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _compact(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9A-Za-z]', '')"


def _luhn(digits: str, double: int) -> str:
    """SQL of the weighted sum of digits; every other one counts double, from the right."""
    return (
        f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> CAST(c AS INT) * IF(i % 2 = {double}, 2, 1)),"
        " 0, (a, x) -> a + x - IF(x > 9, 9, 0))"
    )


def _mod97(value: str) -> str:
    """SQL of a number modulo 97, letters counting from A = 10."""
    return (
        f"aggregate(split({value}, ''), 0, (a, c) -> IF(c RLIKE '^[0-9]$',"
        " (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97))"
    )


def kind(value: str) -> str:
    """SQL of the type of a mention; 'none' if its check digits are wrong."""
    def found(t: str, p: str) -> str:
        says = f"'{t}'"
        if t == "card":
            says = f"IF({_luhn(_digits(value), 1)} % 10 = 0, 'card', 'none')"
        if t == "iban":
            moved_ = _once("c", _compact(value), "concat(substr(c, 5), substr(c, 1, 4))")
            says = f"IF({_mod97(moved_)} = 1, 'iban', 'none')"
        return f"WHEN {value} RLIKE {_sql('^(?:' + p + ')$')} THEN {says}"

    return f"CASE {' '.join(found(t, p) for t, p in PATTERNS.items())} ELSE 'name' END"


def lead(kind_: str, value: str) -> str:
    """SQL of what a mention keeps before its parts: the title of a name."""
    title = _sql(rf"^(?:{TITLES})\.? ")
    return f"IF({kind_} = 'name', regexp_extract({value}, {title}, 0), '')"


def parts(kind_: str, value: str, lead_: str) -> str:
    """SQL of the entities of a mention, ``array<struct<kind, value>>``: the given and the family
    part of a name, else the mention."""
    female = f"regexp_replace({lead_}, '[. ]', '') IN ({', '.join(map(_sql, FEMALE))})"
    neutral = f"regexp_replace({lead_}, '[. ]', '') IN ('', 'Dr')"
    looks = (
        f"lower(w[0]) IN ({', '.join(map(_sql, FEMALE_NAMES))}) OR w[0] RLIKE '[aаяαη]$'"
        f" AND NOT lower(w[0]) IN ({', '.join(map(_sql, MALE_NAMES))})"
    )
    given = f"IF({female} OR {neutral} AND ({looks}), 'given_f', 'given_m')"
    family = f"IF(element_at(w, -1) RLIKE {_sql('(?:[ая]|[αηά]|ού)$')}, 'family_f', 'family')"
    last = f"struct({family} AS kind, element_at(w, -1) AS value)"
    both = f"array(struct({given} AS kind, w[0] AS value), {last})"
    words = f"split(substr({value}, 1 + length({lead_})), ' ')"
    return (
        f"IF({kind_} = 'name', {_once('w', words, f'IF(size(w) > 1, {both}, array({last}))')},"
        f" array(struct({kind_} AS kind, {value} AS value)))"
    )


def normal(kind_: str, value: str) -> str:
    """SQL of what mentions of one entity have in common."""
    return (
        f"CASE WHEN {kind_} = 'phone' THEN concat(IF({value} LIKE '+%', '+', '+1'), {_digits(value)})"
        f" WHEN {kind_} IN ('card', 'ssn') THEN {_digits(value)}"
        f" WHEN {kind_} = 'iban' THEN {_compact(value)} WHEN {kind_} = 'token' THEN {value}"
        f" ELSE lower({value}) END"
    )


def _name(value: str, female: str, h: str, attempt: str) -> str:
    """SQL of a made-up part of a name, in its script; later attempts are longer."""
    def part(script: str, feminine: str) -> str:
        syllables, male, end = SYLLABLES[script]
        pick = f"get(split('{syllables}', ' '), CAST(conv(substr({h}, 2 * i + 1, 2), 16, 10) AS INT) % 32)"
        return (
            f"initcap(concat(array_join(transform(sequence(0, 3 + least({attempt} div 2, 5)), i -> {pick}), ''),"
            f" IF({feminine}, '{end}', '{male}')))"
        )

    return (
        f"CASE WHEN {value} RLIKE '\\\\p{{IsCyrillic}}' THEN {part('cyrillic', female)}"
        f" WHEN {value} RLIKE '\\\\p{{IsGreek}}' THEN {part('greek', female)} ELSE {part('latin', female)} END"
    )


def surrogate(key: str, kind_: str, value: str, attempt: str) -> str:
    """SQL of the surrogate of an entity as one mention writes it; columns or lambda variables as inputs."""
    h = f"sha2(concat_ws('|', {_sql(key)}, {kind_}, {normal(kind_, value)}, {attempt}), 512)"
    digits = f"translate(h_, '{_HEX}', '{_DIGITS}')"
    letters = "translate(h_, '0123456789', 'ghijkmnopq')"

    def put(text: str) -> str:
        """Digits and letters in place of digits and letters."""
        return (
            f"array_join(transform(split({text}, ''), (c, i) -> CASE"
            f" WHEN c RLIKE '^[0-9]$' THEN substr({digits}, 1 + i % 128, 1)"
            f" WHEN c RLIKE '^\\\\p{{Lu}}$' THEN upper(substr({letters}, 1 + i % 128, 1))"
            f" WHEN c RLIKE '^\\\\p{{L}}$' THEN substr({letters}, 1 + i % 128, 1) ELSE c END), '')"
        )

    def fill(made: str) -> str:
        """The characters of ``made`` between the separators of the mention."""
        before = _compact("substr(v_, 1, i)")
        return _once("m_", made, (
            "array_join(transform(split(v_, ''), (c, i) -> IF(c RLIKE '^[0-9A-Za-z]$',"
            f" substr(m_, 1 + length({before}), 1), c)), '')"
        ))

    octet = "CAST(1 + conv(substr(h_, 4 * i + 1, 4), 16, 10) % 254 AS INT)"
    secret = "substr(repeat(h_, 1 + length(v_) div 128), 1, length(v_))"
    hexes = (
        "array_join(transform(split(v_, ''), (c, i) -> CASE WHEN c = ':' THEN c"
        " WHEN c RLIKE '^[A-F]$' THEN upper(substr(h_, 1 + i, 1)) ELSE substr(h_, 1 + i, 1) END), '')"
    )
    code = (  # digits of the country code
        "CASE WHEN n_ RLIKE '^[17]' THEN 1"
        " WHEN n_ RLIKE '^(?:20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])' THEN 2 ELSE 3 END"
    )
    number = _once("n_", f"substr({normal(_sql('phone'), 'v_')}, 2)", _once(
        "k_", code, f"concat(substr(n_, 1, k_), {put('substr(n_, k_ + 1)')})"))
    token = _sql(rf"^(?:{TOKEN})")
    street = rf" (?:{STREETS})$"
    cases = {
        "email": "concat(" + put("substring_index(v_, '@', 1)")
                 + f", '@', substr({letters}, 100, 8), '.example.', substring_index(v_, '.', -1))",
        "token": _once("k_", f"regexp_extract(v_, {token}, 0)", f"concat(k_, {put('substr(v_, 1 + length(k_))')})"),
        "ip": f"array_join(transform(array(0, 1, 2, 3), i -> {octet}), '.')",
        "ip6": hexes,
        "secret": f"IF(v_ RLIKE '[A-F]', upper({secret}), {secret})",
        "iban": fill(_once("b_", put(f"substr({_compact('v_')}, 5)"), (
            "concat(substr(v_, 1, 2), lpad(98 - " + _mod97("concat(b_, substr(v_, 1, 2), '00')") + ", 2, '0'), b_)"))),
        # The first digit, which tells the network, is kept.
        "card": fill(_once("b_", _once("d_", _digits("v_"), (
            f"concat(substr(d_, 1, 1), {put('substr(d_, 2, length(d_) - 2)')})")),
            f"concat(b_, (10 - {_luhn('b_', 0)} % 10) % 10)")),
        "ssn": fill(put(_digits("v_"))),
        "phone": fill(f"IF(v_ LIKE '+%', {number}, substr({number}, 2))"),
        "street": f"concat({put("substring_index(v_, ' ', 1)")}, ' ',"
                  f" {_name('v_', 'false', 'h_', attempt)}, regexp_extract(v_, {_sql(street)}, 0))",
    }
    for part in ("given_f", "given_m", "family_f", "family"):
        cases[part] = _name("v_", str(part.endswith("_f")).lower(), "h_", attempt)
    body = " ".join(f"WHEN {kind_} = '{t}' THEN {sql}" for t, sql in cases.items())
    return _once("v_", value, _once("h_", h, f"CASE {body} ELSE {put('v_')} END"))


def prefix(columns: list[str]) -> str:
    """The start of the names of helper columns, which no given column has."""
    start = "_pii"
    while any(c.lower().startswith(start) for c in columns):
        start += "_"
    return start


def detected(docs: DataFrame, start: str) -> DataFrame:
    """Hash of the text and what the patterns find in it, in order, beside all columns."""
    return docs.withColumn(f"{start}h", F.expr("xxhash64(CAST(text AS STRING), 7)")).withColumn(
        f"{start}found", F.expr(
            f"IF({' OR '.join(f'text RLIKE {_sql(h)}' for h in HINTS)},"
            f" regexp_extract_all(CAST(text AS STRING), {_sql(PATTERN)}, 0), array())"
        )
    )


def moved(mentions: DataFrame, key: str) -> DataFrame:
    """Entities whose attempt is not 0: ``kind, norm, attempt``.

    ``mentions`` has ``kind, norm, value``. Every round looks at all entities, so
    the result does not depend on their order.
    """
    entities = keep(
        mentions.groupBy("kind", "norm").agg(F.min("value").alias("value"))
        .withColumn("attempt", F.lit(0)),
        "entities",
    )
    for _ in range(MAX_ATTEMPTS):
        made = entities.selectExpr(
            "*", f"{surrogate(key, 'kind', 'value', 'attempt')} AS made"
        ).selectExpr("*", f"{normal('kind', 'made')} AS made_norm")
        # Of those with one surrogate, the least attempt and normal form keeps it.
        first = made.groupBy("kind", "made_norm").agg(
            F.expr("min(struct(attempt, norm))").alias("first"), F.count("*").alias("n")
        )
        taken = entities.selectExpr("kind", "norm AS made_norm", "true AS real")
        clash = keep(
            made.join(first, ["kind", "made_norm"])
            .join(taken, ["kind", "made_norm"], "left")
            .where("real OR first <> struct(attempt, norm)")
            .selectExpr("kind", "norm", "true AS again"),
            "clashes",
        )
        if clash.isEmpty():
            return entities.where("attempt > 0").select("kind", "norm", "attempt")
        entities = keep(
            entities.join(clash, ["kind", "norm"], "left").selectExpr(
                "kind", "norm", "value", "attempt + IF(again, 1, 0) AS attempt"
            ),
            "entities",
        )
    raise ValueError("surrogates of some entities still clash")


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, plus ``n_entities`` and ``entities``
    (array of ``kind, surrogate`` in order)."""
    names = [c for c in docs.columns if c.lower() not in ("n_entities", "entities")]
    p = prefix(names)
    rows = detected(docs.select(*[F.col(f"`{c}`") for c in names]), p)
    mentions = keep(
        # Outer, as the optimizer would add a filter that searches every text twice.
        rows.selectExpr(f"doc_id AS {p}id", f"{p}h AS {p}th", f"explode_outer(array_distinct({p}found)) AS raw")
        .where("raw IS NOT NULL")
        .selectExpr(f"{p}id", f"{p}th", "raw", f"{kind('raw')} AS kind")
        .where("kind <> 'none'")
        .selectExpr(f"{p}id", f"{p}th", "raw", "kind", f"{lead('kind', 'raw')} AS lead")
        .selectExpr(f"{p}id", f"{p}th", f"explode({parts('kind', 'raw', 'lead')}) AS part")
        .selectExpr(f"{p}id", f"{p}th", "part.kind AS kind", "part.value AS value")
        .selectExpr("*", f"{normal('kind', 'value')} AS norm"),
        "mentions",
    )
    again = moved(mentions, key)
    of_docs = keep(
        mentions
        .join(again, ["kind", "norm"])
        .selectExpr(f"{p}id", f"{p}th", "concat(kind, '|', value) AS value", "attempt").distinct()
        .groupBy(f"{p}id", f"{p}th")
        .agg(F.expr("map_from_entries(collect_list(struct(value, attempt)))").alias(f"{p}again")),
        "moved-mentions",
    )
    made = surrogate(key, "q.kind", "q.value", f"coalesce({p}again[concat(q.kind, '|', q.value)], 0)")
    pieces = f"split(CAST(text AS STRING), {_sql(PATTERN)}, -1)"
    mention = _once("k", kind("v"), _once("t", lead("k", "v"), (
        f"struct(k AS kind, v AS value, t AS lead, {parts('k', 'v', 't')} AS parts)")))
    return (
        rows.join(of_docs, rows["doc_id"].eqNullSafe(of_docs[f"{p}id"]) & (rows[f"{p}h"] == of_docs[f"{p}th"]), "left")
        .withColumn(f"{p}found", F.expr(f"transform({p}found, v -> {mention})"))
        .withColumn(f"{p}made", F.expr(
            f"transform({p}found, m -> IF(m.kind = 'none', m.value,"
            f" concat(m.lead, array_join(transform(m.parts, q -> {made}), ' '))))"
        ))
        .withColumn("text", F.expr(
            f"IF(size({p}made) = 0, CAST(text AS STRING), array_join(flatten(zip_with("
            f"{pieces}, {p}made, (p, s) -> array(p, coalesce(s, '')))), ''))"
        ))
        .withColumn("entities", F.expr(
            f"transform(filter(zip_with({p}found, {p}made, (m, s) -> struct(m.kind AS kind, s AS surrogate)),"
            " e -> e.kind <> 'none'), e -> e)"
        ))
        .withColumn("n_entities", F.expr("CAST(size(entities) AS LONG)"))
        .select(*[F.col(f"`{c}`") for c in names], "n_entities", "entities")
    )
