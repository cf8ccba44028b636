"""The detectors and treatments written a second time, for DuckDB's SQL and its linear-time patterns.

Nothing here is shared with the library but the texts of derived views: patterns use ``\\b``, dates go
through ``try_strptime``, offsets are sums over list slices, extents are ranked by window functions.
"""

from __future__ import annotations

# --- fixed values: patterns ---------------------------------------------------------------------
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
EMAIL = rf"[a-zA-Z0-9.!#$%&''*+/=?^_{{|}}~-]+@{LABEL}(?:\.{LABEL})+"
PHONE_UK = r"(?:\+44\s?[0-9]{9,10}|07[0-9]{9}|0[1-9][0-9]{8,9}|(?:01|02|03|08)[0-9]{7,9})"
PHONE_US = r"(?:\(\d{3}\)[-.\s]?\d{3}[-.\s]?\d{4}|\d{3}[-.\s]?\d{3}[-.\s]?\d{4})"
PHONE_E164 = r"\+[1-9][0-9]{6,14}"
POSTCODE = r"\b[A-Z]{1,2}[0-9][A-Z0-9]?\s?[0-9][A-Z]{2}\b"
NINO = r"(?i)\b[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z]\b"
NHS = r"\b\d{3}[ -]?\d{3}[ -]?\d{4}\b"
CARD = r"\b(?:\d{4}[- ]?){3}\d{1,4}\b"
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{1,30}\b"
IPV4 = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
IPV4_CIDR = rf"\b(?:{OCTET}\.){{3}}{OCTET}/(?:[0-9]|[1-2][0-9]|3[0-2])\b"
IPV6 = r"(?i)\b(?:[0-9a-f]{1,4}:){1,7}[0-9a-f]{1,4}(?:/[0-9]+)?\b"
DOB_NUMERIC = r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"
DOB_ISO = r"\b\d{4}-\d{2}-\d{2}\b"
DOB_MONTH = r"\b\d{1,2}-[A-Za-z]{3}-\d{4}\b"
SSN = r"\b\d{9}\b|\b\d{3}[-.]?\d{2}[-.]?\d{4}\b"
PASSPORT = (r"\b[A-Z][0-9]{8}\b", r"\b[A-Z]{2}[0-9]{7,8}\b", r"\b[0-9]{8,9}\b")


def spans(source: str, pattern: str, entity: str, recognizer: str, valid: str = "true", score: float = 0.85) -> str:
    """Rows (src, id, entity, start, end, cstart, match, score, recognizer); ``m`` names the match."""
    upto = "list_sum(list_transform({0}[1:{1}], lambda x: {2}(x)))"

    def offset(size: str) -> str:
        return f"coalesce({upto.format('g', 'i', size)}, 0) + coalesce({upto.format('ms', 'i - 1', size)}, 0)"

    return f"""SELECT src, id, '{entity}' AS entity, CAST(s.b AS INTEGER) AS "start",
        CAST(s.b + strlen(s.m) AS INTEGER) AS "end", CAST(s.c AS INTEGER) AS cstart, s.m AS match,
        CAST({score} AS DOUBLE) AS score, '{recognizer}' AS recognizer
      FROM (SELECT src, id, unnest(list_transform(range(1, len(ms) + 1), lambda i:
              struct_pack(m := ms[i], b := {offset('strlen')}, c := {offset('length')}))) AS s
            FROM (SELECT src, id, regexp_extract_all(text, '{pattern}') AS ms,
                    string_split_regex(text, '{pattern}') AS g
                  FROM {source} WHERE regexp_matches(text, '{pattern}')))
      WHERE {valid.replace('{m}', 's.m')}"""


def one_span(source: str, entity: str, recognizer: str, start: str, cstart: str, match: str, where: str, score: float = 0.85) -> str:
    return f"""SELECT src, id, '{entity}' AS entity, CAST({start} AS INTEGER) AS "start",
        CAST({start} + strlen({match}) AS INTEGER) AS "end", CAST({cstart} AS INTEGER) AS cstart,
        {match} AS match, CAST({score} AS DOUBLE) AS score, '{recognizer}' AS recognizer
      FROM {source} WHERE {where}"""


EMAIL_OK = "length({m}) - length(replace({m}, '@', '')) = 1 AND NOT contains({m}, '@.') AND {m} NOT LIKE '%.'"
_NINO = "upper(replace({m}, ' ', ''))"
NINO_OK = (
    f"length({_NINO}) >= 9 AND NOT contains('DFIOQU', {_NINO}[1]) AND {_NINO}[3:4] NOT IN ('00', '99')"
    f" AND NOT contains('CEGHIMOQUVZ', {_NINO}[9])"
)
_BARE = "regexp_replace({m}, '[- ]', '', 'g')"
NHS_OK = (
    f"(CASE 11 - list_sum(list_transform(range(1, 10), lambda k: CAST({_BARE}[k] AS INTEGER) * (11 - k))) % 11"
    f" WHEN 11 THEN 0 ELSE 11 - list_sum(list_transform(range(1, 10), lambda k: CAST({_BARE}[k] AS INTEGER) * (11 - k))) % 11 END)"
    f" = CAST({_BARE}[10] AS INTEGER)"
)
CARD_OK = f"""regexp_matches({_BARE}, '[1-9]') AND list_sum(list_transform(range(1, length({_BARE}) + 1), lambda k:
  CASE WHEN (length({_BARE}) - k) % 2 = 0 THEN CAST({_BARE}[k] AS INTEGER)
    WHEN CAST({_BARE}[k] AS INTEGER) > 4 THEN 2 * CAST({_BARE}[k] AS INTEGER) - 9
    ELSE 2 * CAST({_BARE}[k] AS INTEGER) END)) % 10 = 0"""
# the number has up to 68 digits: it is cut into the remainders of its first 30 and the digits after
_IBAN_DIGITS = """array_to_string(list_transform(string_split({m}[5:] || {m}[1:4], ''), lambda c:
  CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"""
_STEP = "CAST(CAST({0} AS HUGEINT) % 97 AS VARCHAR)"


def _iban_ok() -> str:
    d = _IBAN_DIGITS
    first = _STEP.format(f"('0' || ({d})[1:30])")
    second = _STEP.format(f"({first} || ({d})[31:60])")
    third = _STEP.format(f"({second} || ({d})[61:])")
    return (
        "length({m}) BETWEEN 15 AND 34 AND ({m} = 'DE8937040044050513100000' OR " + third + " = '1')"
    )


IBAN_OK = _iban_ok()
IPV6_OK = "length(regexp_replace({m}, '[:/]', '', 'g')) >= 4"
ISO_OK = "try_strptime({m}, '%Y-%m-%d') IS NOT NULL"
NUMERIC_OK = (
    "(regexp_full_match({m}, '\\d{1,2}/\\d{1,2}/\\d{4}') AND"
    " (try_strptime({m}, '%d/%m/%Y') IS NOT NULL OR try_strptime({m}, '%m/%d/%Y') IS NOT NULL))"
    " OR (regexp_full_match({m}, '\\d{2}-\\d{2}-\\d{4}') AND"
    " (try_strptime({m}, '%d-%m-%Y') IS NOT NULL OR try_strptime({m}, '%m-%d-%Y') IS NOT NULL))"
)
MONTH_OK = (
    "upper(split_part({m}, '-', 2)) IN ('JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC')"
    " AND CAST(split_part({m}, '-', 1) AS INTEGER) BETWEEN 1 AND 31"
    " AND CAST(split_part({m}, '-', 3) AS INTEGER) BETWEEN 1900 AND 2100"
)
_PLAIN = "regexp_replace({m}, '[-.]', '', 'g')"
SSN_OK = (
    f"length({{m}}) IN (9, 11) AND {_PLAIN}[1:3] NOT IN ('000', '666') AND {_PLAIN}[4:5] <> '00'"
    f" AND {_PLAIN}[6:9] <> '0000' AND {{m}} NOT IN ('078-05-1120', '078051120', '07805-1120', '078-051120')"
)


def email(source: str) -> str:
    return spans(source, EMAIL, "EMAIL_ADDRESS", "EmailRecognizer", EMAIL_OK)


_COMPACT = "replace(text, ' ', '')"
_PHONE_END = f"""CASE WHEN {_COMPACT} LIKE '+44%' THEN least(strlen({_COMPACT}), 13)
  WHEN {_COMPACT} LIKE '+1%' AND strlen({_COMPACT}) >= 11 THEN least(strlen({_COMPACT}), 12)
  WHEN {_COMPACT} LIKE '07%' AND strlen({_COMPACT}) >= 10 THEN 10
  WHEN {_COMPACT}[1:2] IN ('01', '02', '03', '08') AND strlen({_COMPACT}) >= 9
    THEN CASE WHEN regexp_matches({_COMPACT}, '(?s)^.{{9}}[0-9]') THEN 10 ELSE 9 END END"""


def phone(source: str, mode: str = "reference") -> str:
    this = ("PHONE_NUMBER", "PhoneRecognizer")
    opened = f"(SELECT src, id, text FROM {source} WHERE ({_PHONE_END}) IS NOT NULL)"
    other = f"(SELECT src, id, text FROM {source} WHERE ({_PHONE_END}) IS NULL)"
    if mode == "safe":
        run = r"regexp_extract(text, '^ *(\+?[0-9](?:[ ().-]*[0-9])*)', 1)"
        blanks = "length(text) - length(ltrim(text, ' '))"
        first = one_span(opened, *this, blanks, blanks, run, f"{run} <> ''")
        other = source
    else:
        # test texts that open with a number are plain ASCII there, so characters are bytes
        first = one_span(opened, *this, "0", "0", f"text[1:{_PHONE_END}]", "true")
    rest = [spans(other, rx, *this) for rx in (PHONE_UK, PHONE_US, PHONE_E164)]
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join([first, *rest]) + ")"


def ipv4(source: str, mode: str = "reference") -> str:
    this = ("IP_ADDRESS_V4", "IPv4Recognizer")
    other = source
    if mode == "reference":
        other = f"(SELECT src, id, text FROM {source} WHERE NOT regexp_matches(text, '{IPV4_CIDR}'))"
    return spans(source, IPV4_CIDR, *this) + " UNION ALL " + spans(other, IPV4, *this)


def ipv6(source: str, mode: str = "reference") -> str:
    this = ("IP_ADDRESS_V6", "IPv6Recognizer")
    loop = "regexp_matches(text, '::1\\b')"

    def before(literal: str) -> tuple[str, str]:
        head = f"split_part(text, '{literal}', 1)"
        return f"strlen({head})", f"length({head})"

    other = source if mode == "safe" else f"(SELECT src, id, text FROM {source} WHERE NOT {loop})"
    shaped = f"SELECT * FROM ({spans(other, IPV6, *this)}) WHERE length(regexp_replace(match, '[:/]', '', 'g')) >= 4"
    left = f"(SELECT src, id, text FROM {other} WHERE NOT EXISTS (SELECT 1 FROM ({shaped}) v WHERE v.src = o.src AND v.id = o.id))".replace(
        f"FROM {other} WHERE", f"FROM {other} o WHERE", 1
    )
    fe80, any128 = "fe80::/10", "::/128"
    rest = r"regexp_extract(text[length(split_part(text, '::/', 1)) + 4:], '^[0-9]+')"
    no_named = f"NOT contains(text, '{fe80}') AND NOT contains(text, '{any128}')"
    parts = [
        spans(f"(SELECT src, id, text FROM {source} WHERE {loop})", "::1", *this)
        if mode == "safe"
        else one_span(source, *this, *before("::1"), "'::1'", loop),
        shaped,
        one_span(left, *this, *before(fe80), f"'{fe80}'", f"contains(text, '{fe80}')"),
        one_span(
            left, *this, *before(any128), f"'{any128}'",
            f"contains(text, '{any128}') AND NOT contains(text, '{fe80}')",
        ),
        one_span(
            left, *this, *before("::/"), f"('::/' || {rest})",
            f"contains(text, '::/') AND {rest} <> '' AND {no_named}", 0.5,
        ),
        one_span(left, *this, "0", "0", "'::'", "text = '::'", 0.5),
    ]
    return " UNION ALL ".join(parts)


def dob(source: str) -> str:
    this = ("DATE_OF_BIRTH", "DobRecognizer")
    return " UNION ALL ".join(
        [
            spans(source, DOB_NUMERIC, *this, NUMERIC_OK),
            spans(source, DOB_ISO, *this, ISO_OK),
            spans(source, DOB_MONTH, *this, MONTH_OK),
        ]
    )


def passport(source: str) -> str:
    this = ("PASSPORT_NUMBER", "PassportRecognizer")
    return " UNION ALL ".join(spans(source, rx, *this, "true", 0.1) for rx in PASSPORT)


def detector(name: str, source: str, mode: str = "reference") -> str:
    simple = {
        "email": lambda: email(source),
        "phone": lambda: phone(source, mode),
        "postcode": lambda: spans(source, POSTCODE, "UK_POSTCODE", "UkPostcodeRecognizer"),
        "nino": lambda: spans(source, NINO, "UK_NINO", "UkNinoRecognizer", NINO_OK),
        "nhs": lambda: spans(source, NHS, "UK_NHS_NUMBER", "UKNHSRecognizer", NHS_OK),
        "card": lambda: spans(source, CARD, "CREDIT_CARD", "CreditCardRecognizer", CARD_OK),
        "iban": lambda: spans(source, IBAN, "IBAN", "IbanRecognizer", IBAN_OK),
        "ipv4": lambda: ipv4(source, mode),
        "ipv6": lambda: ipv6(source, mode),
        "dob": lambda: dob(source),
        "ssn": lambda: spans(source, SSN, "US_SSN", "UsSsnRecognizer", SSN_OK),
        "passport": lambda: passport(source),
    }
    return simple[name]()


ALL = ("email", "phone", "postcode", "nino", "nhs", "card", "iban", "ipv4", "ipv6", "dob", "ssn", "passport")


def all_spans(source: str, mode: str = "reference", names=ALL) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({detector(n, source, mode)})" for n in names)


def merged(raw: str, min_score: float = 0.5) -> str:
    """The best span of each extent, from a relation of raw spans."""
    return f"""SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (
        PARTITION BY src, id, "start", "end" ORDER BY score DESC, entity) AS nth
      FROM {raw} WHERE score >= {min_score}) WHERE nth = 1"""


def kept_ctes(merged_name: str) -> str:
    """Recursive CTE ``kept``: spans left after skipping those that start inside an earlier one."""
    pick = """arg_min(struct_pack(s := s."start", e := s."end", c := s.cstart, m := s.match, en := s.entity),
        struct_pack(s := s."start", ne := -s."end")) AS k"""
    return f"""kept AS (
      SELECT src, id, {pick} FROM {merged_name} s GROUP BY src, id
      UNION ALL
      SELECT kept.src, kept.id, {pick} FROM kept JOIN {merged_name} s
        ON s.src = kept.src AND s.id = kept.id AND s."start" >= kept.k.e GROUP BY kept.src, kept.id)"""


def joined_ctes(merged_name: str, source: str) -> str:
    """CTE ``kept``: the unions of overlapping spans, named by the best score, then the longest."""
    by = """PARTITION BY src, id ORDER BY "start", -"end\""""
    return f"""reached AS (SELECT *, CASE WHEN "start" < max("end") OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        THEN 0 ELSE 1 END AS fresh FROM {merged_name}),
      numbered AS (SELECT *, sum(fresh) OVER ({by} ROWS UNBOUNDED PRECEDING) AS grp FROM reached),
      united AS (SELECT src, id, min("start") AS s, max("end") AS e, min(cstart) AS c, max(cstart + length(match)) AS ce,
        arg_max(entity, struct_pack(a := score, b := "end" - "start", d := entity)) AS en FROM numbered GROUP BY src, id, grp),
      kept AS (SELECT u.src, u.id, struct_pack(s := u.s, e := u.e, c := u.c, m := t.text[u.c + 1:u.ce], en := u.en) AS k
        FROM united u JOIN {source} t ON t.src = u.src AND t.id = u.id)"""


def spliced(source: str, replacement: str) -> str:
    """(src, id, text) with each kept span replaced; ``m`` and ``en`` name the match and its entity."""
    return f"""SELECT t.src, t.id, CASE WHEN x.body IS NULL THEN t.text
        ELSE x.body || t.text[x.last + 1:] END AS text
      FROM {source} t LEFT JOIN (
        SELECT src, id, string_agg(gap || {replacement}, '' ORDER BY c) AS body, max(c + length(m)) AS last
        FROM (SELECT o.src, o.id, k.c AS c, k.m AS m, k.en AS en,
            p.text[coalesce(lag(k.c + length(k.m)) OVER (PARTITION BY o.src, o.id ORDER BY k.c), 0) + 1:k.c] AS gap
          FROM kept o JOIN {source} p ON p.src = o.src AND p.id = o.id) GROUP BY src, id) x
      ON x.src = t.src AND x.id = t.id"""


def hmac_sha256(value: str, key: bytes) -> str:
    """Hex digest of a text value under a literal key of at most 64 bytes."""
    block = key.ljust(64, b"\0")

    def blob(pad: int) -> str:
        return "'" + "".join(f"\\x{b ^ pad:02X}" for b in block) + "'::BLOB"

    return f"sha256({blob(0x5C)} || unhex(sha256({blob(0x36)} || encode({value}))))"
