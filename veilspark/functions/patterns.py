"""Patterns of the value detectors, in the Java dialect Spark uses.

Three points where Java needs care so that a match is the same as under a linear-time engine:

* ``\\b`` is Unicode-aware on recent JDKs, so word edges are written out with ASCII look-arounds.
* ``\\s`` is written out, since Java adds the vertical tab.
* the e-mail pattern uses possessive repeats and starts only where a run of local-part characters
  starts (or where the last match ended), so that a long run without ``@`` costs linear time and a long
  domain needs no stack.

A pattern whose first node is a plain character class scans about three times faster than one that opens
with a look-behind, so a leading edge check comes *after* the first digit (``DIGIT_L``).
"""

EDGE_L = r"(?<![0-9A-Za-z_])"
EDGE_R = r"(?![0-9A-Za-z_])"
DIGIT_L = r"[0-9](?<![0-9A-Za-z_][0-9])"  # a digit with a word edge before it
BLANK = r"[\t\n\f\r ]"

# --- fixed values: value patterns -------------------------------------------------------------
_LOCAL = r"[a-zA-Z0-9.!#$%&\x27*+/=?^_{|}~-]"
_LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}(?:\.{_LABEL})++"

PHONE_UK = rf"(?:\+44{BLANK}?[0-9]{{9,10}}|07[0-9]{{9}}|0[1-9][0-9]{{8,9}}|(?:01|02|03|08)[0-9]{{7,9}})"
PHONE_US = (
    rf"(?:\([0-9]{{3}}\)(?:[-.]|{BLANK})?[0-9]{{3}}(?:[-.]|{BLANK})?[0-9]{{4}}"
    rf"|[0-9]{{3}}(?:[-.]|{BLANK})?[0-9]{{3}}(?:[-.]|{BLANK})?[0-9]{{4}})"
)
PHONE_E164 = r"\+[1-9][0-9]{6,14}"

POSTCODE = rf"{EDGE_L}[A-Z]{{1,2}}[0-9][A-Z0-9]?{BLANK}?[0-9][A-Z]{{2}}{EDGE_R}"
NINO = (
    rf"{EDGE_L}[A-Za-z]{{2}}{BLANK}?[0-9]{{2}}{BLANK}?[0-9]{{2}}{BLANK}?[0-9]{{2}}{BLANK}?[A-Za-z]{EDGE_R}"
)
NHS = rf"{DIGIT_L}[0-9]{{2}}[ -]?[0-9]{{3}}[ -]?[0-9]{{4}}{EDGE_R}"
CARD = rf"{DIGIT_L}[0-9]{{3}}[- ]?(?:[0-9]{{4}}[- ]?){{2}}[0-9]{{1,4}}{EDGE_R}"
IBAN = rf"{EDGE_L}[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{1,30}}{EDGE_R}"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{EDGE_L}(?:{_OCTET}\.){{3}}{_OCTET}{EDGE_R}"
IPV4_CIDR = rf"{EDGE_L}(?:{_OCTET}\.){{3}}{_OCTET}/(?:[0-9]|[1-2][0-9]|3[0-2]){EDGE_R}"

IPV6 = rf"{EDGE_L}(?:[0-9a-fA-F]{{1,4}}:){{1,7}}[0-9a-fA-F]{{1,4}}(?:/[0-9]+)?{EDGE_R}"
IPV6_LOOPBACK = rf"::1{EDGE_R}"
IPV6_NETWORKS = ("fe80::/10", "::/128")

DOB_NUMERIC = rf"{DIGIT_L}[0-9]?[-/][0-9]{{1,2}}[-/][0-9]{{2,4}}{EDGE_R}"
DOB_ISO = rf"{DIGIT_L}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{2}}{EDGE_R}"
DOB_MONTH = rf"{DIGIT_L}[0-9]?-[A-Za-z]{{3}}-[0-9]{{4}}{EDGE_R}"

SSN = rf"{DIGIT_L}[0-9]{{2}}[-.]?[0-9]{{2}}[-.]?[0-9]{{4}}{EDGE_R}"

PASSPORT = rf"{EDGE_L}(?:[A-Z][0-9]{{8}}|[A-Z]{{2}}[0-9]{{7,8}}|[0-9]{{8,9}}){EDGE_R}"

# --- gates: what a text must hold for a detector to be tried at all ----------------------------
# six digits with at most two separators between neighbours: phone, national, card, passport numbers
GATE_NUMBER = r"[0-9](?:[-.() \t\n\f\r]{0,2}[0-9]){5}"
GATE_POSTCODE = rf"[A-Z][0-9][A-Z0-9]?{BLANK}?[0-9][A-Z]{{2}}{EDGE_R}"
GATE_IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"
GATE_IPV4 = r"[0-9]\.[0-9]{1,3}\.[0-9]"
GATE_DATE = r"[0-9][-/][0-9A-Za-z]"

# --- fixed values: rules on a match -----------------------------------------------------------
NINO_BAD_FIRST = ("D", "F", "I", "O", "Q", "U")
NINO_BAD_LAST = ("C", "E", "G", "H", "I", "M", "O", "Q", "U", "V", "Z")
NINO_BAD_DIGITS = ("00", "99")
IBAN_TEST_NUMBER = "DE8937040044050513100000"
SSN_BLOCKED = "078051120"
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
YEAR_MIN, YEAR_MAX = 1900, 2100

# --- fixed values: entity names and scores ----------------------------------------------------
EMAIL_ADDRESS = "EMAIL_ADDRESS"
PHONE_NUMBER = "PHONE_NUMBER"
UK_POSTCODE = "UK_POSTCODE"
UK_NINO = "UK_NINO"
UK_NHS_NUMBER = "UK_NHS_NUMBER"
CREDIT_CARD = "CREDIT_CARD"
IBAN_ENTITY = "IBAN"
IP_ADDRESS_V4 = "IP_ADDRESS_V4"
IP_ADDRESS_V6 = "IP_ADDRESS_V6"
DATE_OF_BIRTH = "DATE_OF_BIRTH"
PERSON = "PERSON"
US_SSN = "US_SSN"
PASSPORT_NUMBER = "PASSPORT_NUMBER"

STRONG, MEDIUM, WEAK = 0.85, 0.5, 0.1
BOOSTED = 0.80
MIN_SCORE = 0.5
