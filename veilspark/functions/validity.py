"""Rules that decide whether a matched string is real: checksums, dates, blocked values.

Each takes the SQL expression of a match and returns a boolean SQL expression.
"""

from __future__ import annotations

from . import patterns as P
from .spans import let


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def email(m: str) -> str:
    return (
        f"length({m}) - length(replace({m}, '@', '')) = 1"
        f" AND NOT contains({m}, '@.') AND NOT startswith({m}, '@') AND NOT endswith({m}, '.')"
    )


def nino(m: str) -> str:
    rule = (
        f"length(v) >= 9 AND substr(v, 1, 1) NOT IN {_in(P.NINO_BAD_FIRST)}"
        f" AND substr(v, 3, 2) NOT IN {_in(P.NINO_BAD_DIGITS)}"
        f" AND substr(v, 9, 1) NOT IN {_in(P.NINO_BAD_LAST)}"
    )
    return let(f"upper(replace({m}, ' ', ''))", "v", rule)


def nhs(m: str) -> str:
    """Modulus 11 over the first nine digits with weights 10 to 2; a check value of 10 never passes."""
    total = " + ".join(f"CAST(substr(v, {i}, 1) AS int) * {11 - i}" for i in range(1, 10))
    rule = f"length(v) = 10 AND CAST(substr(v, 10, 1) AS int) = (11 - ({total}) % 11) % 11"
    # a remainder of 1 asks for check value 10, which one digit cannot hold
    return let(f"translate({m}, '- ', '')", "v", rule)


def card(m: str) -> str:
    return let(
        f"translate({m}, '- ', '')",
        "v",
        "length(v) >= 13 AND replace(v, '0', '') != '' AND luhn_check(v)",
    )


def iban(m: str) -> str:
    """Modulus 97 of the rearranged number, kept small by reducing after every character."""
    rest = f"""aggregate(split(concat(substr({m}, 5), substr({m}, 1, 4)), ''), 0,
      (r, c) -> if(ascii(c) >= 65, (r * 100 + ascii(c) - 55) % 97, (r * 10 + ascii(c) - 48) % 97))"""
    return f"length({m}) BETWEEN 15 AND 34 AND ({m} = '{P.IBAN_TEST_NUMBER}' OR {rest} = 1)"


def ipv6(m: str) -> str:
    return f"length(translate({m}, ':/', '')) >= 4"


def _calendar_day(year: str, month: str, day: str) -> str:
    leap = f"({year} % 4 = 0 AND ({year} % 100 != 0 OR {year} % 400 = 0))"
    longest = (
        f"CASE WHEN {month} IN (4, 6, 9, 11) THEN 30 WHEN {month} != 2 THEN 31"
        f" WHEN {leap} THEN 29 ELSE 28 END"
    )
    return f"({month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND {longest})"


def dob_iso(m: str) -> str:
    return let(f"CAST(split({m}, '-') AS array<int>)", "d", _calendar_day("d[0]", "d[1]", "d[2]"))


def dob_numeric(m: str) -> str:
    """Day/month/year or month/day/year; slashes allow one-digit fields, dashes do not."""
    shape = r"r'\A(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})\z'"
    day = f"({_calendar_day('d[2]', 'd[1]', 'd[0]')} OR {_calendar_day('d[2]', 'd[0]', 'd[1]')})"
    return f"rlike({m}, {shape}) AND " + let(f"CAST(split({m}, '[-/]') AS array<int>)", "d", day)


def dob_month(m: str) -> str:
    rule = (
        f"upper(d[1]) IN {_in(P.MONTHS)} AND CAST(d[0] AS int) BETWEEN 1 AND 31"
        f" AND CAST(d[2] AS int) BETWEEN {P.YEAR_MIN} AND {P.YEAR_MAX}"
    )
    return let(f"split({m}, '-')", "d", rule)


def ssn(m: str) -> str:
    """Area, group and serial must not be zero, nor the area 666; one lone separator is no SSN."""
    rule = (
        f"length({m}) - length(v) IN (0, 2) AND substr(v, 1, 3) NOT IN ('000', '666')"
        f" AND substr(v, 4, 2) != '00' AND substr(v, 6, 4) != '0000'"
        f" AND replace({m}, '-', '') != '{P.SSN_BLOCKED}'"
    )
    return let(f"translate({m}, '-.', '')", "v", rule)
