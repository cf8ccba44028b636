"""The detectors: each maps a text to an array of spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import validity as V
from .spans import (
    EMPTY,
    distinct_spans,
    let,
    literal_span,
    merge_spans,
    one_span,
    quoted,
    regex_spans,
)

REFERENCE, SAFE = "reference", "safe"


@dataclass(frozen=True)
class Detector:
    """A named detector.

    ``spans(text, mode)`` gives the span array as SQL text. ``mode`` is ``"reference"`` for the
    documented span rules, or ``"safe"`` for treating text, where a hit that ends a scan early must not
    leave other personal data readable. ``gate(text)`` is a cheap test that is true for every text with
    a hit; detectors sharing a gate share its cost. ``digits`` says that every hit holds a digit: all such
    gates are skipped for texts without one, and the test for it ends at the first digit of the others.
    """

    name: str
    entity: str
    spans: Callable[[str, str], str]
    gate: Callable[[str], str] | None = None
    digits: bool = False


def _has_at(text: str) -> str:
    return f"contains({text}, '@')"


def _may_open_with_phone(text: str) -> str:
    return f"(startswith(ltrim({text}), '+') OR startswith(ltrim({text}), '0'))"


def _has_number(text: str) -> str:
    return f"({_may_open_with_phone(text)} OR rlike({text}, {quoted(P.GATE_NUMBER)}))"


def _has_postcode(text: str) -> str:
    return f"rlike({text}, {quoted(P.GATE_POSTCODE)})"


def _has_iban(text: str) -> str:
    return f"rlike({text}, {quoted(P.GATE_IBAN)})"


def _has_ipv4(text: str) -> str:
    return f"rlike({text}, {quoted(P.GATE_IPV4)})"


def _has_colon(text: str) -> str:
    return f"contains({text}, ':')"


def _has_date(text: str) -> str:
    return f"rlike({text}, {quoted(P.GATE_DATE)})"


def _never(text: str) -> str:
    return "false"


def regex_detector(
    name: str,
    entity: str,
    pattern: str,
    score: float = P.STRONG,
    valid: Callable[[str], str] | None = None,
    gate: Callable[[str], str] | None = None,
    digits: bool = False,
) -> Detector:
    """A detector from one pattern and an optional rule on the match; also for users' own entities."""

    def spans(text: str, mode: str) -> str:
        return regex_spans(text, pattern, entity, score, name, valid)

    return Detector(name, entity, spans, gate, digits)


_PHONE_LEADING_RUN = r"\A *(\+?[0-9](?:[ ().-]*+[0-9])*+)"


def _phone(text: str, mode: str) -> str:
    this = (P.PHONE_NUMBER, P.STRONG, "PhoneRecognizer")
    entity, score, name = this
    parts = [
        regex_spans(text, rx, entity, score, name) for rx in (P.PHONE_UK, P.PHONE_US, P.PHONE_E164)
    ]
    anywhere = f"concat({', '.join(parts)})"
    # byte length of the span when the text, once its blanks are taken out, opens with a phone number
    opening = let(
        f"replace({text}, ' ', '')",
        "v",
        f"""CASE WHEN startswith(v, '+44') THEN least(octet_length(v), 13)
          WHEN startswith(v, '+1') AND octet_length(v) >= 11 THEN least(octet_length(v), 12)
          WHEN startswith(v, '07') AND octet_length(v) >= 10 THEN 10
          WHEN substr(v, 1, 2) IN ('01', '02', '03', '08') AND octet_length(v) >= 9
            THEN if(substring(CAST(v AS binary), 10, 1) BETWEEN X'30' AND X'39', 10, 9) END""",
    )
    opening = f"if({_may_open_with_phone(text)}, {opening}, CAST(NULL AS int))"
    if mode == SAFE:
        run = f"regexp_extract({text}, {quoted(_PHONE_LEADING_RUN)}, 1)"
        blanks = f"length({text}) - length(ltrim({text}))"
        whole = one_span(entity, blanks, f"{blanks} + octet_length({run})", run, score, name)
        first = f"if({opening} IS NOT NULL AND {run} != '', {whole}, {EMPTY})"
        return distinct_spans(f"concat({first}, {anywhere})")
    # the length counts the compact text, so the span may end before the readable number does
    head = f"make_valid_utf8(CAST(substring(CAST({text} AS binary), 1, n) AS string))"
    fixed = let(opening, "n", one_span(entity, "0", "n", head, score, name))
    # what is bound by ``let`` is interpreted; most texts with numbers have no phone number and stop at compiled tests
    any_phone = " OR ".join(f"rlike({text}, {quoted(rx)})" for rx in (P.PHONE_UK, P.PHONE_US, P.PHONE_E164))
    return f"if({opening} IS NOT NULL, {fixed}, if({any_phone}, {distinct_spans(anywhere)}, {EMPTY}))"


def _ipv4(text: str, mode: str) -> str:
    this = (P.IP_ADDRESS_V4, P.STRONG, "IPv4Recognizer")
    networks = regex_spans(text, P.IPV4_CIDR, *this)
    hosts = regex_spans(text, P.IPV4, *this)
    if mode == SAFE:
        return f"concat({networks}, {hosts})"
    return f"if(rlike({text}, {quoted(P.IPV4_CIDR)}), {networks}, {hosts})"


def _ipv6(text: str, mode: str) -> str:
    entity, name = P.IP_ADDRESS_V6, "IPv6Recognizer"
    this = (entity, P.STRONG, name)
    loopback = literal_span(text, "::1", *this)
    addresses = regex_spans(text, P.IPV6, *this, V.ipv6)
    start = f"octet_length(substring_index({text}, '::/', 1))"
    width = f"regexp_extract(substr({text}, length(substring_index({text}, '::/', 1)) + 4), r'\\A[0-9]+', 0)"
    any_network = one_span(
        entity, start, f"{start} + 3 + length({width})", f"concat('::/', {width})", P.MEDIUM, name
    )
    first, second = P.IPV6_NETWORKS
    special = f"""CASE
      WHEN contains({text}, '{first}') THEN {literal_span(text, first, *this)}
      WHEN contains({text}, '{second}') THEN {literal_span(text, second, *this)}
      WHEN contains({text}, '::/') AND {width} != '' THEN {any_network}
      WHEN {text} = '::' THEN {one_span(entity, "0", "2", "'::'", P.MEDIUM, name)}
      ELSE {EMPTY} END"""
    found = let(addresses, "found", f"if(size(found) > 0, found, {special})")
    has_loopback = f"contains({text}, '::1') AND rlike({text}, {quoted(P.IPV6_LOOPBACK)})"
    if mode == SAFE:
        every = regex_spans(text, "::1", *this)
        return f"if({has_loopback}, concat({every}, {found}), {found})"
    return f"if({has_loopback}, {loopback}, {found})"


def _dob(text: str, mode: str) -> str:
    # the three shapes differ within their first five characters, so no two can start at one place
    this = (P.DATE_OF_BIRTH, P.STRONG, "DobRecognizer")
    return "concat({}, {}, {})".format(
        regex_spans(text, P.DOB_NUMERIC, *this, V.dob_numeric),
        regex_spans(text, P.DOB_ISO, *this, V.dob_iso),
        regex_spans(text, P.DOB_MONTH, *this, V.dob_month),
    )


def _email(text: str, mode: str) -> str:
    return regex_spans(text, P.EMAIL, P.EMAIL_ADDRESS, P.STRONG, "EmailRecognizer", V.email)


DETECTORS: tuple[Detector, ...] = (
    Detector("EmailRecognizer", P.EMAIL_ADDRESS, _email, _has_at),
    Detector("PhoneRecognizer", P.PHONE_NUMBER, _phone, _has_number, True),
    regex_detector("UkPostcodeRecognizer", P.UK_POSTCODE, P.POSTCODE, gate=_has_postcode, digits=True),
    regex_detector("UkNinoRecognizer", P.UK_NINO, P.NINO, valid=V.nino, gate=_has_number, digits=True),
    regex_detector("UKNHSRecognizer", P.UK_NHS_NUMBER, P.NHS, valid=V.nhs, gate=_has_number, digits=True),
    regex_detector("CreditCardRecognizer", P.CREDIT_CARD, P.CARD, valid=V.card, gate=_has_number, digits=True),
    regex_detector("IbanRecognizer", P.IBAN_ENTITY, P.IBAN, valid=V.iban, gate=_has_iban, digits=True),
    Detector("IPv4Recognizer", P.IP_ADDRESS_V4, _ipv4, _has_ipv4, True),
    Detector("IPv6Recognizer", P.IP_ADDRESS_V6, _ipv6, _has_colon),
    Detector("DobRecognizer", P.DATE_OF_BIRTH, _dob, _has_date, True),
    regex_detector("UsSsnRecognizer", P.US_SSN, P.SSN, valid=V.ssn, gate=_has_number, digits=True),
    regex_detector(
        "PassportRecognizer", P.PASSPORT_NUMBER, P.PASSPORT, score=P.WEAK, gate=_has_number, digits=True
    ),
    # people are found by column name only
    Detector("PersonRecognizer", P.PERSON, lambda text, mode: EMPTY, _never),
)


def choose(
    entities: Iterable[str] | None = None,
    add: Iterable[Detector] = (),
    remove: Iterable[str] = (),
) -> tuple[Detector, ...]:
    """Detectors for the wanted entities, with own ones added and named ones removed.

    Only the chosen ones enter the plan. An added detector replaces one of the same name.
    """
    by_name = {d.name: d for d in DETECTORS}
    by_name.update({d.name: d for d in add})
    for name in remove:
        by_name.pop(name, None)
    wanted = None if entities is None else set(entities)
    return tuple(d for d in by_name.values() if wanted is None or d.entity in wanted)


def _name(text: str) -> str:
    return f"`{text}`" if re.fullmatch(r"\w+", text) else text


def raw_spans_sql(
    text: str, detectors: Iterable[Detector] | None = None, mode: str = REFERENCE
) -> str:
    text = _name(text)
    by_gate: dict[tuple, list[str]] = {}
    for d in DETECTORS if detectors is None else detectors:
        by_gate.setdefault((d.digits, d.gate), []).append(d.spans(text, mode))
    with_digits, others = [], []
    for (digits, gate), found in by_gate.items():
        opened = f"if({'true' if gate is None else gate(text)}, concat({', '.join(found)}), {EMPTY})"
        (with_digits if digits else others).append(opened)
    if with_digits:
        others.append(f"if(rlike({text}, '[0-9]'), concat({', '.join(with_digits)}), {EMPTY})")
    return f"if({text} IS NULL, {EMPTY}, concat({', '.join(others) or EMPTY}))"


def analyze_sql(
    text: str,
    detectors: Iterable[Detector] | None = None,
    min_score: float = P.MIN_SCORE,
    mode: str = REFERENCE,
) -> str:
    return merge_spans(raw_spans_sql(text, detectors, mode), min_score)


def raw_spans(
    text: str, detectors: Iterable[Detector] | None = None, mode: str = REFERENCE
) -> Column:
    """Every hit of the detectors, before any threshold. ``text`` names a string column.

    Null texts have no spans.
    """
    return F.expr(raw_spans_sql(text, detectors, mode))


def analyze(
    text: str,
    detectors: Iterable[Detector] | None = None,
    min_score: float = P.MIN_SCORE,
    mode: str = REFERENCE,
) -> Column:
    """Spans of one text: threshold, order, best of equal extents."""
    return F.expr(analyze_sql(text, detectors, min_score, mode))
