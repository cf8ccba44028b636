"""Personal data in texts, by weak supervision.

Patterns propose candidates. Four labellers vote on each: the rule of its kind (checksums, ranges), a gazetteer
(domains, issuers, area codes, reserved networks), the words before it, and its shape. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeller is for each answer, without labels. The
posteriors then train a logistic span classifier on features of the span and its surroundings, and the classifier
decides on the candidates that no fixed rule decides. Spans that pass the fixed rules always stay.

Texts are scanned by SQL expressions in one narrow stage. What comes to the driver are counts per vote and
feature pattern, a few thousand rows whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import _FEW, _MANY_SUMS, _sums, let
from .common import col, table, written
from .weak import reliabilities

# Patterns are possessive where nothing can follow, and start where a run starts (or the last match ended), so
# that long runs cost linear time. They match what their plain forms match.
_LOCAL = "A-Za-z0-9._%+-"
KINDS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # kinds without a fixed rule: the classifier alone decides
    "at": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]{{1,64}}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}+)++",
    "tel": r"(?<![0-9+])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
NAMES = tuple(KINDS)
_GATE = {"email": "contains(text, '@')", "phone": "contains(text, '+')", "at": "contains(text, 'at)') OR contains(text, 'at]')"}

# gazetteers
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "uk", "de", "fr", "es", "it", "nl", "ch", "at", "us", "ca")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "22", "23", "24", "25", "26", "27")
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "4", "5", "6", "81", "82", "84", "86", "9")
# words before a span that speak for personal data, and against it
CUES = "mail|phone|tel|call|fax|mobile|contact|reach|card|visa|credit|paid|addr|host|client|ssn|social|write|ask"
DOUBTS = "version|release|isbn|serial|order|page|part|item|ref|no|nr|id|lot|build|section"
CONTEXT = 24  # characters before a span

_DIGITS = "regexp_replace(m, '[^0-9]', '')"


def _rule(kind: str) -> str:
    return {
        "email": "true",
        "ip": "forall(split(m, '[.]'), x -> length(ltrim('0', x)) <= 3 AND CAST(concat('0', right(ltrim('0', x), 4)) AS int) <= 255)",
        "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND luhn_check({_DIGITS})",
        "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    }.get(kind, "CAST(null AS boolean)")


def _gazetteer(kind: str) -> str:
    starts = lambda values: " OR ".join(f"startswith({_DIGITS}, '{v}')" for v in values)
    if kind in ("email", "at"):
        return f"lower(substring_index(m, '.', -1)) IN ({', '.join(repr(d) for d in DOMAINS)})"
    if kind == "ip":
        return "NOT (startswith(m, '0.') OR startswith(m, '127.') OR startswith(m, '255.'))"
    if kind == "card":
        return starts(ISSUERS)
    if kind == "phone":
        return starts(COUNTRIES)
    if kind == "tel":
        return f"substr({_DIGITS}, 1, 1) >= '2' AND substr({_DIGITS}, 4, 1) >= '2'"
    return "substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 1) != '9' AND substr(m, 5, 2) != '00' AND substr(m, 8, 4) != '0000'"


def _shape(kind: str) -> str:
    return {
        "email": r"m RLIKE '^[A-Za-z0-9][^@]{0,62}[A-Za-z0-9]@[^@]{4,}$'",
        "ip": "length(m) <= 15 AND NOT m RLIKE '(^|[.])0[0-9]'",
        "card": r"m RLIKE '^([0-9]{13,19}|[0-9]{4}([\\x20-])[0-9]{4}\\2[0-9]{4}\\2[0-9]{4})$'",
        "phone": r"m RLIKE '^[+][0-9]{1,3}[\\x20.-]?([(][0-9]{1,4}[)]|[0-9]{2,4})([\\x20.-]?[0-9]{2,5}){1,4}$'",
        "at": r"m RLIKE '^[A-Za-z0-9]'",
        "tel": r"m RLIKE '^([(][0-9]{3}[)]\\x20[0-9]{3}-[0-9]{4}|[0-9]{3}([.-])[0-9]{3}\\2[0-9]{4})$'",
        "ssn": "true",
    }[kind]


def _vote(test: str) -> str:
    """'+' for, '-' against, '0' for no opinion."""
    return f"CASE WHEN {test} THEN '+' WHEN NOT ({test}) THEN '-' ELSE '0' END"


_CLASS = r"""CASE WHEN c = '' THEN '_' WHEN c RLIKE '^[0-9]$' THEN '9' WHEN c RLIKE '^\\p{L}$' THEN 'a'
  WHEN c RLIKE '^\\s$' THEN ' ' ELSE c END"""


def _spans(kind: str) -> str:
    """array<struct<kind, start, end, base, votes, feature>> of one kind, in text order, offsets in code points."""
    rx = f"r'{KINDS[kind]}'"
    pieces = f"""zip_with(split(text, {rx}, -1), regexp_extract_all(text, {rx}, 0), (g, m) -> named_struct(
      'size', length(g) + coalesce(length(m), 0), 'm', m, 'before', right(g, {CONTEXT}), 'after', ''))"""
    ends = f"if(size(pz) <= {_FEW}, {_sums('pz')}, {_MANY_SUMS})"
    found = f"filter(zip_with(pz, {ends}, (p, e) -> named_struct('m', p.m, 'before', p.before, 'end', e)), x -> x.m IS NOT NULL)"
    words = "lower(x.before)"
    context = rf"""CASE WHEN {words} RLIKE '(?<![a-z])({DOUBTS})[^a-z0-9]*$' THEN '-'
      WHEN {words} RLIKE '(?<![a-z])({CUES})' THEN '+' ELSE '0' END"""
    votes = f"concat({_vote(_rule(kind))}, {_vote(_gazetteer(kind))}, {context}, {_vote(_shape(kind))})"
    # the classifier sees the span and its surroundings, not the votes
    edge = let("right(x.before, 1)", "c", _CLASS)
    mask = "regexp_replace(regexp_replace(regexp_replace(m, '[0-9]+', '9'), '[A-Za-z]+', 'a'), '[._%+]', '.')"
    feature = f"concat('{kind}|', least(length(m) div 3, 9), '|', left({mask}, 8), '|', {edge}, '|', (x.before RLIKE '[:=]\\\\s*$'))"
    one = f"""named_struct('kind', {NAMES.index(kind)}, 'start', x.end - length(m), 'end', x.end,
      'base', coalesce({_rule(kind)}, false), 'votes', {votes}, 'feature', {feature})"""
    body = let(pieces, "pz", f"transform({found}, x -> {let('x.m', 'm', one)})")
    gate = f"({_GATE[kind]}) AND " if kind in _GATE else ""
    return f"if({gate}rlike(text, {rx}), {body}, {_NOTHING})"


_NOTHING = "CAST(array() AS array<struct<kind:int,start:int,end:int,base:boolean,votes:string,feature:string>>)"


def candidates(text: str) -> str:
    """All candidate spans of a text column as SQL; none for null and empty texts."""
    parts = ", ".join(_spans(k) for k in NAMES)
    return let(f"coalesce({text}, '')", "text", f"concat({parts})")


def fields(feature: str) -> list[str]:
    """What the classifier weighs: each part of a feature string, with its kind, and the kind."""
    kind, *parts = feature.split("|")
    return [kind, *(f"{kind}|{i}|{p}" for i, p in enumerate(parts))]


def train_classifier(rows: list[tuple[str, float, float]], rounds: int = 300, rate: float = 0.5) -> dict[str, float]:
    """Weights of a logistic model from (feature string, weight of personal data, weight of other), by descent."""
    weights: dict[str, float] = {}
    total = sum(p + q for _, p, q in rows) or 1.0
    split = [(fields(f), p, q) for f, p, q in rows]
    for _ in range(rounds):
        step: dict[str, float] = {}
        mass: dict[str, float] = {}
        for names, p, q in split:
            z = sum(weights.get(n, 0.0) for n in names)
            y = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
            for n in names:
                step[n] = step.get(n, 0.0) + p - (p + q) * y
                mass[n] = mass.get(n, 0.0) + p + q
        for n, g in step.items():
            # each weight by the share of its own rows, so that rare fields learn as fast as common ones
            weights[n] = weights.get(n, 0.0) + rate * (g - 0.001 * total / len(step) * weights.get(n, 0.0)) / mass[n]
    return weights


def fit(found: DataFrame) -> dict[str, float]:
    """Classifier weights from a table with candidate arrays in ``hits``, counted over all its rows."""
    one = found.filter("size(hits) > 0").select(F.explode("hits").alias("h"))
    patterns = one.groupBy("h.kind", "h.votes", "h.feature").agg(F.count("*").alias("n")).collect()
    counts: dict[tuple[str, str], int] = {}
    for r in patterns:
        key = (NAMES[r["kind"]], r["votes"])
        counts[key] = counts.get(key, 0) + r["n"]
    post = reliabilities(counts)
    rows: dict[str, list[float]] = {}
    for r in patterns:
        q = post[NAMES[r["kind"]], r["votes"]]
        own = rows.setdefault(r["feature"], [0.0, 0.0])
        own[0] += r["n"] * q
        own[1] += r["n"] * (1 - q)
    return train_classifier([(f, p, q) for f, (p, q) in sorted(rows.items())])


def accepted(hits: str, weights: dict[str, float], least: float = 0.9) -> str:
    """The spans that stay, by kind and start: those of the fixed rules, and others of probability ``least`` that
    do not overlap them."""
    known = sorted(weights)
    if not known:
        return f"array_sort(filter({hits}, h -> h.base))"
    names = ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in known)
    values = ", ".join(f"{weights[n]:.9g}D" for n in known)
    model = f"map_from_arrays(array({names}), array({values}))"
    parts = "concat(array(f[0]), transform(slice(f, 2, 9), (p, i) -> concat(f[0], '|', i, '|', p)))"
    log = f"aggregate({parts}, 0.0D, (s, p) -> s + coalesce(try_element_at({model}, p), 0.0D))"
    ok = let("split(h.feature, '[|]', 5)", "f", f"{log} >= {math.log(least / (1 - least)):.9g}D")
    apart = "NOT exists(filter(found, b -> b.base), b -> b.start < h.end AND h.start < b.end)"
    return let(hits, "found", f"array_sort(filter(found, h -> h.base OR ({ok} AND {apart})))")


def spelled(spans: str) -> str:
    """``kind:start:end``, joined by commas."""
    names = "array(" + ", ".join(f"'{n}'" for n in NAMES) + ")"
    return f"array_join(transform({spans}, h -> concat_ws(':', {names}[h.kind], h.start, h.end)), ',')"


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, hits.

    Counts and digest are of the fixed rules' spans; ``spans`` also has what the classifier adds. Null and empty
    texts have none. Spans of different kinds may overlap. Ties cannot occur: a kind has one span per start.
    Repeated rows and null ids give a row each; other columns are not read. Without any candidate there is no
    model and nothing is added.
    """
    src = df.select(col(id_col).alias("id"), F.expr(candidates(f"`{text_col}`")).alias("hits"))
    found = written(src, "pii")
    weights = fit(found)
    rows = found.withColumn("stay", F.expr(accepted("hits", weights, least)))
    counts = [F.expr(f"CAST(size(filter(stay, h -> h.base AND h.kind = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return rows.select(
        F.col("id").alias(id_col), *counts,
        F.expr(f"sha2({spelled('filter(stay, h -> h.base)')}, 256)").alias("base_sha256"),
        F.expr(spelled("stay")).alias("spans"),
    )


def redact(df: DataFrame, text_col: str = "text", least: float = 0.9) -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by its kind in angle brackets, e.g. ``<email>``.

    Overlapping spans become one, named by the first. Null texts stay null; all other columns are as they were.
    The model is fitted on all rows first, in a scan of its own.
    """
    text = f"`{text_col}`"
    weights = fit(df.select(F.expr(candidates(text)).alias("hits")))
    names = "array(" + ", ".join(f"'<{n}>'" for n in NAMES) + ")"
    spans = accepted(candidates(text), weights, least)
    by_place = f"""array_sort(transform({spans}, h -> named_struct('start', h.start, 'far', -h.end, 'end', h.end, 'kind', h.kind)))"""
    cut = f"""aggregate(spans, named_struct('at', 0, 'out', CAST(array() AS array<string>)), (acc, h) -> CASE
        WHEN h.start >= acc.at THEN named_struct('at', h.end, 'out',
          concat(acc.out, array(substring({text}, acc.at + 1, h.start - acc.at), {names}[h.kind])))
        ELSE named_struct('at', greatest(acc.at, h.end), 'out', acc.out) END,
      acc -> concat(array_join(acc.out, ''), substring({text}, acc.at + 1, length({text}))))"""
    done = let(by_place, "spans", f"if(size(spans) = 0, {text}, {cut})")
    return df.withColumn(text_col, F.expr(f"if({text} IS NULL, CAST(null AS string), {done})"))


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return find_personal_data(table(spark, folder, "documents"))
