"""Spans of personal data inside a text, as Spark SQL expressions.

A span is ``struct<entity, start, end, match, score, recognizer>``; ``start`` and ``end`` are byte
offsets in the UTF-8 text. All functions here take and return SQL expression text: one narrow stage, no
Python worker, no shuffle. (The same expressions made call by call through the Column API took seconds
to build on the driver, which is more than small jobs take to run.)
"""

from __future__ import annotations

from collections.abc import Callable

SPAN_FIELDS = "entity:string,start:int,end:int,match:string,score:double,recognizer:string"
EMPTY = f"CAST(array() AS array<struct<{SPAN_FIELDS}>>)"


def quoted(text: str) -> str:
    """A SQL string literal that keeps backslashes as they are."""
    if "'" in text:
        raise ValueError("write a single quote in a pattern as \\x27")
    return f"r'{text}'"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``.

    Without this, an expression named twice is computed twice, or once per element inside a lambda.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def span(entity: str, start: str, end: str, match: str, score: float, recognizer: str) -> str:
    return (
        f"named_struct('entity', '{entity}', 'start', CAST({start} AS int), 'end', CAST({end} AS int),"
        f" 'match', {match}, 'score', {score}D, 'recognizer', '{recognizer}')"
    )


def one_span(*args) -> str:
    return f"array({span(*args)})"


def regex_spans(
    text: str,
    pattern: str,
    entity: str,
    score: float,
    recognizer: str,
    valid: Callable[[str], str] | None = None,
) -> str:
    """All matches of ``pattern`` which pass ``valid``, in text order.

    The text is cut at the matches; adding up the byte lengths of (gap, match) pairs gives the offsets.
    ``rlike`` goes first: most texts stop there. A match is never empty. Most other texts have one match, which needs no sums.
    """
    rx = quoted(pattern)
    rule = (lambda m: f"coalesce({valid(m)}, false)") if valid else (lambda m: "true")
    after = "octet_length(ps[0]) + octet_length(ps[1])"
    one = f"if({rule('ps[1]')}, {one_span(entity, 'octet_length(ps[0])', after, 'ps[1]', score, recognizer)}, {EMPTY})"
    pieces = """transform(filter(ps, (p, i) -> i % 2 = 0), (g, i) -> named_struct(
      'size', octet_length(g) + coalesce(octet_length(get(ps, 2 * i + 1)), 0), 'm', get(ps, 2 * i + 1)))"""
    ends = f"if(size(pz) <= {_FEW}, {_sums('pz')}, {_MANY_SUMS})"
    hits = f"""filter(zip_with(pz, {ends}, (p, e) -> named_struct('m', p.m, 'end', e)),
      x -> x.m IS NOT NULL AND {rule('x.m')})"""
    start = "x.end - octet_length(x.m)"
    found = f"transform({hits}, x -> {span(entity, start, 'x.end', 'x.m', score, recognizer)})"
    cut = let(_pieces(text, rx), "ps", f"if(size(ps) = 3, {one}, {let(pieces, 'pz', found)})")
    return f"if(rlike({text}, {rx}), {cut}, {EMPTY})"


def _pieces(text: str, rx: str) -> str:
    """What stands before the first match, that match, what stands before the second, and so on; the rest comes last.

    ``split`` compiles its pattern for every row, which costs more than all else done to a short text; ``regexp_replace``
    keeps it. So matches are put between marks, and ``split`` gets that one character, which needs no pattern.
    A text that holds the mark itself is split by the pattern.
    """
    marked = f"split(regexp_replace({text}, {rx}, concat({_MARK}, '$0', {_MARK})), {_MARK}, -1)"
    pairs = f"""zip_with(split({text}, {rx}, -1), regexp_extract_all({text}, {rx}, 0),
      (g, m) -> if(m IS NULL, array(g), array(g, m)))"""
    return f"if(contains({text}, {_MARK}), flatten({pairs}), {marked})"


_MARK = "'\\u0001'"
_INTS = "CAST(array() AS array<int>)"


def _sums(pieces: str) -> str:
    """Running sums of the piece sizes."""
    return f"""aggregate({pieces}, named_struct('pos', 0, 'out', {_INTS}),
      (acc, p) -> named_struct('pos', acc.pos + p.size, 'out', concat(acc.out, array(acc.pos + p.size))),
      acc -> acc.out)"""


def _chunked(array: str, body: str) -> str:
    """``body`` of every ``chunk`` of 256 elements of an array that is not empty."""
    last = f"CAST((size({array}) - 1) div 256 AS int)"
    return f"transform(transform(sequence(0, {last}), c -> slice({array}, c * 256 + 1, 256)), chunk -> {body})"


# An aggregate copies its state at every step, so a state that grows with the text would cost the square
# of the number of hits. That is the fastest way for few hits; for more, running sums go by chunks of 256:
# within a chunk, then over the chunks' totals.
_FEW = 64
_BASES = f"""aggregate(sums, named_struct('pos', 0, 'out', {_INTS}),
  (acc, c) -> named_struct('pos', acc.pos + element_at(c, -1), 'out', concat(acc.out, array(acc.pos))),
  acc -> acc.out)"""
_MANY_SUMS = let(
    _chunked("pz", _sums("chunk")),
    "sums",
    f"flatten(zip_with(sums, {_BASES}, (c, b) -> transform(c, v -> b + v)))",
)


def distinct_spans(spans: str) -> str:
    """Equal spans once, in text order."""
    once = "filter(ds, (s, i) -> i = 0 OR get(ds, i - 1) != s)"
    return let(f"sort_array({spans})", "ds", f"if(size(ds) < 2, ds, {once})")


def literal_span(text: str, literal: str, entity: str, score: float, recognizer: str) -> str:
    """At most one span: the first place of a fixed ASCII string."""
    start = f"octet_length(substring_index({text}, '{literal}', 1))"
    one = one_span(entity, start, f"{start} + {len(literal)}", f"'{literal}'", score, recognizer)
    return f"if(contains({text}, '{literal}'), {one}, {EMPTY})"


def merge_spans(spans: str, min_score: float) -> str:
    """Drop weak spans, sort by start, then longest first, and keep the best of equal extents.

    Equal scores are settled by entity name, so the result does not depend on detector order.
    Overlapping spans of different extent stay. Structs sort field by field, so the order is spelled
    by the order of the fields.
    """
    ordered = f"""sort_array(transform(filter(raw, s -> s.score >= {min_score}D),
      s -> named_struct('start', s.start, 'neg_end', -s.end, 'neg_score', -s.score,
        'entity', s.entity, 'match', s.match, 'recognizer', s.recognizer)))"""
    first_of_extent = """transform(
      filter(a, (s, i) -> NOT coalesce(
        get(a, i - 1).start = s.start AND get(a, i - 1).neg_end = s.neg_end, false)),
      s -> named_struct('entity', s.entity, 'start', s.start, 'end', -s.neg_end, 'match', s.match,
        'score', -s.neg_score, 'recognizer', s.recognizer))"""
    # most texts have no span at all, or one: they skip the sort
    few = f"if(size(raw) = 0, {EMPTY}, if(raw[0].score >= {min_score}D, raw, {EMPTY}))"
    return let(
        spans, "raw", f"if(size(raw) < 2, {few}, {let(ordered, 'a', first_of_extent)})"
    )


def cut_overlaps(spans: str) -> str:
    """Walk sorted spans left to right and skip those starting before the last kept end.

    Each kept span also gets ``prev``, the end of the kept span before it. ``spans`` is the name of a
    bound array. Of many spans only the places are collected, by chunks, for the reason given above.
    """
    within = f"""aggregate(chunk, named_struct('last', acc.last, 'out', {_INTS}),
      (w, s) -> if(s.start < w.last, w,
        named_struct('last', s.end, 'out', concat(w.out, array(s.place)))))"""
    numbered = f"transform({spans}, (s, i) -> named_struct('start', s.start, 'end', s.end, 'place', i))"
    chunks = let(numbered, "ns", _chunked("ns", "chunk"))
    step = let(
        within, "w", "named_struct('last', w.last, 'out', concat(acc.out, w.out))"
    )
    kept = f"""aggregate({chunks}, named_struct('last', 0, 'out', {_INTS}),
      (acc, chunk) -> {step}, acc -> acc.out)"""
    rows = let(
        kept,
        "ks",
        f"""transform(ks, (k, i) -> named_struct('prev', if(i = 0, 0, {spans}[ks[i - 1]].end),
          'entity', {spans}[k].entity, 'start', {spans}[k].start, 'end', {spans}[k].end,
          'match', {spans}[k].match))""",
    )
    none = "CAST(array() AS array<struct<prev:int,entity:string,start:int,end:int,match:string>>)"
    few = f"""aggregate({spans}, named_struct('last', 0, 'out', {none}),
      (acc, s) -> if(s.start < acc.last, acc, named_struct('last', s.end, 'out', concat(acc.out,
        array(named_struct('prev', acc.last, 'entity', s.entity, 'start', s.start, 'end', s.end,
          'match', s.match))))),
      acc -> acc.out)"""
    return f"if(size({spans}) <= {_FEW}, {few}, {rows})"


def _highest(array: str) -> str:
    """Running maxima of an array of whole numbers that is not empty."""
    one = lambda items: f"""aggregate({items}, named_struct('top', -1, 'out', {_INTS}), (acc, v) -> named_struct(
      'top', greatest(acc.top, v), 'out', concat(acc.out, array(greatest(acc.top, v)))), acc -> acc.out)"""  # noqa: E731
    bases = f"""aggregate(tops, named_struct('top', -1, 'out', {_INTS}), (acc, c) -> named_struct(
      'top', greatest(acc.top, element_at(c, -1)), 'out', concat(acc.out, array(acc.top))), acc -> acc.out)"""
    many = let(
        _chunked(array, one("chunk")),
        "tops",
        f"flatten(zip_with(tops, {bases}, (c, b) -> transform(c, v -> greatest(b, v))))",
    )
    return f"if(size({array}) <= {_FEW}, {one(array)}, {many})"


def join_overlaps(spans: str) -> str:
    """Unite sorted spans that overlap: one extent each, with the entity of the best score, then the longest.

    Gives what ``cut_overlaps`` gives, less ``match``. ``spans`` is the name of a bound array.
    """
    none = "CAST(array() AS array<struct<prev:int,entity:string,start:int,end:int>>)"
    # a group begins where no earlier span reaches; ``reach`` is the furthest end up to each span
    firsts = f"""filter(transform({spans}, (s, i) -> if(i > 0 AND s.start < get(reach, i - 1), -1, i)), i -> i >= 0)"""
    best = f"""array_max(transform(slice({spans}, f + 1, stop - f), s ->
      named_struct('score', s.score, 'size', s.end - s.start, 'entity', s.entity))).entity"""
    group = let(
        f"coalesce(get(firsts, n + 1), size({spans}))",
        "stop",
        f"""named_struct('prev', if(f = 0, 0, get(reach, f - 1)), 'entity', {best},
          'start', {spans}[f].start, 'end', get(reach, stop - 1))""",
    )
    groups = let(firsts, "firsts", f"transform(firsts, (f, n) -> {group})")
    ends = let(f"transform({spans}, s -> s.end)", "ends", _highest("ends"))
    return f"if(size({spans}) = 0, {none}, {let(ends, 'reach', groups)})"
