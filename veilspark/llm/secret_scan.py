"""Secrets in texts: fixed patterns, and formats learned by grammar inference.

Credentials that the patterns find in all documents are labelled strings; a bounded sample of distinct ones is learned. Per kind they make a prefix tree
with counts; states whose futures are statistically compatible (Hoeffding's bound on every symbol's share and on
ending) are merged, which leaves a probabilistic automaton of the format. Every other credential-like run of
characters in the corpus is scored by its likelihood under each automaton against that of ordinary words. What is
ordinary is learned from words too short to be a credential, so no candidate, however frequent, can pass for ordinary.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, id_field, slices, table, utf8, written

# fixed values: the base patterns
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")

RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
SEPARATORS = "./="  # in the order in which a run that has no format is taken apart
SAMPLE_STRINGS = 400  # per kind
SAMPLE_CHARACTERS = 200_000  # of the sampled strings of a kind together; strings are taken whole or not at all
ALPHA = 0.05

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"  # of assigned values
SHORTEST = 12  # characters of a credential; shorter words are ordinary
WIDTH = len(ALPHABET) + 1
UNKNOWN = 1 / 16  # share of ordinary characters that follow no rule
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, WIDTH)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of the fixed patterns, in code points."""
    out = []
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 12:
                out.append((m.start(), 0, m.end(), m.group(1)))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(out)


def _class(c: str) -> str:
    return "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "+" if c else ""


@dataclass(slots=True)
class State:
    passes: int = 0
    ends: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    to: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton, inferred from strings by merging states of their prefix tree."""

    def __init__(self, strings: Iterable[str], alpha: float = ALPHA):
        self.states = [State()]
        for s in sorted(strings):
            at = 0
            self.states[0].passes += 1
            for c in s:
                here = self.states[at]
                here.counts[c] = here.counts.get(c, 0) + 1
                if c not in here.to:
                    here.to[c] = len(self.states)
                    self.states.append(State())
                at = here.to[c]
                self.states[at].passes += 1
            self.states[at].ends += 1
        self._share = self._shares()
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        # per state, by character: what it costs and where it leads; "" stands for characters that no credential has
        self._rows = [{c: self._move(s, c) for c in ["", *ALPHABET, *s.counts]} for s in self.states]
        self._ends = [-math.log2(self._smooth(s.ends, s, "")) for s in self.states]

    def _shares(self) -> dict[str, float]:
        """Share of each character, and of ending (''), by its class: what the strings say of characters not seen."""
        total, seen = 0, dict.fromkeys(map(_class, ["", *ALPHABET]), 0)
        for s in self.states:
            total += s.passes
            seen[""] += s.ends
            for c, n in s.counts.items():
                seen[_class(c)] += n
        sizes = {k: sum(_class(c) == k for c in ["", *ALPHABET]) for k in seen}
        return {c: (seen[_class(c)] + 1) / (total + len(seen)) / sizes[_class(c)] for c in ["", *ALPHABET]}

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 < n2 and abs(f1 / n1 - f2 / n2) > self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        open_ = [(a, b)]
        while open_:
            x, y = (self.states[i] for i in open_.pop())
            if self._differ(x.ends, x.passes, y.ends, y.passes):
                return False
            for c in y.counts.keys() | x.counts.keys():
                if self._differ(x.counts.get(c, 0), x.passes, y.counts.get(c, 0), y.passes):
                    return False
                if c in x.to and c in y.to:
                    open_.append((x.to[c], y.to[c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the tree below ``tree`` to the states from ``into`` on."""
        open_ = [(into, tree)]
        while open_:
            a, b = open_.pop()
            x, y = self.states[a], self.states[b]
            x.passes += y.passes
            x.ends += y.ends
            for c, n in y.counts.items():
                x.counts[c] = x.counts.get(c, 0) + n
                if c in x.to:
                    open_.append((x.to[c], y.to[c]))
                else:
                    x.to[c] = y.to[c]

    def _merge_all(self) -> None:
        """Settled states are merged with those next to them, the most frequent first, where compatible."""
        settled = [0]
        while True:
            inside = set(settled)
            edge = {t: (s, c) for s in settled for c, t in self.states[s].to.items() if t not in inside}
            if not edge:
                break
            blue = min(edge, key=lambda t: (-self.states[t].passes, t))
            source, symbol = edge[blue]
            for red in settled:
                if self._compatible(red, blue):
                    self.states[source].to[symbol] = red
                    self._fold(red, blue)
                    break
            else:
                settled.append(blue)
        number = {s: i for i, s in enumerate(settled)}
        kept = [self.states[s] for s in settled]
        for s in kept:
            s.to = {c: number[t] for c, t in s.to.items()}
        self.states = kept

    def bits(self, text: str) -> float:
        """-log2 of the likelihood of ``text``. Half a count a character of the alphabet is spread by the shares of
        classes, so that few strings tell a format too. Symbols new to a state lead to its most frequent successor."""
        at, total = 0, 0.0
        for c in text:
            row = self._rows[at]
            cost, at = row.get(c) or row[""]
            total += cost
        return total + self._ends[at]

    def _smooth(self, n: int, s: State, c: str | None) -> float:
        prior = len(ALPHABET) / 2
        return (n + prior * self._share.get(c, 1e-6)) / (s.passes + prior)

    def _move(self, s: State, c: str) -> tuple[float, int]:
        to = s.to.get(c)
        if to is None:
            to = s.to[max(s.counts, key=lambda k: (s.counts[k], k))] if s.to else self.states.index(s)
        return -math.log2(self._smooth(s.counts.get(c, 0), s, c or None)), to


def word_pairs(data: np.ndarray, starts: np.ndarray, longest: int = SHORTEST - 1) -> np.ndarray:
    """How often each character follows each other one (or none) in the words of at most ``longest`` characters."""
    code = _CODE[data]
    solid = code > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    sizes = np.flatnonzero(end) + 1 - np.flatnonzero(begin)
    at = np.flatnonzero(solid)[np.repeat(sizes <= longest, sizes)]
    before = np.where(begin[at], 0, code[at - 1])
    return np.bincount(before * WIDTH + code[at], minlength=WIDTH * WIDTH).reshape(WIDTH, WIDTH)


class Ordinary:
    """Likelihood of a word's characters, each given the one before it, from counts of pairs."""

    def __init__(self, pairs: np.ndarray):
        pairs = pairs.astype(float)[:, 1:]
        prior = (WIDTH - 1) / 2  # half a count a character
        one = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + prior)
        two = (pairs + prior * one) / (pairs.sum(axis=1, keepdims=True) + prior)
        costs = -np.log2((1 - UNKNOWN) * two + UNKNOWN / (WIDTH - 1))
        self.costs = {a: dict(zip(ALPHABET, row)) for a, row in zip(["", *ALPHABET], costs.tolist())}
        self.foreign = math.log2((WIDTH - 1) / UNKNOWN)  # characters that no credential has

    @classmethod
    def of(cls, words: Iterable[str]) -> Ordinary:
        made = pa.array(list(words), pa.string())
        return cls(word_pairs(*utf8(made), longest=1 << 62))

    def bits(self, word: str) -> float:
        """-log2 of the likelihood. Capitals alone are as ordinary as small letters."""
        return min(self._bits(word), self._bits(word.lower())) if word.isupper() else self._bits(word)

    def _bits(self, word: str) -> float:
        before, total = "", 0.0
        for c in word:
            total += self.costs.get(before, {}).get(c, self.foreign)
            before = c
        return total


@dataclass
class Formats:
    """Automata by kind, the model of ordinary words, and the gain in bits a character that a kind asks for."""

    automata: dict[int, Automaton]
    ordinary: Ordinary
    least: dict[int, float]

    def gain(self, kind: int, word: str) -> float:
        return (self.ordinary.bits(word) - self.automata[kind].bits(word)) / len(word)

    def kind(self, word: str) -> int | None:
        """The kind whose format a run has, if any; the greater gain wins, then the kind listed first."""
        other = self.ordinary.bits(word)
        gains = {k: (other - a.bits(word)) / len(word) for k, a in self.automata.items()}
        return min(((-g, k) for k, g in gains.items() if g >= self.least[k]), default=(0, None))[1]

    def spans(self, text: str, taken: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, int]]:
        """(start, kind, end) of runs with a learned format that no base span touches. Dots around a run are no part
        of it. A run without a format, or that a base span touches, is taken apart at its separators."""
        if not self.automata:
            return
        starts, far = [t[0] for t in taken], list(accumulate((t[2] for t in taken), max))
        for m in RUN.finditer(text):
            open_ = [m.span()]
            while open_:
                s, e = open_.pop()
                word = text[s:e]
                if word[0] == "." or word[-1] == ".":
                    inner = word.strip(".")
                    if len(inner) >= SHORTEST:
                        s += len(word) - len(word.lstrip("."))
                        e, word = s + len(inner), inner
                before = bisect_left(starts, e)
                if not (before and far[before - 1] > s) and (k := self.kind(word)) is not None:
                    yield s, k, e
                    continue
                for c in SEPARATORS:
                    if c in word:
                        for part in word.split(c):
                            if len(part) >= SHORTEST:
                                open_.append((s, s + len(part)))
                            s += len(part) + 1
                        break


def infer(labelled: dict[int, list[str]], ordinary: Ordinary | list[str]) -> Formats:
    """Formats from labelled strings per kind and ordinary words. Strings shorter than any candidate teach nothing.
    A run must gain half of what all but one of twenty labelled strings gain, and one bit a character."""
    known = ordinary if isinstance(ordinary, Ordinary) else Ordinary.of(ordinary)
    strings = {k: long for k, v in labelled.items() if (long := [s for s in v if len(s) >= SHORTEST])}
    made = Formats({k: Automaton(v) for k, v in strings.items()}, known, {})
    for k in made.automata:
        gains = sorted(made.gain(k, s) for s in strings[k])
        made.least[k] = max(1.0, gains[len(gains) // 20] / 2)
    return made


def learn_formats(df: DataFrame, id_col: str, text_col: str, strings: int = SAMPLE_STRINGS) -> Formats:
    """Formats learned from the credentials in all documents: per kind from ``strings`` distinct ones, chosen by a
    hash, or from all if there are fewer. Longer samples than ``SAMPLE_CHARACTERS`` end at the last string that fits,
    and a string that is longer alone is not learned from."""
    src = df.select(col(text_col).cast("string").alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((WIDTH, WIDTH), np.int64)
        for batch in batches:
            for piece in slices(batch):
                kinds, words = [], []
                for text in piece["text"].to_pylist():
                    for _, kind, _, word in base_spans(text or ""):
                        kinds.append(kind)
                        words.append(word)
                yield counted(kinds, words, [1] * len(words))
                pairs += word_pairs(*utf8(piece["text"]))
        places = np.flatnonzero(pairs)
        yield counted([len(KINDS)] * len(places), map(str, places.tolist()), pairs.ravel()[places])

    def counted(kinds, words, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.int32()), "word": pa.array(words, pa.string()), "n": pa.array(n, pa.int64())})

    # labelled strings by kind, and last the pairs of characters in ordinary words
    seen = src.mapInArrow(label, "kind int, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    seen = written(seen, "labelled")
    chosen = {}
    for k in range(len(KINDS)):
        some = seen.filter((F.col("kind") == k) & (F.length("word") <= SAMPLE_CHARACTERS)).select("word")
        some = some.orderBy(F.xxhash64("word"), "word").limit(strings)
        sizes = [r[0] for r in some.select(F.length("word")).collect()]
        fits = sum(n <= SAMPLE_CHARACTERS for n in accumulate(sizes))
        chosen[k] = [r["word"] for r in some.limit(fits).collect()]
    pairs = np.zeros(WIDTH * WIDTH)
    for r in seen.filter(F.col("kind") == len(KINDS)).collect():  # WIDTH ** 2 at most
        pairs[int(r["word"])] = r["n"]
    return infer(chosen, Ordinary(pairs.reshape(WIDTH, WIDTH)))


def find_secrets(df: DataFrame, formats: Formats, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans.

    Counts and digest are of the fixed patterns; ``spans`` also has runs of 12 or more
    characters with a learned format, named ``like_<kind>``. Spans are ``kind:start:end`` in code points, by start, then kind as listed, joined by commas.
    Null and empty texts have none. Repeated rows and null ids give a row each; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(formats)
    names = [*KINDS, *(f"like_{k}" for k in KINDS)]
    spell = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for piece in slices(batch):
                counts: list[list[int]] = [[], [], []]
                digests, all_spans = [], []
                for text in piece["text"].to_pylist():
                    found = base_spans(text or "")
                    base = [(s, k, e) for s, k, e, _ in found]
                    for k in range(3):
                        counts[k].append(sum(b[1] == k for b in base))
                    digests.append(hashlib.sha256(spell(base).encode()).hexdigest())
                    more = [(s, k + 3, e) for s, k, e in known.spans(text or "", found)]
                    all_spans.append(spell(sorted(base + more)))
                yield pa.RecordBatch.from_arrays(
                    [piece["id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())],
                    names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    src = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    fields = ", ".join([f"id {id_field(src, 'id')}", *(f"n_{k} bigint" for k in KINDS), "base_sha256 string", "spans string"])
    return src.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, with formats learned from the documents themselves."""
    docs = table(spark, folder, "documents")
    return find_secrets(docs, learn_formats(docs, "doc_id", "text"))
