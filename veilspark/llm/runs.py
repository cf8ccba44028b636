"""Runs: maximal periodic stretches of words, by internal pattern matching.

A slice of texts gets one suffix array, by prefix doubling; suffixes of different texts never compare equal, so
the array lies text by text. The ranks after each doubling name the blocks of 1, 2, 4, .. words exactly, and the
longest common extension of two places is read off them level by level. A wavelet tree over the suffix array answers
range successor: the next place, from a given one on, at which a block occurs.

A run of period q holds a block of ``b`` words, b <= q / 2, that begins at a multiple of b and comes again q words
later. So every dyadic block asks for its occurrences in the two windows of b places that begin 2b and 3b words after
it; periods below 4 are found by blocks of four words, as no run is shorter than ``LEAST``. Two occurrences in a
window are two candidate periods; three or more lie in a progression, whose difference is the block's own period, and of
the progression only those distances are candidates that the two stretches of this difference leave room for. Each
candidate is extended both ways and kept if it is long enough, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, col, id_field, slices, table

LEAST = 12  # words of the shortest run; periods below 4 rest on it being 10 at least


class Suffixes:
    """Suffix array of several texts, given as word numbers in a row and the place of each text's first word."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        n = self.n = len(words)
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.first, self.after = starts[:-1][owner], starts[1:][owner]  # of the text of each place
        _, code = np.unique(owner * (int(words.max(initial=0)) + 1) + words, return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.array = order
        size = np.bincount(code) if n else np.zeros(0, np.int64)
        rank = (np.cumsum(size) - size)[code]
        # levels[k]: where the group of the block of 2**k words that begins at a place begins in the array
        self.levels, self.sizes = [rank], [size[code] if n else size]
        step = 1
        at = np.flatnonzero(size[code[order]] > 1) if n else order  # places in the array that are not settled
        while len(at):
            place = self.array[at]
            ahead = place + step
            inside = ahead < self.after[place]
            follow = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
            key = rank[place] * (n + 1) + follow
            sort = np.argsort(key, kind="stable")
            key, place = key[sort], place[sort]
            self.array[at] = place
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(fresh) - 1
            length = np.bincount(group)
            rank, count = rank.copy(), np.ones(n, np.int64)
            rank[place] = at[fresh][group]
            count[place] = length[group]
            self.levels.append(rank)
            self.sizes.append(count)
            at = at[length[group] > 1]
            step *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from places ``i`` and ``j`` on agree; i < j, both in one text."""
        i, j = i.copy(), j.copy()
        start, end = i.copy(), self.after[i] if len(i) else i
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            open_ = j + (1 << k) <= end
            same = open_ & (rank[i] == rank[np.where(open_, j, i)])
            same &= open_
            i, j = i + (same << k), j + (same << k)
        return i - start

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before places ``i`` and ``j`` agree; i < j, both in one text."""
        start, begin = i, self.first[i] if len(i) else i
        i, j = i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            open_ = i - (1 << k) >= begin
            same = open_ & (rank[np.where(open_, i - (1 << k), 0)] == rank[np.where(open_, j - (1 << k), 0)])
            i, j = i - (same << k), j - (same << k)
        return start - i


class WaveletTree:
    """Bits of the values of an array, most significant first, in packed words with counts; many questions at once."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.depth = max(1, int(self.n).bit_length())
        self.levels = []
        now = values.astype(np.uint64)
        for bit in range(self.depth - 1, -1, -1):
            ones = ((now >> np.uint64(bit)) & np.uint64(1)).astype(bool)
            packed = np.packbits(np.pad(ones, (0, -self.n % 64 + 64)), bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((packed, counts, self.n - int(ones.sum())))
            now = np.concatenate([now[~ones], now[ones]])

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        """Set bits before ``at``."""
        packed, counts, _ = level
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value of at least ``least`` in [low, high) of the array; n where there is none."""
        left, right, below = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for i, level in enumerate(self.levels):
            bit = ((least >> (self.depth - 1 - i)) & 1).astype(bool)
            a, b = self._ones(level, left), self._ones(level, right)
            below += np.where(bit, (right - left) - (b - a), 0)  # values that turn off below ``least``
            left, right = np.where(bit, level[2] + a, left - a), np.where(bit, level[2] + b, right - b)
        found = np.full(len(low), self.n, np.int64)
        some = np.flatnonzero((below < high - low) & (least < (1 << self.depth)))
        left, right, nth, value = low[some], high[some], below[some], np.zeros(len(some), np.int64)
        for level in self.levels:
            a, b = self._ones(level, left), self._ones(level, right)
            zeros = (right - left) - (b - a)
            up = nth >= zeros
            value = (value << 1) | up
            nth = np.where(up, nth - zeros, nth)
            left, right = np.where(up, level[2] + a, left - a), np.where(up, level[2] + b, right - b)
        found[some] = value
        return found


def _windows(s: Suffixes, tree: WaveletTree, level: int, near: int, far: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, distances) of candidates from blocks of ``2**level`` words and their occurrences at a distance of
    ``near`` to ``far - 1`` words."""
    b = 1 << level
    inside = np.arange(s.n) - s.first
    again = s.sizes[level] > 1 if level < len(s.sizes) else np.zeros(s.n, bool)
    at = np.flatnonzero(again & (inside % b == 0) & (np.arange(s.n) + near + b <= s.after))
    if not len(at):
        return
    low = s.levels[level][at]
    high = low + s.sizes[level][at]
    stop = np.minimum(at + far, s.after[at] - b + 1)  # occurrences begin before it
    one = tree.successor(low, high, at + near)
    hit = one < stop
    at, low, high, stop, one = at[hit], low[hit], high[hit], stop[hit], one[hit]
    yield at, one - at
    two = tree.successor(low, high, one + 1)
    hit = two < stop
    at, low, high, stop, one, two = at[hit], low[hit], high[hit], stop[hit], one[hit], two[hit]
    yield at, two - at
    three = tree.successor(low, high, two + 1) < stop
    at, stop, one = at[three], stop[three], one[three]
    step = two[three] - one
    if not len(at):
        return
    # a progression: the stretches of its difference around the block and around the occurrences
    x, y = at - s.back(at, at + step), at + step + s.ahead(at, at + step)
    u, v = one - s.back(one, one + step), one + step + s.ahead(one, one + step)
    apart = (x != u) | (y != v)
    at, stop, one, step, x, y, u, v = (z[apart] for z in (at, stop, one, step, x, y, u, v))
    many = np.maximum(0, -((one - stop) // step))
    which = np.repeat(np.arange(len(at)), many)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    gap = one[which] - at[which] + nth * step[which]
    room = np.minimum(y[which], v[which] - gap) - np.maximum(x[which], u[which] - gap) >= gap
    yield at[which][room], gap[room]


def find_runs_in(words: np.ndarray, starts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of at least ``least`` words, by text, start and period.

    ``starts`` has the place of each text's first word and, last, the number of all words."""
    if len(words) < least:
        return np.zeros((0, 4), np.int64)
    s = Suffixes(words, starts)
    tree = WaveletTree(s.array)
    found = [list(_windows(s, tree, 2, 1, 4))]
    longest = int(np.diff(starts).max())
    level = 1
    while 4 * (1 << level) <= longest:  # the least period of this level is 2b, and a run holds it twice
        b = 1 << level
        found.append(list(_windows(s, tree, level, 2 * b, 3 * b)))
        found.append(list(_windows(s, tree, level, 3 * b, 4 * b)))
        level += 1
    pairs = [p for part in found for p in part]
    if not pairs:
        return np.zeros((0, 4), np.int64)
    at, gap = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    begin = at - s.back(at, at + gap)
    length = at + gap + s.ahead(at, at + gap) - begin
    good = length >= np.maximum(least, 2 * gap)
    begin, length, gap = begin[good], length[good], gap[good]
    order = np.lexsort((gap, length, begin))
    begin, length, gap = begin[order], length[order], gap[order]
    # one stretch under several periods has the least; the others are its multiples
    first = np.ones(len(begin), bool)
    first[1:] = (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])
    begin, length, gap = begin[first], length[first], gap[first]
    order = np.lexsort((gap, begin))
    text = np.searchsorted(starts, begin, side="right") - 1
    return np.column_stack([text, begin - starts[text], length, gap])[order]


def _dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words a run (start, length, period) contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def periodic_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, collapsed: bool = True
) -> DataFrame:
    """One row per input row: id, n_words, runs (array of start, length, period by start, then period) and, with
    ``collapsed``, the text without the words that a run repeats, its words joined by single spaces.

    Words are ``[^\\x20\\x09-\\x0D]+``, case counts, and they are numbered from 0. A run is a stretch of ``least``
    words or more, and twice its least period or more, that cannot be extended with this period. A null, empty or
    blank text has no words and no runs; a null or repeated id is a row like any other; other columns are not read.
    Texts are taken whole: memory is some 200 bytes a word, and a few bytes more for each doubling of the longest
    repeat. Nothing is shuffled.
    """
    if least < 10:
        raise ValueError("runs of less than ten words are not looked for")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                texts = [t.encode("utf-8").split() if t else [] for t in piece["text"].to_pylist()]
                starts = np.cumsum([0, *map(len, texts)])
                known: dict[bytes, int] = {}
                number = known.setdefault
                words = np.fromiter((number(w, len(known)) for t in texts for w in t), np.int64, int(starts[-1]))
                runs = find_runs_in(words, starts, least)
                cuts = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
                flat = [pa.array(runs[:, i + 1]) for i in range(3)]
                struct = pa.StructArray.from_arrays(flat, names=["start", "length", "period"])
                out = {
                    "id": piece["id"],
                    "n_words": pa.array(np.diff(starts)),
                    "runs": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), struct),
                }
                if collapsed:
                    kept = []
                    for i, t in enumerate(texts):
                        own = runs[cuts[i] : cuts[i + 1], 1:]
                        t = [w for w, gone in zip(t, _dropped(len(t), own).tolist()) if not gone] if len(own) else t
                        kept.append(b" ".join(t).decode("utf-8"))
                    out["collapsed"] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_pydict(out)

    src = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    fields = f"id {id_field(src, 'id')}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>"
    return src.mapInArrow(run, fields + ", collapsed string" * collapsed).withColumnRenamed("id", id_col)


def with_planted_runs(df: DataFrame) -> DataFrame:
    """doc_id and text, one text of ten made periodic from some word on, as its id's checksum says."""
    h = "crc32(cast(cast(doc_id AS string) AS binary))"
    rows = df.selectExpr("doc_id", "text", f"{h} % 10 = 0 AS edit", f"{h} div 10 AS g")
    rows = rows.withColumn("w", F.expr(r"if(edit, filter(split(text, '[ \\t-\\r]+'), x -> x != ''), NULL)"))
    rows = rows.withColumn("n", F.expr("size(w)")).withColumn("a", F.expr("if(n > 0, cast(g % n AS int), NULL)"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    again = "transform(sequence(a, n - 1), i -> w[a + (i - a) % p])"
    made = f"array_join(concat(slice(w, 1, a), {again}), ' ')"
    return rows.select("doc_id", F.expr(f"if(n > 0, {made}, text)").alias("text"))


def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document, planted ones included, and digests of the runs and of the text without repeats."""
    found = periodic_runs(with_planted_runs(table(spark, folder, "documents").select("doc_id", "text")))
    best = "reduce(runs, cast(NULL AS struct<start:bigint,length:bigint,period:bigint>), (x, y) -> if(x IS NULL OR y.length > x.length, y, x))"
    listed = "array_join(transform(runs, x -> concat_ws(',', x.start, x.length, x.period) || '\\n'), '')"
    rows = found.withColumn("best", F.expr(best))
    return rows.selectExpr(
        "doc_id", "cast(size(runs) AS bigint) AS n_runs", "best.start", "best.length", "best.period",
        "1000 * best.length div best.period AS exponent_milli", f"sha2({listed}, 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256",
    )
