"""Packing token sequences: exact complements first, best fit for what is left.

Only the lengths matter, and there are no more than ``size`` of them, so the packing is planned on the table of counts
per length, whose size does not grow with the corpus. An index holds how many sums of one, two and three available
lengths there are for each total; when a length runs out, the three tables are corrected by shifted copies of
themselves. The longest length left is put into a sequence, with further long ones if need be, until the gap is
a single, pair or triple sum; the pattern found is taken as often as the counts allow. Lengths for which no pattern
fills a sequence are left, and these are packed best fit, longest first, many equal sequences at a time.

Pieces then find their places by rank: equal lengths are numbered, with a share of the numbers for each bucket of rows,
and a pattern takes the next numbers of each of its lengths.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import SLICE_BYTES, col, id_field, slices, table, tokenizer_path, written

SIZE = 1024  # tokens of a sequence
END_ID = 2  # the token after each document
BUCKET_ROWS = 10_000  # rows that are numbered together


class SumIndex:
    """How many ordered sums of one, two and three available lengths give each total up to ``size``."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()  # by length; place 0 is not used
        self.size = len(counts) - 1
        one = (counts > 0).astype(np.int64)
        two = np.convolve(one, one)[: self.size + 1]
        self.one, self.two, self.three = one, two, np.convolve(one, two)[: self.size + 1]

    def _shifted(self, x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if by <= self.size:
            out[by:] = x[: self.size + 1 - by]
        return out

    def take(self, pattern: Counter, times: int) -> None:
        for length, n in pattern.items():
            self.left[length] -= n * times
            if not self.left[length]:
                self._drop(length)

    def _drop(self, x: int) -> None:
        one, two = self.one, self.two
        self.three = self.three - 3 * self._shifted(two, x) + 3 * self._shifted(one, 2 * x)
        self.two = two - 2 * self._shifted(one, x)
        self.one = one.copy()
        self.one[x] = 0
        if 2 * x <= self.size:
            self.two[2 * x] += 1
        if 3 * x <= self.size:
            self.three[3 * x] -= 1

    def free(self, used: Counter) -> np.ndarray:
        """Counts by length, less those that a pattern has used."""
        left = self.left.copy()
        for length, n in used.items():
            left[length] -= n
        return left

    def exact(self, used: Counter, gap: int, most: int = 3) -> tuple[int, ...] | None:
        """One, two or three lengths (``most`` at most) that fill ``gap``, the longest first; None if there are none."""
        if not (self.one[gap] or self.two[gap] or self.three[gap]):
            return None
        left = self.free(used)
        if left[gap] > 0:
            return (gap,)
        if most > 1 and self.two[gap] and (found := _pair(left, gap)):
            return found
        if most > 2 and self.three[gap]:
            first = np.arange(gap - 2, 0, -1)
            for x in first[(left[first] > 0) & (self.two[gap - first] > 0)].tolist():
                left[x] -= 1
                found = _pair(left, gap - x, x)
                left[x] += 1
                if found:
                    return (x, *found)
        return None


def _pair(left: np.ndarray, total: int, most: int | None = None) -> tuple[int, int] | None:
    """Two available lengths with this sum, the longer one first and not over ``most``."""
    low = (total + 1) // 2
    high = total - 1 if most is None else min(most, total - 1)
    if high < low:
        return None
    longer = np.arange(high, low - 1, -1)
    good = (left[longer] > 0) & (left[total - longer] > 0)
    if total % 2 == 0 and left[low] < 2:
        good[-1] = False
    at = int(good.argmax())
    return (int(longer[at]), int(total - longer[at])) if good[at] else None


def _filled(index: SumIndex, length: int, most: int, extend: bool) -> Counter | None:
    """A pattern that begins with ``length`` and fills a sequence with ``most`` complements at most; with ``extend`` after
    as many of the longest lengths as it takes."""
    used, gap = Counter([length]), index.size - length
    while gap:
        found = index.exact(used, gap, most)
        if found:
            return used + Counter(found)
        able = np.flatnonzero(index.free(used)[:gap] > 0) if extend else ()
        if not len(able):
            return None
        used[int(able[-1])] += 1
        gap -= int(able[-1])
    return used


def best_fit(counts: np.ndarray) -> list[tuple[Counter, int]]:
    """(pattern, times) of best fit by falling length, equal sequences together."""
    size = len(counts) - 1
    open_: dict[int, list[tuple[Counter, int]]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: Counter, times: int) -> None:
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((pattern, times))

    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = min(left, size // length)
                put(size - each * length, Counter({length: each}), left // each)
                left %= each
                continue
            gap = gaps[at]
            pattern, times = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            each = min(left, gap // length)
            filled = min(times, left // each)
            put(gap - each * length, pattern + Counter({length: each}), filled)
            left -= filled * each
            if times > filled:
                put(gap, pattern, times - filled)
    return [x for group in open_.values() for x in group]


# Passes over the lengths: (complements at most, may other lengths come before them). Which order wastes least
# depends on the lengths, so all are planned and the plan with the fewest sequences is taken.
PASSES = (((3, True),), ((1, False), (2, False), (3, True)), ((1, False), (2, False)), ((1, False),), ())


def _planned(counts: np.ndarray, passes: tuple) -> list[tuple[dict[int, int], int]]:
    index, out = SumIndex(counts), []
    for most, extend in passes:
        for length in range(index.size, 0, -1):
            while index.left[length] and (pattern := _filled(index, length, most, extend)):
                times = min(int(index.left[x]) // n for x, n in pattern.items())
                index.take(pattern, times)
                out.append((dict(pattern), times))
    return out + [(dict(p), times) for p, times in best_fit(index.left)]


def plan_packing(counts: Sequence[int]) -> list[tuple[dict[int, int], int]]:
    """Patterns {length: how many} and how many sequences follow each, from ``counts[length]`` pieces per length.

    The last place of ``counts`` is the size of a sequence; place 0 is not used.
    """
    counts = np.array(counts, np.int64)
    counts[0] = 0
    return min((_planned(counts, p) for p in PASSES), key=lambda plan: sum(times for _, times in plan))


class _Places:
    """Where the pieces of each length go, by their rank among the pieces of that length."""

    def __init__(self, plan: list[tuple[dict[int, int], int]], total: int):
        self.stride = total + 1
        next_rank: Counter = Counter()
        rows, sequence = [], 0
        for pattern, times in plan:
            offset = 0
            for length in sorted(pattern, reverse=True):
                each = pattern[length]
                rows.append((length * self.stride + next_rank[length], each, sequence, offset))
                next_rank[length] += each * times
                offset += each * length
            sequence += times
        self.key, self.each, self.sequence, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 4).T

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length * self.stride + rank
        at = np.searchsorted(self.key, key, side="right") - 1
        nth = key - self.key[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def pack(pieces: DataFrame, length_col: str = "length", size: int = SIZE) -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset``: which sequence each is in, and where it begins.

    Sequences hold ``size`` at most and have no gap before their last piece. Columns named sequence_id or offset are replaced.
    Repeated rows are pieces of their own; an empty table stays empty; a length that is null, below 1 or over ``size``
    is an error. The rows are written once, so that counts and numbers are of the same rows. The driver holds the counts
    of ``size`` lengths; the plan, a few rows for each length, is broadcast. Rows of one length are numbered in buckets
    of about ``BUCKET_ROWS`` rows, so a length that a third of all rows have is no larger task than others.
    """
    spark = pieces.sparkSession
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    given = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]
    length = col(length_col).cast("bigint").alias("length_")
    rows = written(pieces.select(*given, length, F.monotonically_increasing_id().alias("row_")), "pieces")
    found = {r["length_"]: r["n"] for r in rows.groupBy("length_").agg(F.count("*").alias("n")).collect()}
    if any(x is None or not 1 <= x <= size for x in found):
        raise ValueError(f"lengths must be 1 to {size}")
    total = sum(found.values())
    places = _Places(plan_packing([found.get(x, 0) for x in range(size + 1)]), total)
    shared = spark.sparkContext.broadcast(places)
    buckets = -(-total // BUCKET_ROWS) or 1
    rows = rows.withColumn("bucket_", F.pmod(F.xxhash64("row_"), F.lit(buckets)))
    keys = ["bucket_", "length_"]
    before = Window.partitionBy("length_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    shares = rows.groupBy(*keys).agg(F.count("*").alias("n_"))
    shares = shares.select(*keys, F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("row_")) - 1
    ranked = rows.withColumn("nth_", nth).join(shares, keys)
    ranked = ranked.select(*[f"c{i}" for i in range(len(own))], "length_", (F.col("nth_") + F.col("before_")).alias("rank_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = shared.value(batch["length_"].to_numpy(), batch["rank_"].to_numpy())
                columns = [batch.column(i) for i in range(len(own))] + [pa.array(sequence), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(own))] + ["s_", "o_"])

    schema = ", ".join(f"c{i} {pieces.schema[c].dataType.simpleString()}" for i, c in enumerate(own))
    placed = ranked.mapInArrow(run, schema + ", s_ bigint, o_ bigint")
    return placed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], F.col("s_").alias("sequence_id"), F.col("o_").alias("offset"))


class _Tokens:
    """Ids of texts as the vocabulary file says; the rare text that the fast engine gives up goes to the tree."""

    def __init__(self, vocabulary: bpe.Vocabulary):
        self.slow = bpe.Encoder(vocabulary)
        special = set(vocabulary.special.values())
        ranks = {b: i for i, b in vocabulary.content.items() if i not in special}
        ordered = bool((np.diff(vocabulary.merged) > 0).all())  # then ids are merge ranks, as the fast engine takes them
        self.fast = (
            tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens=vocabulary.special)
            if ordered
            else None
        )

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None:
            try:
                return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
            except ValueError:  # its cutting has a stack that a long run of blanks exceeds
                pass
        ids = self.slow.ids_texts([text])[0]
        return np.array(ids.split(",") if ids else [], np.uint32)


def cut_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, path: str | None = None
) -> DataFrame:
    """One row per piece of each document: id, piece, start, length, and ids as 32-bit little-endian numbers.

    A document is its token ids and ``end_id`` after them; a null or empty text is ``end_id`` alone. Documents longer than
    ``size`` are cut into pieces of ``size``, of which the first may be shorter. Texts are encoded whole. Null and repeated
    ids are rows like any other; other columns are not read. The vocabulary (``path``) is broadcast; nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(bpe.Vocabulary.read(path or tokenizer_path("byte_bpe_50k.json")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(shared.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                row, nth, start, length, data = [], [], [], [], []
                for i, text in enumerate(part["text"].to_pylist()):
                    ids = np.append(tokens.ids(text or ""), np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i), nth.append(k), start.append(a), length.append(b - a), data.append(ids[a:b].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part["id"].take(pa.array(row, pa.int64())), pa.array(nth, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(data, pa.binary())],
                    names=["id", "piece", "start", "length", "ids"],
                )

    src = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    fields = f"id {id_field(src, 'id')}, piece int, start bigint, length bigint, ids binary"
    return src.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences of packed pieces with their ids; one holds ``size`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    joined = F.expr("reduce(parts, cast('' AS binary), (x, y) -> concat(x, y.ids))")
    return whole.select("sequence_id", "n_tokens", joined.alias("ids"))


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, with a checksum of each piece's ids."""
    pieces = cut_documents(table(spark, folder, "documents")).withColumn("ids_crc32", F.crc32("ids"))
    return pack(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"))
