"""Phrase collocations by relational mining of occurrences (SETM).

The occurrences of length k are a relation (document, place, group), sorted by place: it is kept as one row per block of
documents with the number of the group that begins at each place, or -1; a place with -1 follows each piece and document. The
occurrences of length k + 1 come from a merge join of this relation with itself on the same piece and the adjacent place: two
frequent groups that begin one word apart overlap in all but one word. The joined groups are counted, those that are frequent
are kept and numbered; the occurrences are semi-joined with them, written to the shared folder, and extended further. Lengths
end where no group is left or the longest is reached.

What is shuffled by group goes in packets: the sorted 64-bit keys of a block that fall into one bucket are one binary value, so
Spark moves a row per block and bucket, and numpy counts or looks up the keys on the other side.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHasher, col, mix, slices, table, utf8, written

LEAST = 10  # occurrences of a frequent phrase
LONGEST = 3  # words
TOP = 2000  # phrases reported per language
COVERED = 50  # percent of its occurrences inside a longer phrase that drop a phrase
BROADCAST_GROUPS = 4_000_000  # two 64-bit numbers each; larger sets of groups are joined by a shuffle
NUMBERED_ROWS = 100_000  # groups numbered together
# A phrase cut after k + 1 words: heads holds the counts of its first parts by length, tails those of its last parts.
CUT = """struct((1000000BD * CAST(n AS decimal(19, 0)) * n)
  div (CAST(heads[k] AS decimal(19, 0)) * tails[size(tails) - 1 - k]) AS score,
  k AS k, heads[k] AS l, tails[size(tails) - 1 - k] AS r)"""
_FLUSH = 1 << 20  # joined occurrences that a task counts at a time; half as many words
_SLICE = 1 << 20  # text bytes that a task works on at a time; a longer document is taken whole
_PLACES = 1 << 19  # places of a block, but for a task's last and the slice that fills it
_WORD_BITS = 10  # of the number of buckets of words
_SHARE = 1 << 20  # places whose keys one partition counts or looks up
_ODD = 0x9E3779B97F4A7C15  # spreads keys over 64 bits; can be undone
_UNDO = pow(_ODD, -1, 1 << 64)


def _mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose tasks give their memory back when they end, as Python workers live on."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return df.mapInArrow(both, schema)


class _Cutter:
    """Word hashes of texts, where pieces end, and the words themselves."""

    def __init__(self, salt: int):
        self.hasher, self.salt, self.langs = WordHasher(), salt, {}
        self.breaks = np.zeros(256, bool)
        self.breaks[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
        self.hasher.space = self.breaks.copy()
        self.hasher.space[[32, 9]] = True

    def _lang(self, lang: str) -> int:
        if lang not in self.langs:
            self.langs[lang] = int.from_bytes(hashlib.sha256(f"{self.salt}:{lang}".encode()).digest()[:8], "little")
        return self.langs[lang]

    def __call__(self, batch: pa.RecordBatch):
        """(hash of each word in its language, first word of each text, bytes, word begins, word ends)."""
        data, starts = utf8(batch["text"])
        hashes, at = self.hasher.words(data, starts)
        langs = np.array([self._lang(x) for x in batch["lang"].to_pylist()], np.uint64)
        hashes = mix(hashes ^ np.repeat(langs, np.diff(at)))
        first, after = self.hasher.places(data, starts)
        return hashes.view(np.int64), at, data, first, after

    def ends_piece(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For every word but the last of the slice, whether a piece ends between it and the next."""
        ends = np.zeros(len(first) + 1, bool)
        ends[np.searchsorted(first, np.flatnonzero(self.breaks[data]))] = True  # the word after each break
        return ends[1:-1]


def _source(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")
    return df.select(text, F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"))


def _lowered(data: np.ndarray, first: np.ndarray, after: np.ndarray) -> pa.Array:
    """The words at these places, with A-Z in lower case."""
    at = np.concatenate([[0], np.cumsum(after - first)])
    text = data[np.arange(at[-1]) + np.repeat(first - at[:-1], after - first)]
    text = np.where((text >= 65) & (text <= 90), text + 32, text).astype(np.uint8)
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(text))


class _Words:
    """Words held with their keys, the codes of their languages, and counts; equal ones are put together when there are many."""

    def __init__(self):
        self.codes, self.held, self.size, self.limit = {}, [], 0, _FLUSH // 2

    def code(self, lang: str) -> int:
        return self.codes.setdefault(lang, len(self.codes))

    def add(self, keys: np.ndarray, langs: np.ndarray, words: pa.Array, n: np.ndarray) -> None:
        self.held.append((keys, langs, words, n))
        self.size += len(keys)
        if self.size >= self.limit:
            self.held = [self.together()]
            self.size = len(self.held[0][0])
            self.limit = max(_FLUSH // 2, 2 * self.size)

    def together(self) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """By key. Rows with one key and two words stay apart, for the test of the salt."""
        keys, langs, n = (np.concatenate([x[i] for x in self.held]) for i in (0, 1, 3))
        words = pa.concat_arrays([x[2] for x in self.held])
        order = np.argsort(keys, kind="stable")
        keys, langs, n, words = keys[order], langs[order], n[order], words.take(pa.array(order))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (langs[1:] != langs[:-1])
        new[1:] |= pa.compute.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new)
        return keys[at], langs[at], words.take(pa.array(at)), np.add.reduceat(n, at)

    def emptied(self) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        out = self.together()
        self.held, self.size, self.limit = [], 0, _FLUSH // 2
        return out


def _word_counts(src: DataFrame, salt: int, least: int) -> DataFrame:
    """(what, key, lang, word, n) of all words: 0 for each word that occurs ``least`` times, 1 for the words of a language
    in all, 2 for a key of two words. Counted in the slice, in the task, and then together."""
    packets = _Packets(0, _WORD_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held = _Cutter(salt), _Words()

        def dealt() -> Iterator[pa.RecordBatch]:
            keys, langs, words, n = held.emptied()
            for lang, code in held.codes.items():
                mine = np.flatnonzero(langs == code)
                if not len(mine):
                    continue
                cuts = list(packets.deal(keys[mine]))
                text = words.take(pa.array(mine))
                data, at = utf8(text)
                columns = [pa.array([x for x, _ in cuts], pa.int32()), pa.array([lang] * len(cuts), pa.string())]
                columns += [_binary([x[mine[part]] for _, part in cuts]) for x in (keys, n)]
                columns += [_binary([np.diff(at[part.start : part.stop + 1]).astype(np.int32) for _, part in cuts])]
                columns += [_binary([data[at[part.start] : at[part.stop]] for _, part in cuts])]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "lang", "keys", "n", "lengths", "words"])

        for batch in batches:
            for part in slices(batch, limit=_SLICE):
                hashes, at, data, first, after = cutter(part)
                if not len(hashes):
                    continue
                order = np.argsort(hashes)
                hashes = hashes[order]
                places = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
                sample, n = order[places], np.diff(np.append(places, len(hashes)))
                owner = np.searchsorted(at, sample, side="right") - 1
                langs = np.array([held.code(x) for x in part["lang"].to_pylist()])[owner]
                keys = packets.spread(hashes[places])
                held.add(keys, langs, _lowered(data, first[sample], after[sample]), n)
                if held.limit > _FLUSH // 2:  # many words are left after they were put together
                    yield from dealt()
        if held.size:
            yield from dealt()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, last = _Words(), Counter(), None
        schema = pa.schema([("what", pa.int32()), ("key", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

        def counted() -> pa.RecordBatch:
            keys, langs, words, n = held.emptied()
            names = pa.array(list(held.codes), pa.string())
            for lang, code in held.codes.items():
                sizes[lang] += int(n[langs == code].sum())
            twice = np.zeros(len(keys), bool)
            twice[1:] = keys[1:] == keys[:-1]
            some = np.flatnonzero(twice | (n >= least))
            columns = [twice[some] * np.int32(2), packets.undone(keys[some]), names.take(pa.array(langs[some])), words.take(pa.array(some)).cast(pa.string()), n[some]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

        for batch in batches:
            langs = batch["lang"].to_pylist()
            for i, bucket in enumerate(batch["bucket"].to_pylist()):
                if bucket != last and held.size:
                    yield counted()
                last = bucket
                keys, n, lengths = (np.frombuffer(batch[c][i].as_buffer(), kind).copy() for c, kind in (("keys", np.uint64), ("n", np.int64), ("lengths", np.int32)))
                at = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])
                words = pa.LargeStringArray.from_buffers(len(keys), pa.py_buffer(at), pa.py_buffer(batch["words"][i].as_py()))
                held.add(keys, np.full(len(keys), held.code(langs[i])), words, n)
        if held.size:
            yield counted()
        totals = [[1] * len(sizes), [None] * len(sizes), list(sizes), [None] * len(sizes), list(sizes.values())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(totals, schema.types)], schema=schema)

    dealt = _mapped(src, run, "bucket int, lang string, keys binary, n binary, lengths binary, words binary")
    # a bucket's words are held at a time, so partitions may be large
    return _mapped(dealt.repartition("bucket").sortWithinPartitions("bucket"), count, "what int, key bigint, lang string, word string, n bigint")


def _words(src: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """Words that occur ``least`` times, under keys that name one word each; words per language; the salt of these keys."""
    for salt in range(1, 100):
        rows = written(_word_counts(src, salt, least), "words")
        if rows.filter("what = 2").isEmpty():
            sizes = rows.filter("what = 1").groupBy("lang").agg(F.sum("n").alias("total"))
            return rows.filter("what = 0").select("key", "lang", "word", "n"), sizes, salt
    raise ValueError("no salt keeps the hashes of the words apart")


def _numbered(groups: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The rows with ``gid`` from 0 without gaps, and how many there are. Rows are numbered in shares of a bucket each."""
    groups = written(groups, name)
    total = groups.count()
    buckets = -(-total // NUMBERED_ROWS) or 1
    rows = groups.withColumn("bucket_", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    before = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    shares = rows.groupBy("bucket_").agg(F.count("*").alias("n_"))
    shares = shares.select("bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    nth = F.row_number().over(Window.partitionBy("bucket_").orderBy("key")) - 1
    rows = rows.withColumn("nth_", nth).join(shares, "bucket_")
    rows = rows.withColumn("gid", F.col("nth_") + F.col("before_")).drop("bucket_", "nth_", "before_")
    return written(rows, name), total


class _Lookup:
    """Numbers of the groups in a sorted array of keys; -1 for what is not frequent."""

    def __init__(self, keys: np.ndarray, gids: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.gids = keys[order], gids[order]

    @staticmethod
    def of(groups: DataFrame) -> _Lookup:
        found = groups.select("key", "gid").toArrow()
        return _Lookup(found["key"].to_numpy(), found["gid"].to_numpy())

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        order = np.argsort(keys)  # looking up sorted keys is several times faster
        keys = keys[order]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out = np.empty(len(keys), np.int64)
        out[order] = np.where(self.keys[at] == keys, self.gids[at], -1)
        return out


def _numbers(total: int) -> type:
    """What the numbers of so many groups are kept in."""
    return np.int32 if total < 1 << 31 else np.int64


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def _joined(groups: np.ndarray, total: int) -> np.ndarray:
    """Merge join with itself at the next place: a key for each place where two groups meet, else -1."""
    out = np.full(len(groups), -1, np.int64)
    both = np.flatnonzero((groups[:-1] >= 0) & (groups[1:] >= 0))
    out[both] = groups[both].astype(np.int64) * total + groups[both + 1]
    return out


class _Packets:
    """Keys dealt into buckets: spread over 64 bits and sorted, the keys of a bucket lie together."""

    def __init__(self, places: int, bits: int = 8):
        self.partitions = max(1, -(-places // _SHARE))
        self.bits = min(16, max(bits, (2 * self.partitions - 1).bit_length()))

    @staticmethod
    def spread(keys: np.ndarray) -> np.ndarray:
        return keys.view(np.uint64) * np.uint64(_ODD)

    @staticmethod
    def undone(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(_UNDO)).view(np.int64)

    def deal(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Where each bucket's keys lie among sorted ones."""
        lows = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        cuts = np.append(np.searchsorted(keys, lows), len(keys)).tolist()
        return ((i, slice(a, b)) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a)

    def shuffled(self, rows: DataFrame, by: str) -> DataFrame:
        return rows.repartition(self.partitions, by)


def _occurrences(src: DataFrame, salt: int, groups: DataFrame, total: int, packets: _Packets) -> DataFrame:
    """The first relation: (block, groups): numbers of the frequent words, with -1 after each piece and document."""
    lookup = src.sparkSession.sparkContext.broadcast(_Lookup.of(groups)) if total <= BROADCAST_GROUPS else None
    kind = _numbers(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held, size = _Cutter(salt), [], 0

        def block() -> pa.RecordBatch:
            groups, marks = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([_binary([groups]), _binary([np.packbits(marks)])], names=["groups", "marks"])

        for batch in batches:
            for part in slices(batch, limit=_SLICE):
                hashes, at, data, first, after = cutter(part)
                if not len(hashes):
                    continue
                found = lookup.value(hashes).astype(kind) if lookup else hashes
                ends = np.append(cutter.ends_piece(data, first), True)
                starts = at[1:-1]
                ends[starts[starts > 0] - 1] = True
                stop = np.flatnonzero(ends) + 1  # a mark goes before these words, and after the last
                found = np.insert(found, stop, -1)
                marks = np.zeros(0 if lookup else len(found), bool)
                if not lookup:
                    marks[stop + np.arange(len(stop))] = True
                held.append((found, marks))
                size += len(found)
                if size >= _PLACES:
                    yield block()
                    held, size = [], 0
        if size:
            yield block()

    rows = _mapped(src, run, "groups binary, marks binary")
    if lookup:
        return _blocks(rows.select("groups"), "occurrences")

    def keyed(row: dict) -> tuple[np.ndarray, np.ndarray]:
        keys = np.frombuffer(row["groups"], np.int64)
        return keys, np.unpackbits(np.frombuffer(row["marks"], np.uint8), count=len(keys)) == 0

    return _semi_joined(_blocks(rows, "hashed"), keyed, groups, total, packets)


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a number of their own, which stays as they are read again."""
    return written(rows.withColumn("block", F.monotonically_increasing_id()), name)


def _semi_joined(rows: DataFrame, keyed: Callable, groups: DataFrame, total: int, packets: _Packets) -> DataFrame:
    """The relation of the places whose keys are frequent, by two shuffles. Each block asks every bucket for the numbers of
    its distinct keys, and gets its answers back in the order of its questions. ``keyed`` gives the keys of a row, and
    which of its places have one."""
    kind = _numbers(total)

    def wanted(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, spread and sorted; which of them each place with a key has; places with a key."""
        keys, solid = keyed(row)
        return *np.unique(packets.spread(keys[solid]), return_inverse=True), solid

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys = wanted(row)[0]
                cuts = list(packets.deal(keys))
                columns = [pa.array([x for x, _ in cuts], pa.int32()), pa.array([row["block"]] * len(cuts), pa.int64())]
                columns += [_binary([keys[part] for _, part in cuts]), pa.nulls(len(cuts), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "keys", "gids"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, gids = packets.spread(batch["key"].to_numpy()), batch["gid"].to_numpy().astype(kind)
            order = np.argsort(keys)
            keys, gids = keys[order], gids[order]
            cuts = list(packets.deal(keys))
            columns = [pa.array([x for x, _ in cuts], pa.int32()), pa.array([-1] * len(cuts), pa.int64())]
            columns += [_binary([keys[part] for _, part in cuts]), _binary([gids[part] for _, part in cuts])]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "keys", "gids"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, lookup = None, [], None
        for batch in batches:
            buckets, blocks, out = batch["bucket"].to_pylist(), batch["block"].to_pylist(), []
            for i, (mine, block) in enumerate(zip(buckets, blocks)):
                if mine != bucket:
                    bucket, held, lookup = mine, [], None
                keys = np.frombuffer(batch["keys"][i].as_buffer(), np.uint64)
                if block < 0:
                    held.append((keys.copy(), np.frombuffer(batch["gids"][i].as_buffer(), kind).copy()))
                    continue
                if lookup is None:
                    none = (np.zeros(0, np.uint64), np.zeros(0, kind))
                    lookup, held = _Lookup(*map(np.concatenate, zip(none, *held))), []
                out.append((block, mine, lookup(keys).astype(kind)))
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), _binary([x[2] for x in out])]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "gids"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gids = []
        for batch in batches:
            for i, bucket in enumerate(batch["bucket"].to_pylist()):
                if bucket < 1 << packets.bits:
                    gids.append(np.frombuffer(batch["gids"][i].as_py(), kind))
                    continue
                keys, at, solid = wanted(batch.slice(i, 1).to_pylist()[0])
                found = np.concatenate([np.zeros(0, kind), *gids])
                if len(found) != len(keys):
                    raise ValueError(f"{len(found)} answers to {len(keys)} keys of a block")
                out, gids = np.full(len(solid), -1, kind), []
                out[solid] = found[at]
                yield pa.RecordBatch.from_arrays([_binary([out])], names=["groups"])

    asked = "bucket int, block bigint, keys binary, gids binary"
    sides = _mapped(rows, ask, asked).union(_mapped(groups.select("key", "gid"), hold, asked))
    # -1 comes before all blocks, so that a bucket's groups are known before it is asked
    answers = _mapped(packets.shuffled(sides, "bucket").sortWithinPartitions("bucket", "block"), answer, "block bigint, bucket int, gids binary")
    last = rows.withColumn("bucket", F.lit(1 << packets.bits))
    both = packets.shuffled(answers.unionByName(last, allowMissingColumns=True), "block").sortWithinPartitions("block", "bucket")
    return _blocks(_mapped(both, place, "groups binary"), "occurrences")


def _joined_counts(occurrences: DataFrame, total: int, least: int, packets: _Packets) -> DataFrame:
    """(key, n) of the groups that a merge join gives ``least`` times or more. Counted in the task, then together."""
    kind = _numbers(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = list(packets.deal(keys))
            n = n.astype(np.uint32)
            columns = [pa.array([x for x, _ in cuts], pa.int32()), _binary([keys[part] for _, part in cuts]), _binary([n[part] for _, part in cuts])]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", "n"])

        for batch in batches:
            for block in batch["groups"]:
                keys = _joined(np.frombuffer(block.as_buffer(), kind), total)
                held.append(packets.spread(keys[keys >= 0]))
                size += len(held[-1])
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def together(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[at], np.add.reduceat(n, at)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit, last = [], 0, _FLUSH, None

        def counted() -> pa.RecordBatch:
            keys, n = together(held)
            return pa.RecordBatch.from_pydict({"key": packets.undone(keys[n >= least]), "n": n[n >= least]})

        for batch in batches:
            for i, bucket in enumerate(batch["bucket"].to_pylist()):
                if bucket != last and size:
                    yield counted()
                    held, size, limit = [], 0, _FLUSH
                last = bucket
                keys = np.frombuffer(batch["keys"][i].as_buffer(), np.uint64).copy()
                held.append((keys, np.frombuffer(batch["n"][i].as_buffer(), np.uint32).astype(np.int64)))
                size += len(keys)
                if size >= limit:
                    held = [together(held)]
                    size = len(held[0][0])
                    limit = max(_FLUSH, 2 * size)
        if size:
            yield counted()

    dealt = _mapped(occurrences.select("groups"), run, "bucket int, keys binary, n binary")
    return _mapped(packets.shuffled(dealt, "bucket").sortWithinPartitions("bucket"), add, "key bigint, n bigint")


def _extended(occurrences: DataFrame, total: int, groups: DataFrame, found: int, packets: _Packets) -> DataFrame:
    """The relation of the next length: joined occurrences, semi-joined with the frequent groups among them."""
    before, kind = _numbers(total), _numbers(found)
    if found > BROADCAST_GROUPS:

        def keyed(row: dict) -> tuple[np.ndarray, np.ndarray]:
            keys = _joined(np.frombuffer(row["groups"], before), total)
            return keys, keys >= 0

        return _semi_joined(occurrences, keyed, groups, found, packets)
    lookup = occurrences.sparkSession.sparkContext.broadcast(_Lookup.of(groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch["groups"]:
                keys = _joined(np.frombuffer(block.as_buffer(), before), total)
                some = keys >= 0
                keys[some] = lookup.value(keys[some])
                yield pa.RecordBatch.from_arrays([_binary([keys.astype(kind)])], names=["groups"])

    return _blocks(_mapped(occurrences.select("groups"), run, "groups binary"), "occurrences")


def phrase_collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST,
    top: int | None = TOP, covered: int = COVERED,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of 2 to ``longest`` words that stick together, per language.

    Texts get A-Z in lower case and are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks and tabs into words;
    phrases lie within a piece. A null language is ``und``, a null text is empty; ids are not read, so repeated rows count
    each. ``n`` counts the words of the language; ``a`` the occurrences of the phrase, ``least`` or more. Of the cuts of a phrase into two parts
    with ``l`` and ``r`` occurrences the one with the lowest ``1000000 * a * a div (l * r)`` counts, the first of equal ones. A phrase is
    dropped if a longer one that holds it, dropped or not, has ``covered`` percent of its occurrences. The first ``top``
    by score, occurrences and phrase are given, or all. Products are decimals of 38 digits.

    Relations are written to the shared folder. Frequent groups are broadcast up to ``BROADCAST_GROUPS``, and joined by a
    shuffle beyond. An empty table gives no rows.
    """
    src = _source(df, text_col, lang_col)
    words, sizes, salt = _words(src, least)
    none = F.expr("cast(array() AS array<bigint>)")
    first = words.select("key", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", none.alias("heads"), none.alias("tails"))
    groups, total = _numbered(first, "groups")
    packets = _Packets(sizes.agg(F.sum("total")).first()[0] or 0)
    occurrences = _occurrences(src, salt, groups, total, packets)
    levels = []
    for length in range(2, longest + 1):
        counts = _joined_counts(occurrences, total, least, packets)
        if total * total >= 1 << 63:
            raise ValueError(f"{total} groups of {length - 1} words are too many for the keys of their pairs")
        side = lambda at: groups.select(*[F.col(c).alias(f"{at}_{c}") for c in ("gid", "lang", "phrase", "last", "n", "heads", "tails")])
        pairs = counts.withColumn("x_gid", F.expr(f"key div {total or 1}")).withColumn("y_gid", F.expr(f"key % {total or 1}"))
        pairs = pairs.join(side("x"), "x_gid").join(side("y"), "y_gid").select(
            "key", F.col("x_lang").alias("lang"), F.concat_ws(" ", "x_phrase", "y_last").alias("phrase"), F.col("y_last").alias("last"), "n",
            F.concat("x_heads", F.array("x_n")).alias("heads"), F.concat("y_tails", F.array("y_n")).alias("tails"), "x_gid", "y_gid",
        )
        before, occurrences_before = total, occurrences
        groups, total = _numbered(pairs, "groups")
        levels.append(groups)
        if not total:
            break
        if length < longest:
            occurrences = _extended(occurrences_before, before, groups, total, packets)
    kept = []
    for at, groups in enumerate(levels):
        if at + 1 < len(levels):
            longer = levels[at + 1].select(F.explode(F.array("x_gid", "y_gid")).alias("gid"), F.col("n").alias("within"))
            groups = groups.join(longer.groupBy("gid").agg(F.max("within").alias("within")), "gid", "left")
        else:
            groups = groups.withColumn("within", F.lit(None).cast("bigint"))
        kept.append(groups.filter(f"NOT coalesce(100 * within >= {covered} * n, false)").select("lang", "phrase", "n", "heads", "tails"))
    found = kept[0]
    for other in kept[1:]:
        found = found.union(other)
    scored = found.withColumn("cut", F.expr(f"array_min(transform(sequence(0, size(heads) - 1), k -> {CUT}))"))
    scored = scored.selectExpr("lang", "phrase", "n AS a", "cut.l AS l", "cut.r AS r", "cut.score AS score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("bigint"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest phrases of each language over all documents."""
    return phrase_collocations(table(spark, folder, "documents"))


SQL = r"""WITH pieces AS MATERIALIZED (
  SELECT lang, d, p, list_filter(string_split_regex(parts[p], '[ \t]+'), lambda x: x <> '') AS w FROM (
    SELECT lang, d, parts, unnest(range(1, len(parts) + 1)) AS p FROM (
      SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]') AS parts FROM documents))),
occurrences AS MATERIALIZED (
  SELECT lang, d, p, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM pieces),
near AS MATERIALIZED (
  SELECT lang, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM occurrences WINDOW o AS (PARTITION BY d, p ORDER BY i)),
f1 AS MATERIALIZED (SELECT lang, x, count(*) AS f FROM near GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, x, y, count(*) AS f FROM near WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS f FROM near WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, 1 AS k, l.f AS l, r.f AS r FROM f2
    JOIN f1 l ON l.lang = f2.lang AND l.x = f2.x JOIN f1 r ON r.lang = f2.lang AND r.x = f2.y
    WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND 100 * f3.f >= 50 * f2.f AND f3.x = f2.x AND f3.y = f2.y)
      AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND 100 * f3.f >= 50 * f2.f AND f3.y = f2.x AND f3.z = f2.y)
  UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 1, l.f, r.f FROM f3
    JOIN f1 l ON l.lang = f3.lang AND l.x = f3.x JOIN f2 r ON r.lang = f3.lang AND r.x = f3.y AND r.y = f3.z
  UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 2, l.f, r.f FROM f3
    JOIN f2 l ON l.lang = f3.lang AND l.x = f3.x AND l.y = f3.y JOIN f1 r ON r.lang = f3.lang AND r.x = f3.z),
scored AS (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM cuts),
chosen AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sizes AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM chosen)
JOIN sizes USING (lang) WHERE rank <= 2000"""
