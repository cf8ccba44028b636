"""MinHash near-duplicates: fast similarity sketches, banding, and exact verification.

A sketch has ``BINS`` coordinates. In each round every shingle is thrown into one bin and each bin keeps the
least hash that it has seen, earlier rounds first; rounds go on until no bin is empty, and a second series of
rounds fills bin by bin, so that every coordinate is filled after ``2 * BINS`` rounds at the latest. Coordinates
agree as often as the sets' similarity says, with the concentration of independent samples.

Documents with equal sets are one class, named by its least id and, where one id names several classes, by ``part``
(else 0). Classes that share a band meet in a bucket, and only links that can
still join two components are looked for: each bucket compares all its members with two of them, the links found
are followed to components, and then members of one bucket in different components are compared with each other.
So no pair of a bucket is passed over, and pairs inside a component are not compared again. A pair passes on
its sketch bits and sizes first, and is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, col, id_field, mix, seeds, slices, table, utf8, written
from .components import components

BANDS, ROWS = 42, 6  # misses a pair of similarity 0.8 three times in a million
BINS = BANDS * ROWS
SLICE = 1 << 19  # text bytes that a task works on at a time
_EMPTY = np.uint64(2**64 - 1)


def shingle_sets(data: np.ndarray, starts: np.ndarray, k: int, hasher: WordHasher) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles; of fewer words, one for all of them."""
    words, at = hasher.words(data, starts)
    run = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        run = run * np.uint64(0xD1342543DE82EF95) + words[i : i + len(run)]
    run = mix(run + np.uint64(k))
    sets = []
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist()):
        if end - begin >= k:
            found = np.sort(run[begin : end - k + 1])
            fresh = np.ones(len(found), bool)
            fresh[1:] = found[1:] != found[:-1]
            sets.append(found[fresh])
        elif end > begin:
            whole = np.zeros(1, np.uint64)
            for w in words[begin:end]:
                whole = whole * np.uint64(0xD1342543DE82EF95) + w
            sets.append(mix(whole + np.uint64(end - begin)))
        else:
            sets.append(words[:0])
    return sets


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches of non-empty sets, one row each."""
    out = np.full(len(sets) * bins, _EMPTY, np.uint64)
    rounds = seeds(2 * bins, 7)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
    for i in range(2 * bins):
        if not len(items):
            break
        h = mix(items ^ rounds[i])
        value = (np.uint64(i) << np.uint64(54)) | (h & np.uint64(2**54 - 1))
        place = ((h >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(out, owner * bins + place, value)
        open_ = (out.reshape(-1, bins) == _EMPTY).any(axis=1)
        stay = open_[owner]
        items, owner = items[stay], owner[stay]
    return out.reshape(len(sets), bins)


def _bits(sk: np.ndarray) -> np.ndarray:
    """The lowest bit of each coordinate, as 64-bit words."""
    flat = (sk & np.uint64(1)).astype(np.uint8)
    flat = np.pad(flat, ((0, 0), (0, -sk.shape[1] % 64)))
    return np.packbits(flat, axis=1).view(np.int64)


def _bands(sk: np.ndarray) -> np.ndarray:
    parts = sk.reshape(len(sk), BANDS, ROWS)
    h = np.broadcast_to(seeds(BANDS, 9), parts.shape[:2]).copy()
    for r in range(ROWS):
        h = mix(h * np.uint64(0xD1342543DE82EF95) + parts[:, :, r])
    return h.view(np.int64)


def _listed(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def _sketch_table(df: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for piece in slices(batch, limit=SLICE):
                sets = shingle_sets(*utf8(piece["text"]), k, hasher)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                sk = sketches([sets[i] for i in full])
                bits, bands = _bits(sk), _bands(sk)
                key = np.zeros((len(sets), 2), np.int64)
                for i in full:
                    s = sets[i]
                    key[i] = np.array([s.sum(), mix(s ^ np.uint64(0xA5A5A5A5)).sum()], np.uint64).view(np.int64)
                back = np.full(len(sets), -1, np.int64)
                back[full] = np.arange(len(full))
                take = pa.array(back, mask=back < 0)
                yield pa.RecordBatch.from_arrays(
                    [piece["id"], pa.array(sizes), pa.array(key[:, 0]), pa.array(key[:, 1]),
                     _listed(bits).take(take), _listed(bands).take(take)],
                    names=["id", "n", "k1", "k2", "bits", "bands"],
                )

    fields = f"id {id_field(df, 'id')}, n bigint, k1 bigint, k2 bigint, bits array<bigint>, bands array<bigint>"
    return df.mapInArrow(run, fields)


def _set_table(df: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for piece in slices(batch, limit=SLICE):
                sets = shingle_sets(*utf8(piece["text"]), k, hasher)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                k1 = np.array([s.sum() for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece["id"], pa.array(k1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["id", "k1", "grams"],
                )

    return df.mapInArrow(run, f"id {id_field(df, 'id')}, k1 bigint, grams array<bigint>")


def _set_of(id_col: str, part: str, sets: str):
    """Joins a class with its set."""
    return F.expr(f"{id_col} = {sets}.id AND ({part} = 0 OR {part} = {sets}.k1)")


def _plausible(percent: int) -> str:
    """Sizes that allow the similarity, and no more differing sketch bits than 6 standard deviations over it.

    Bits of a pair of similarity s differ with probability (1 - s) / 2.
    """
    p = (1 - percent / 100) / 2
    most = int(BINS * p + 6 * (BINS * p * (1 - p)) ** 0.5) + 1
    words = -(-BINS // 64)
    apart = " + ".join(f"bit_count(l.bits[{i}] ^ r.bits[{i}])" for i in range(words))
    return f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n) AND {apart} <= {most}"


def _linked(x: str, y: str, percent: int) -> str:
    """The similarity rule, ``100 * shared >= percent * (x + y - shared)``, with ``shared`` once."""
    return f"{100 + percent} * size(array_intersect({x}, {y})) >= {percent} * (size({x}) + size({y}))"


class _Verifier:
    """Confirms pairs on full shingle sets. Sets are made once per document, for documents that are asked for."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent = docs, k, percent
        self.sets: DataFrame | None = None

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """(id, k1, grams) of all rows of the documents asked for so far and of ``ids``."""
        if self.sets is None:
            # the texts are shuffled once here, at any size: what is asked for grows with the corpus
            self.sets = written(_set_table(self.docs.join(ids.hint("merge"), "id", "left_semi"), self.k), "sets")
            return self.sets
        fresh = written(ids.join(self.sets.select("id"), "id", "left_anti"), "wanted")
        if not fresh.isEmpty():
            more = written(_set_table(self.docs.join(fresh, "id", "left_semi"), self.k), "sets")
            self.sets = self.sets.union(more)
        return self.sets

    def __call__(self, pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        sets = self.sets_of(ids)
        both = pairs.join(sets.alias("x"), _set_of("a", "ap", "x")).join(sets.alias("y"), _set_of("b", "bp", "y"))
        return both.filter(_linked("x.grams", "y.grams", self.percent)).select("a", "b").distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text's set has its distinct ``k``-word shingles, or
    its whole word sequence if it has fewer words. Documents are linked if ``100 * shared >= percent * union``;
    ``component_id`` is the least id that links lead to, and ``kept`` marks it. Null and empty texts have an empty
    set and are linked with nothing. Rows with a null id are linked with nothing, have a null component and are
    kept. Rows that repeat an id are one document: their sets' links all count for it. Other columns are not read.
    """
    docs = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    sk = written(_sketch_table(docs, k), "sketches")
    usable = sk.filter("id IS NOT NULL AND n > 0")
    classes = written(
        usable.groupBy("k1", "k2").agg(F.min(F.struct("id", "n", "bits", "bands")).alias("s")).select("k1", "k2", "s.*"),
        "classes",
    )
    many = written(classes.groupBy("id").agg(F.count("*").alias("many")).filter("many > 1"), "many")
    parted = classes.join(many, "id", "left").withColumn("part", F.expr("if(many IS NULL, 0L, k1)"))
    facts = written(parted.select("id", "part", "n", "bits"), "facts")
    rows = parted.select("id", "part", F.explode("bands").alias("band"))
    order = F.struct(F.xxhash64("id").alias("h"), "id", "part")
    ends = rows.groupBy("band").agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count("*").alias("members"))
    ends = ends.filter("members > 1").selectExpr("band", "lo.id c1", "lo.part p1", "hi.id c2", "hi.part p2")
    buckets = written(rows.join(ends, "band"), "buckets")

    # classes of one id are one node: they need no link, but each has links of its own
    stars = buckets.selectExpr("id", "part", "inline(array(struct(c1 AS c, p1 AS p), struct(c2 AS c, p2 AS p)))").filter("id != c")
    stars = stars.selectExpr("least(id, c) a", "if(id < c, part, p) ap", "greatest(id, c) b", "if(id < c, p, part) bp").distinct()
    side = lambda x, xp, at: facts.select(F.col("id").alias(x), F.col("part").alias(xp), F.struct("n", "bits").alias(at))
    stars = stars.join(side("a", "ap", "l"), ["a", "ap"]).join(side("b", "bp", "r"), ["b", "bp"])
    stars = stars.filter(_plausible(percent)).select("a", "ap", "b", "bp")
    confirm = _Verifier(docs, k, percent)
    links = written(confirm(written(stars, "pairs")).union(_repeated_ids(classes, usable)), "links")
    first = components(links)

    # Members of one bucket in different components, centres apart: those with a plausible partner bring their
    # sets, and the join itself compares them, so that only links come out of it.
    inner = buckets.filter("NOT (id = c1 AND part = p1) AND NOT (id = c2 AND part = p2)")
    open_ = written(_mixed(inner, first).join(facts, ["id", "part"]), "open")
    meet = f"l.band = r.band AND l.component != r.component AND {_plausible(percent)}"
    open_ = written(open_.alias("l").join(open_.alias("r"), F.expr(meet), "left_semi"), "open")
    if not open_.isEmpty():
        own = open_.groupBy("id", "part").agg(F.collect_list("band").alias("bands"))  # BANDS at most
        sets = confirm.sets_of(own.select("id").distinct())
        open_ = open_.join(own, ["id", "part"]).alias("o").join(sets.alias("s"), _set_of("o.id", "o.part", "s"))
        open_ = open_.select("o.*", "s.grams")
        # a pair that meets in several buckets is compared in the first
        first_meeting = "l.band = array_min(array_intersect(l.bands, r.bands))"
        exact = f"{meet} AND l.component < r.component AND {first_meeting} AND {_linked('l.grams', 'r.grams', percent)}"
        more = open_.alias("l").join(open_.alias("r"), F.expr(exact)).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
        links = written(links.union(more.distinct()), "links")
        first = components(links)

    named = classes.join(first.withColumnRenamed("node", "id"), "id", "left").select(
        "k1", "k2", F.coalesce("component", "id").alias("component")
    )
    out = sk.select("id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _mixed(members: DataFrame, named: DataFrame) -> DataFrame:
    """(band, id, part, component) of the members of buckets with more than one component."""
    own = members.select("band", "id", "part").join(named.withColumnRenamed("node", "id"), "id", "left")
    own = own.select("band", "id", "part", F.coalesce("component", "id").alias("component"))
    ends = own.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    return own.join(ends.select("band"), "band")


def _repeated_ids(classes: DataFrame, usable: DataFrame) -> DataFrame:
    """Links between the representatives of all classes that one repeated id belongs to."""
    many = usable.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id")
    own = usable.join(many, "id", "left_semi").select("id", "k1", "k2").distinct()
    reps = own.join(classes.select("k1", "k2", F.col("id").alias("rep")), ["k1", "k2"])
    return reps.filter("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of near copies over all documents, on four-word shingles."""
    return near_duplicates(table(spark, folder, "documents"), k=4)
