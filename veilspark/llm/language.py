"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``order`` bytes long, with the counts of what followed. A byte
costs -log2 of its probability in the longest context that has seen it; every context on the way down that has
not costs an escape, whose probability is the share of distinct followers (method C). The statistics are frozen
when the text is scored, so the code length of a text is exact, and the language with the shortest one wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, id_field, slices, table, utf8

TRAINING_DOCUMENTS = 400  # expected per language: the bound of the labelled sample
ORDER = 3
MODEL_CELLS = 100_000_000  # a larger model does not fit a task; lower ``order`` for more languages
_BLOCK = 1 << 18  # bytes scored at a time
_KEEP_SLICE = 1 << 19  # text bytes that are judged at a time where whole rows are kept
_PAD = 10  # the byte that stands before a text

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Model:
    """Code lengths by (row of the context, symbol, language). Contexts are numbered by their symbols."""

    languages: list[str]
    symbol: np.ndarray  # byte -> symbol; 0 for bytes never seen
    row: np.ndarray  # full context -> row; contexts never seen share the rows of their shorter suffix
    bits: np.ndarray  # rows x symbols x languages

    @property
    def order(self) -> int:
        return round(np.log(len(self.row)) / np.log(int(self.symbol.max()) + 1)) if len(self.row) > 1 else 0


def _grams(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Every byte of every text with the ``order`` bytes before it, as one number."""
    n = len(data)
    place = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))
    low = _LOWER[data].astype(np.int64)
    out = low.copy()
    for back in range(1, order + 1):
        shifted = np.full(n, _PAD, np.int64)
        shifted[back:] = low[:-back]
        shifted[place < back] = _PAD
        out |= shifted << (8 * back)
    return out


def build_model(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]], order: int) -> Model:
    """The model from counts of (order + 1)-grams per language: (numbers as ``_grams`` makes them, counts)."""
    seen = np.zeros(256, bool)
    for codes, _ in counts:
        for back in range(order + 1):
            seen[np.unique((codes >> (8 * back)) & 255)] = True
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, seen.sum() + 1)
    m = int(seen.sum()) + 1

    def number(codes: np.ndarray, first: int, last: int) -> np.ndarray:
        """The symbols from ``last`` to ``first`` bytes back as one number."""
        out = np.zeros(len(codes), np.int64)
        for back in range(last, first - 1, -1):
            out = out * m + symbol[(codes >> (8 * back)) & 255]
        return out

    used = np.unique(np.concatenate([number(c, 1, order) for c, _ in counts])) if order else np.zeros(1, np.int64)
    short = m ** max(0, order - 1)
    rows = (len(used) + short) if order else 1
    if rows * m * len(languages) > MODEL_CELLS or m**order > MODEL_CELLS:
        raise ValueError(f"{len(languages)} languages at order {order} make too large a model; lower the order")
    row = np.tile(np.arange(short), m) + len(used) if order else np.zeros(1, np.int64)
    # the suffix of a full context drops its first, most significant symbol
    row = (np.arange(m**order) % short) + len(used) if order else row
    row[used] = np.arange(len(used))
    bits = np.zeros((rows, m, len(languages)), np.float32)
    for at, (codes, n) in enumerate(counts):
        lower = np.full((1, m), -np.log2(1 / 256))
        for k in range(order + 1):
            full = k == order and order > 0
            contexts = used if full else np.arange(m**k)
            code, followers = number(codes, 1, k) if k else np.zeros(len(codes), np.int64), symbol[codes & 255]
            where = np.searchsorted(contexts, code)
            freq = np.zeros((len(contexts), m))
            np.add.at(freq, (where, followers), n)
            total, kinds = freq.sum(axis=1), (freq > 0).sum(axis=1)
            known = total > 0
            below = lower[contexts % max(1, m ** (k - 1))] if k else np.repeat(lower, 1, axis=0)
            cost = below.copy()
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = -np.log2(kinds / (total + kinds))
                direct = -np.log2(freq / (total + kinds)[:, None])
            cost[known] = np.where(freq[known] > 0, direct[known], below[known] + escape[known, None])
            if full or not order:
                bits[: len(contexts), :, at] = cost
            elif k == order - 1:
                bits[len(used) :, :, at] = cost
            lower = cost
    return Model(languages, symbol, row.astype(np.int32), bits)


def code_lengths(model: Model, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bits of each text under each language. Memory is bounded by blocks of bytes, whatever a text's length."""
    m, order = int(model.symbol.max()) + 1, model.order
    flat = model.bits.reshape(-1, len(model.languages))
    out = np.zeros((len(starts) - 1, len(model.languages)))
    symbols = model.symbol[_LOWER]
    pad = symbols[_PAD]
    for a in range(0, len(data), _BLOCK):
        b = min(len(data), a + _BLOCK)
        lead = max(0, a - order)
        sym = symbols[data[lead:b]]
        first = np.searchsorted(starts, a, side="right") - 1
        last = np.searchsorted(starts, b, side="left")
        cuts = np.clip(starts[first:last], a, b)
        owner = np.arange(first, last)
        fresh = np.concatenate([cuts[1:] > cuts[:-1], [b > cuts[-1]]])  # texts with bytes in this block
        cuts, owner = cuts[fresh], owner[fresh]
        begin = np.repeat(starts[owner], np.diff(np.append(cuts, b)))
        place = np.arange(a, b) - begin
        context = np.zeros(b - a, np.int64)
        for back in range(order, 0, -1):
            past = np.full(b - a, pad, np.int64)
            off = a - lead - back
            take = sym[max(0, off) : len(sym) - back]
            past[len(past) - len(take) :] = take
            past[place < back] = pad
            context = context * m + past
        cost = flat[model.row[context].astype(np.int64) * m + sym[a - lead :]]
        out[owner] += np.add.reduceat(cost, cuts - a, axis=0, dtype=np.float64)
    return out


def train(
    df: DataFrame, id_col: str, text_col: str, lang_col: str, documents: int = TRAINING_DOCUMENTS, order: int = ORDER
) -> Model | None:
    """A model of the languages in ``lang_col``; None where there is nothing to learn from.

    Learns from about ``documents`` documents per language, chosen by a hash. What comes to the driver are the
    distinct byte runs of that sample.
    """
    rows = df.select(
        col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"),
        F.pmod(F.xxhash64(col(id_col), col(text_col)), F.lit(1 << 30)).alias("h"),
    ).filter("lang IS NOT NULL AND text IS NOT NULL AND text != ''")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, documents / n))).otherwise(share)
    sample = rows.filter(F.col("h") < share * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                names = np.array(piece["lang"].to_pylist(), object)
                for lang in sorted(set(names)):
                    texts = piece["text"].filter(pa.array(names == lang))
                    codes, n = np.unique(_grams(*utf8(texts), order), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes)), "code": codes, "n": n})

    grams = sample.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = grams.toPandas().sort_values(["lang", "code"])
    groups = [(str(lang), g["code"].to_numpy(np.int64), g["n"].to_numpy(np.float64)) for lang, g in found.groupby("lang")]
    if not groups:
        return train(df, id_col, text_col, lang_col, documents * 4, order)
    return build_model([g[0] for g in groups], [g[1:] for g in groups], order)


def _predict(model: Model | None, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    n = len(texts)
    spoken = pa.compute.fill_null(pa.compute.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if model is None or not n:
        return pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n))
    lengths = code_lengths(model, *utf8(texts))
    best = lengths.argmin(axis=1)
    least = lengths[np.arange(n), best]
    score = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(axis=1)
    names = [model.languages[b] if s else "und" for b, s in zip(best, spoken)]
    return pa.array(names, pa.string()), pa.array(np.where(spoken, score, 0.0))


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (posterior under equal priors).

    Null texts, texts without a letter and all texts without a model are ``und`` with score 0. Equal lengths go to
    the language first in the alphabet. Texts are scored whole. Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most MODEL_CELLS cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                lang, score = _predict(shared.value, piece["text"])
                yield pa.RecordBatch.from_arrays([piece["id"], lang, score], names=["id", "lang_pred", "score"])

    src = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {id_field(src, 'id')}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(df: DataFrame, model: Model | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose language is known with a score of ``least``, with all columns as they are.

    Only the texts go through Python, and one bit for each comes back."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        kept = [pa.array([], pa.bool_())]
        batch = pa.RecordBatch.from_arrays([texts.cast(pa.string())], names=["text"])
        for piece in slices(batch, limit=_KEEP_SLICE):
            lang, score = _predict(shared.value, piece["text"])
            kept.append(pa.compute.and_(pa.compute.not_equal(lang, "und"), pa.compute.greater_equal(score, least)))
        return pa.concat_arrays(kept)

    return df.filter(known(col(text_col).cast("string")))


def learned(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: two of three, by a checksum of the id."""
    return df.filter(F.crc32(col(id_col).cast("string").cast("binary")) % 3 != 1)


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from documents whose checksum allows it."""
    docs = table(spark, folder, "documents")
    model = train(learned(docs), "doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return identify(docs, model).withColumn("held_out", held)
