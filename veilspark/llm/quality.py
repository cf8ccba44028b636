"""Quality of documents from weak labels.

Heuristic labellers that overlap vote for or against a document or abstain. Expectation-maximisation over the
counts of vote patterns in the whole corpus estimates how accurate each labeller is; the posterior of a document's
pattern is its weak label. The posteriors of a bounded sample train a hashed linear scorer, which scores all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, col, id_field, slices, table, utf8, written
from .features import Words, flat_rows, logits, read_words, softmax, sparse_rows, train_linear
from .weak import reliabilities

SAMPLE_DOCUMENTS = 3000  # expected number of documents that the scorer is trained on
LABELLERS = ("case", "symbols", "repeats", "bare words", "shouting", "echoes", "endings", "word length", "sentences")


_PLAIN_END = np.zeros(256, bool)
_PLAIN_END[48:58] = _PLAIN_END[65:91] = _PLAIN_END[97:123] = _PLAIN_END[128:] = True
_PLAIN_END[np.frombuffer(b".,;:!?'\")", np.uint8)] = True


def votes(w: Words) -> list[str]:
    """One answer per labeller and text: '+', '-' or '0'. Texts of fewer than five words get '0' throughout."""
    n = np.diff(w.at).astype(np.float64)
    share = lambda values: w.sums(values) / np.maximum(1, n)
    upper = w.sums(w.upper) / np.maximum(1, w.sums(w.letters))
    length = share(w.length)
    ends = share(np.isin(w.last, np.frombuffer(b".!?", np.uint8)))
    plain = _PLAIN_END[w.last]
    # each kind of junk is seen by two labellers at least, which is what their accuracies are estimated from
    opinions = [
        (upper < 0.2, upper > 0.5),
        (share(w.symbols > 0) < 0.03, share(w.symbols > 0) > 0.15),
        (share(w.repeat) < 0.05, share(w.repeat) > 0.25),
        (share(w.letters + w.digits == 0) < 0.03, share(w.letters + w.digits == 0) > 0.2),
        (share(w.last == ord("!")) < 0.05, share(w.last == ord("!")) > 0.3),
        (share(w.echo) < 0.05, share(w.echo) > 0.2),
        (share(plain) > 0.95, share(plain) < 0.85),
        ((length > 2.5) & (length < 15), (length < 1.5) | (length > 30)),
        ((ends > 0.01) & (ends < 0.4), ends > 0.7),
    ]
    signs = np.full((len(n), len(opinions)), "0")
    for i, (good, bad) in enumerate(opinions):
        signs[good, i], signs[bad, i] = "+", "-"
    signs[n < 5] = "0"
    return ["".join(row) for row in signs]


def _first_belief(marks: str) -> float:
    """Junk is of one kind at a time, so one vote against outweighs any number of votes for a document."""
    return 0.05 if "-" in marks else 0.95 if "+" in marks else 0.5


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = SAMPLE_DOCUMENTS) -> tuple:
    """(posterior by vote pattern, weights, bias). Patterns are counted over all rows, and those that no row has get the
    posterior that the estimated rates give; the scorer learns from about ``documents`` of them, chosen by a hash."""
    src = _texts(df, id_col, text_col).withColumn("h", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)))
    share = min(1.0, documents / max(1, df.count()))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for piece in slices(batch):
                w = read_words(*utf8(piece["text"]), hasher)
                chosen = pa.compute.less(piece["h"], int(share * (1 << 30))).to_pylist()
                rows = sparse_rows(w) if any(chosen) else [None] * len(chosen)
                rows = [r if c else None for r, c in zip(rows, chosen)]
                yield pa.RecordBatch.from_pydict({
                    "votes": pa.array(votes(w), pa.string()),
                    "ids": pa.array([r and r[0] for r in rows], pa.list_(pa.int32())),
                    "vals": pa.array([r and r[1] for r in rows], pa.list_(pa.float32())),
                })

    labelled = written(src.mapInArrow(label, "votes string, ids array<int>, vals array<float>"), "votes")
    counts = {("", r["votes"]): r["count"] for r in labelled.groupBy("votes").count().collect()}  # 3**9 at most
    every = (("", "".join(p)) for p in product("+-0", repeat=len(LABELLERS)))
    post = {k[1]: p for k, p in reliabilities(counts, _first_belief, also=every).items()}
    # rows come in any order; sums of floats should not
    rows = labelled.filter("ids IS NOT NULL AND size(ids) > 0").orderBy("votes", F.xxhash64("ids", "vals")).toArrow()
    if not rows.num_rows:
        return post, None, None
    good = np.array([post[v] for v in rows["votes"].to_pylist()])
    return post, *train_linear(*flat_rows(rows), np.stack([1 - good, good], axis=1))


def score_quality(
    df: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5
) -> DataFrame:
    """One row per input row: id, votes, weak_label (posterior of the votes), score (of the linear scorer), kept.

    ``kept`` means a score of ``least`` or more. Texts without words, null ones included, score 0 and are not kept.
    Repeated rows score alike; other columns are not read. A vote pattern that no training row had is scored like others.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post, weights, bias = shared.value
        hasher = WordHasher()
        for batch in batches:
            for piece in slices(batch):
                w = read_words(*utf8(piece["text"]), hasher)
                marks = votes(w)
                full = np.diff(w.at) > 0
                good = softmax(logits(w, weights, bias))[:, 1] if weights is not None else np.zeros(len(full))
                good = np.where(full, good, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [piece["id"], pa.array(marks, pa.string()), pa.array([post[m] for m in marks]), pa.array(good), pa.array(good >= least)],
                    names=["id", "votes", "weak_label", "score", "kept"],
                )

    src = _texts(df, id_col, text_col)
    fields = f"id {id_field(src, 'id')}, votes string, weak_label double, score double, kept boolean"
    return src.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned without labels."""
    docs = table(spark, folder, "documents")
    return score_quality(docs, train(docs))
