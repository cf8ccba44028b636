"""Mixing by soft membership: document rates that bring domains to target weights.

A classifier learned from a labelled table gives every document a posterior over domains, so a document belongs
to all of them in part. Rates of documents start at one and are fitted by projected gradient least squares: the
expected tokens of a domain, summed over rate * tokens * posterior, shall match its target, and rates stay
nonnegative. A step moves each rate along its posterior, scaled by the domains' second moments, and cuts at zero.
All that a step needs are a few sums per domain, so each is one aggregation, and the rate of a document follows
from its posterior and the steps taken: nothing of document size is kept between steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, col, id_field, slices, table, utf8, written
from .features import flat_rows, logits, read_words, softmax, sparse_rows, train_linear

SAMPLE_LABELS = 4000  # labelled documents that the classifier learns from, at most
STEPS = 40
CLOSE = 1e-9  # largest miss of a target, as a share of all tokens, at which steps end


def train(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain",
    sample: int = SAMPLE_LABELS,
) -> tuple[list[str], np.ndarray | None, np.ndarray | None]:
    """(domains, weights, bias) from at most ``sample`` labels (id, domain), chosen by a hash; null ones do not count."""
    known = labels.select(col(id_col).alias("id"), col(domain_col).cast("string").alias("domain"))
    known = known.filter("id IS NOT NULL AND domain IS NOT NULL").distinct()
    chosen = known.orderBy(F.xxhash64("id", "domain"), "id", "domain").limit(sample)
    src = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    # the labels are bounded by ``sample``, so they may be broadcast
    texts = src.filter("text IS NOT NULL").join(F.broadcast(chosen), "id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for piece in slices(batch):
                rows = sparse_rows(read_words(*utf8(piece["text"]), hasher))
                yield pa.RecordBatch.from_arrays(
                    [piece["domain"], pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))],
                    names=["domain", "ids", "vals"],
                )

    rows = texts.select("domain", "text").mapInArrow(extract, "domain string, ids array<int>, vals array<float>")
    # rows come in any order; sums of floats should not
    rows = rows.orderBy("domain", F.xxhash64("ids", "vals")).toArrow()
    names = rows["domain"].to_pylist()
    domains = sorted(set(names))
    if not domains:
        return [], None, None
    return domains, *train_linear(*flat_rows(rows), np.array([[n == d for d in domains] for n in names], float))


def memberships(df: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, p): words of each text and its posterior over the model's domains, in their order."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, weights, bias = shared.value
        hasher = WordHasher()
        for batch in batches:
            for piece in slices(batch):
                w = read_words(*utf8(piece["text"]), hasher)
                p = softmax(logits(w, weights, bias))
                ends = np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [piece["id"], pa.array(np.diff(w.at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(p.ravel()))],
                    names=["id", "n_tokens", "p"],
                )

    src = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {id_field(src, 'id')}, n_tokens bigint, p array<double>")


def rate_of(steps: list[np.ndarray], least: str = "0.0D") -> str:
    """SQL of the rate that a posterior ``p`` has after the steps; ``least`` is the SQL of its lower bound."""
    rate = "1.0D"
    if steps:
        moves = ", ".join("array(" + ", ".join(f"{x:.17g}D" for x in s) + ")" for s in steps)
        along = "aggregate(zip_with(p, s, (a, b) -> a * b), 0.0D, (t, x) -> t + x)"
        rate = f"aggregate(array({moves}), 1.0D, (r, s) -> greatest({least}, r - {along}))"
    return rate


def fit_rates(members: DataFrame, targets: list[float], most: int = STEPS, close: float = CLOSE, least: str = "0.0D") -> list[np.ndarray]:
    """The steps that bring the expected tokens of each domain to ``targets``, rates being ``least`` (SQL) or more."""
    d = len(targets)
    goal, total = np.array(targets), max(1.0, float(sum(targets)))
    steps: list[np.ndarray] = []
    for _ in range(most):
        rows = members.withColumn("r", F.expr(rate_of(steps, least)))
        mass = [F.sum(F.expr(f"r * n_tokens * p[{i}]")).alias(f"s{i}") for i in range(d)]
        moments = [F.sum(F.expr(f"if(r > 0, n_tokens * p[{i}] * p[{j}], 0.0D)")).alias(f"m{i}_{j}") for i in range(d) for j in range(d)]
        got = rows.agg(*mass, *moments).first()
        miss = np.array([got[f"s{i}"] or 0.0 for i in range(d)]) - goal
        if np.abs(miss).max() <= close * total:
            break
        m = np.array([[got[f"m{i}_{j}"] or 0.0 for j in range(d)] for i in range(d)])
        step = np.linalg.solve(m + 1e-9 * total * np.eye(d), miss)
        if steps and np.abs(step).max() < 1e-12:
            break
        steps.append(step)
    return steps


def mix_to_targets(
    df: DataFrame, model: tuple, weights: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text",
    whole: str | None = None, factor: float = 1.0,
) -> DataFrame:
    """One row per input row: id, n_tokens, posteriors by domain, rate, copies.

    Targets are ``weights`` (of the model's domains; missing ones are 0) as shares of a total. The total is that of
    the corpus; with ``whole``, that which gives this domain ``factor`` times the expected tokens it has now, and
    documents that are likeliest of it have a rate of 1 at least.
    ``copies`` is the rate rounded down or up, up with the probability of its fraction, by a hash of id and text
    length. Null and empty texts have no tokens and weigh nothing; their rate follows from the posterior of no
    words. Where targets cannot be met by nonnegative rates, the rates are those nearest in least squares that
    the steps reach. Without a model (no labels) every rate is 1. Other columns are not read.
    """
    domains = model[0]
    src = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    if not domains:
        return src.select(
            F.col("id").alias(id_col), F.lit(None).cast("bigint").alias("n_tokens"), F.lit(None).cast("map<string,double>").alias("domains"),
            F.lit(1.0).alias("rate"), F.lit(1).alias("copies"),
        )
    members = written(memberships(src, model, "id", "text"), "members")
    now = members.agg(*[F.sum(F.expr(f"n_tokens * p[{i}]")).alias(f"t{i}") for i in range(len(domains))]).first()
    now = [x or 0.0 for x in now]
    shares = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    if not shares.sum():
        raise ValueError(f"no weight for any of the domains {domains}")
    shares = shares / shares.sum()
    total = sum(now)
    least = "0.0D"
    if whole is not None:
        at = domains.index(whole)
        total = factor * now[at] / shares[at]
        least = f"if(p[{at}] = array_max(p), 1.0D, 0.0D)"
    steps = fit_rates(members, list(shares * total), least=least)
    names = ", ".join(f"'{d}'" for d in domains)
    chance = F.pmod(F.xxhash64("id", "n_tokens"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return members.withColumn("rate", F.expr(rate_of(steps, least))).select(
        F.col("id").alias(id_col), "n_tokens", F.expr(f"map_from_arrays(array({names}), p)").alias("domains"), "rate",
        (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int").alias("copies"),
    )


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else good or poor by quality."""
    domain = F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END")
    return labels.select("doc_id", domain.alias("domain"))


WEIGHTS = {"good": 0.9, "poor": 0.06, "toxic": 0.04}


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of all documents for the weights above, domains learned from ``labels``."""
    docs = table(spark, folder, "documents")
    model = train(docs, label_domains(table(spark, folder, "labels")))
    rows = mix_to_targets(docs, model, WEIGHTS)
    one = [F.coalesce(F.col("domains")[d], F.lit(0.0)).alias(f"p_{d}") for d in WEIGHTS]
    return rows.select("doc_id", "n_tokens", *one, "rate", "copies")
