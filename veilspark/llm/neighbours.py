"""Approximate nearest neighbours by largest inner product: an inverted multi-index.

Each half of the vectors has a codebook of its own, and a vector lies in the cell (first code, second code). A
query sums the products of its halves with their centroids; a heap walks the pairs of codes by falling sum until
the cells met hold enough rows. Those rows are compared exactly, in double precision, cell by cell. Cells with one
first code are a list; lists and queries are cut into blocks, and each pair of blocks is one group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, id_field, table, written

CODES = 64  # per half, so 4096 cells
SAMPLE_ROWS = 20_000  # vectors that the codebooks are fitted on
REACH = 0.5  # share of all rows that a query's cells hold, at least
BLOCK_ROWS = 16_384  # rows, and queries, that meet in one group at most, on average
_STEPS = 12


def usable(vec) -> object:
    """Whether a vector column takes part: no null, no null or non-finite component, not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0)


def fit_codebook(x: np.ndarray, codes: int, steps: int = _STEPS) -> np.ndarray:
    """Lloyd's centroids from the distinct rows of ``x``; as many as there are, at most ``codes``."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), min(codes, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = assign(x, centres)
        for c in range(len(centres)):
            own = x[near == c]
            if len(own):
                centres[c] = own.mean(axis=0)
    return centres


def assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells by falling sum of ``first[i] + second[j]`` until they hold ``enough`` rows; cell = i * codes + j."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, pushed, out, held = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in pushed:
                pushed.add((p, q))
                heapq.heappush(heap, (-(first[a[p]] + second[b[q]]), p, q))
    return out


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 0))


def nearest(
    df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
    codes: int = CODES, sample: int = SAMPLE_ROWS, reach: float = REACH, block: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest rows of ``df`` found for each row of ``queries``: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision; ties go to the lesser id, and a row is no candidate of a
    query with the same id. Vectors that are null, zero, or hold null or non-finite components take no part, as
    do rows with a null id. All vectors must have one length. Rows that repeat an id count once, as the first in
    the order of their vectors. Codebooks are fitted on about ``sample`` rows chosen by a hash; all rows are
    indexed. A query visits cells until they hold ``reach`` of the rows and ``k + 1`` at least. Other columns
    are not read.
    """
    spark = df.sparkSession

    def clean(rows: DataFrame) -> DataFrame:
        rows = rows.select(col(id_col).alias("id"), col(vec_col).cast("array<double>").alias("v"))
        return rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))

    vectors = written(clean(df), "vectors")
    asked = written(clean(queries), "queries")
    n = vectors.count()
    kind = id_field(vectors, "id")
    empty = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    if n == 0:
        return empty
    share = min(1.0, sample / n)
    rows = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).select("v").collect()
    x = np.array([r["v"] for r in (rows or vectors.select("v").limit(sample).collect())])
    half = x.shape[1] // 2
    books = [fit_codebook(x[:, :half], codes), fit_codebook(x[:, half:], codes)] if half else [np.zeros((1, 0)), fit_codebook(x, codes)]
    width = len(books[1])

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                m = _matrix(rows["v"])
                yield rows.assign(cell=assign(m[:, :half], books[0]) * width + assign(m[:, half:], books[1]))

    placed = written(vectors.mapInPandas(index, f"id {kind}, v array<double>, cell int"), "cells")
    counted = placed.groupBy("cell").count().collect()  # codes * codes rows at most
    sizes = np.zeros(len(books[0]) * width, np.int64)
    for r in counted:
        sizes[r["cell"]] = r["count"]
    enough = max(k + 1, int(np.ceil(reach * n)))
    lists = sizes.reshape(len(books[0]), width).sum(axis=1)
    row_parts = np.maximum(1, -(-lists // block))  # a list of many rows is cut by a hash of the id
    query_parts = max(1, -(-asked.count() // block))  # and so are many queries

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: list[tuple] = []
            for who, v in zip(rows["id"], rows["v"]):
                x = np.asarray(v, np.float64)
                lists_of: dict[int, list[int]] = {}
                for cell in walk(books[0] @ x[:half], books[1] @ x[half:], sizes, enough):
                    lists_of.setdefault(cell // width, []).append(cell)
                out += [(who, v, i, p, cells) for i, cells in lists_of.items() for p in range(row_parts[i])]
            yield pd.DataFrame(out, columns=["id", "v", "list", "row_part", "cells"])

    parts_of = F.element_at(F.array(*[F.lit(int(p)) for p in row_parts]), F.col("list") + 1)
    cut = (
        placed.withColumn("list", F.expr(f"cell div {width}").cast("int"))
        .withColumn("row_part", F.pmod(F.xxhash64("id"), parts_of).cast("int"))
        .withColumn("query_part", F.explode(F.expr(f"sequence(0, {query_parts - 1})")))
    )
    probes = asked.mapInPandas(probe, f"id {kind}, v array<double>, list int, row_part int, cells array<int>")
    probes = probes.withColumn("query_part", F.pmod(F.xxhash64("id"), F.lit(query_parts)).cast("int"))

    def compare(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        left = left.sort_values("id", kind="stable")
        ids, rows, cells = left["id"].to_numpy(), _matrix(left["v"]), left["cell"].to_numpy()
        members = {c: np.flatnonzero(cells == c) for c in np.unique(cells)}
        who, asks = right["id"].to_numpy(), _matrix(right["v"])
        wanted: dict[int, list[int]] = {}
        for at, own in enumerate(right["cells"]):
            for c in own:
                wanted.setdefault(int(c), []).append(at)
        met: list[list[tuple]] = [[] for _ in who]
        for c, some in sorted(wanted.items()):
            place = members.get(c)
            if place is not None:
                # one sum per pair in the same order, so that equal vectors have equal scores
                for at, scores in zip(some, np.einsum("qj,ij->qi", asks[some], rows[place])):
                    met[at].append((place, scores))
        out = []
        for at, found in enumerate(met):
            if found:
                place, scores = (np.concatenate(x) for x in zip(*found))
                other = ids[place] != who[at]
                place, scores = place[other], scores[other]
                best = np.lexsort((place, -scores))[:k]  # places follow the ids
                out.append((np.full(len(best), who[at]), ids[place[best]], scores[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out))))) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["list", "row_part", "query_part"]
    found = cut.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(compare, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found for every twentieth vector, among all others."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 20 = 0"))
