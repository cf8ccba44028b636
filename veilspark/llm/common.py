"""What several operators share: written tables, bounded slices of Arrow batches, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

SLICE_BYTES = 2 << 20  # text bytes that a task works on at a time; a longer text is a slice of its own


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and not lost with an executor."""
    spark = df.sparkSession
    path = shared_folder(spark, f"llm-{name}") + "/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def col(name: str):
    """A column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; callers may pass a path of their own instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of ``column``, one row at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text begins and ends; nulls count as empty."""
    filled = pa.compute.fill_null(column, "").cast(pa.large_string())
    starts = np.frombuffer(filled.buffers()[1], np.int64, len(filled) + 1, filled.offset * 8)
    if starts[-1] == starts[0]:
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    data = np.frombuffer(filled.buffers()[2], np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 20)) * np.uint64(0x9E3779B97F4A7C15))


_BASE = 0x5851F42D4C957F2D  # odd, so that its powers can be undone modulo 2**64


class WordHasher:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of many texts at once, A-Z in lower case.

    A word's hash is a polynomial in its bytes. Running sums over the whole slice give all of them at once.
    """

    def __init__(self):
        lower = np.arange(256)
        lower[65:91] += 32
        self.values = seeds(256, 1)[lower]
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]), dtype=np.uint64)
                for b in (_BASE, inverse)
            )

    def places(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of every word, and the byte after its last. Words end where their text ends."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        solid = ~self.space[data]
        edge = np.zeros(n + 1, bool)
        edge[starts] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:n]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | edge[1:n]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    def words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and the place of each text's first word (one more entry for the end)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
        self._powers(n)
        first, after = self.places(data, starts)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=sums[1:])
        hashes = mix((sums[after] - sums[first]) * self.down[first] + (after - first - 1).astype(np.uint64))
        return hashes, np.searchsorted(first, starts)


def id_field(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
