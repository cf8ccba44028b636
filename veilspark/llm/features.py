"""Hashed features of texts and a linear softmax model over them, learned on the driver from a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import WordHasher, mix

WORD_BITS, SHAPE_BITS = 16, 10
WIDTH = (1 << WORD_BITS) + (1 << SHAPE_BITS)

LEAST_DOCUMENTS = 5  # of the sample that a feature must be in to get a weight

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#$%&*|~^<>{}[]\\@=+_`", np.uint8)] = True
# class of a byte as it shows at the edges of words: letters and digits are alike, others are themselves
_EDGE = np.arange(256)
_EDGE[97:123], _EDGE[65:91], _EDGE[48:58], _EDGE[128:] = 97, 65, 48, 97


@dataclass
class Words:
    """What is known of each word of a slice, and where each text's words begin (one more entry for the end)."""

    hashes: np.ndarray
    at: np.ndarray
    length: np.ndarray
    letters: np.ndarray
    digits: np.ndarray
    upper: np.ndarray
    symbols: np.ndarray
    first: np.ndarray
    last: np.ndarray
    repeat: np.ndarray  # equals the word before it in the text
    echo: np.ndarray  # equals the word two before

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of each word, per text."""
        total = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
        return total[self.at[1:]] - total[self.at[:-1]]


def read_words(data: np.ndarray, starts: np.ndarray, hasher: WordHasher) -> Words:
    hashes, at = hasher.words(data, starts)
    begin, end = hasher.places(data, starts)

    def count(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(kind[data], dtype=np.int32)])
        return total[end] - total[begin]

    place = np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))

    def same(back: int) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        out[back:] = hashes[back:] == hashes[: max(0, len(hashes) - back)]
        return out & (place >= back)

    edge = (data[begin], data[end - 1]) if len(begin) else (data[:0], data[:0])
    return Words(
        hashes, at, end - begin, count(_LETTER), count(_DIGIT), count(_UPPER), count(_SYMBOL), *edge, same(1), same(2)
    )


def feature_ids(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its word feature and of its shape feature."""
    word = (w.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    caps = np.where(w.upper == 0, 0, np.where(w.upper == w.letters, 2, 1))
    shape = _EDGE[w.first].astype(np.uint64)
    for part, size in ((_EDGE[w.last], 256), (caps, 3), (w.repeat, 2), (np.minimum(w.length // 4, 3), 4), (np.minimum(w.symbols, 3), 4)):
        shape = shape * np.uint64(size) + part.astype(np.uint64)
    return word, (1 << WORD_BITS) + (mix(shape + np.uint64(1)) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64)


def scales(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Weight of a word feature and of a shape feature in each text."""
    n = np.maximum(1, np.diff(w.at)).astype(np.float64)
    return 8 / np.sqrt(n), 32 / n


def sparse_rows(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, values) of each text."""
    word, shape = feature_ids(w)
    out = []
    for begin, end, a, b in zip(w.at[:-1], w.at[1:], *scales(w)):
        ids, n = np.unique(np.concatenate([word[begin:end], shape[begin:end]]), return_counts=True)
        out.append((ids.astype(np.int32), (n * np.where(ids >> WORD_BITS, b, a)).astype(np.float32)))
    return out


def logits(w: Words, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Linear scores of each text by class; ``bias`` alone for texts without words."""
    word, shape = feature_ids(w)
    a, b = scales(w)
    out = np.empty((len(w.at) - 1, len(bias)))
    for c in range(len(bias)):
        out[:, c] = bias[c] + a * w.sums(weights[c][word]) + b * w.sums(weights[c][shape])
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def flat_rows(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, values, row numbers) of the list columns ``ids`` and ``vals`` of a table."""
    ids, vals = (rows[c].combine_chunks() for c in ("ids", "vals"))
    sizes = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy()
    flat = lambda x: x.flatten().to_numpy()
    return flat(ids), flat(vals), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def train_linear(
    ids: np.ndarray, values: np.ndarray, owner: np.ndarray, labels: np.ndarray,
    steps: int = 200, rate: float = 0.1, ridge: float = 1e-4,
) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a softmax model from flat sparse rows and class probabilities, by Adam over all rows."""
    n, classes = labels.shape
    weights, bias = np.zeros((classes, WIDTH)), np.log(labels.mean(axis=0) + 1e-6)
    # a feature of few documents would only learn these by heart
    common = np.bincount(ids, minlength=WIDTH)[ids] >= min(LEAST_DOCUMENTS, n)
    ids, values, owner = ids[common], values[common], owner[common]
    if not len(ids):
        return weights, bias
    used, ids = np.unique(ids, return_inverse=True)
    own = np.zeros((classes, len(used)))
    m, v = np.zeros((classes, len(used) + 1)), np.zeros((classes, len(used) + 1))
    for step in range(1, steps + 1):
        z = np.stack([np.bincount(owner, own[c][ids] * values, n) + bias[c] for c in range(classes)], axis=1)
        off = (softmax(z) - labels) / n
        grad = np.stack(
            [np.append(np.bincount(ids, values * off[owner, c], len(used)) + ridge * own[c], off[:, c].sum()) for c in range(classes)]
        )
        m += 0.1 * (grad - m)
        v += 0.001 * (grad**2 - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        own -= move[:, :-1]
        bias -= move[:, -1]
    weights[:, used] = own
    return weights, bias
