"""Byte-level BPE, encoding and decoding.

Merging keeps a segment tree over the ranks of adjacent pairs. A leaf holds (rank, place) of the pair that
begins there, so the root is the leftmost of the lowest ranks. A merge changes three leaves, each repaired in
logarithmic time; it goes on until no pair at the root has a rank. Short pieces run as many trees at once in
numpy, long ones as one tree each. A piece met before in the task is taken from a cache.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import SLICE_BYTES, col, id_field, slices, table, tokenizer_path

# fixed value: how the public vocabulary cuts a text before merging
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same cut where a text has only characters of ASCII and the Latin letters up to U+024F, which the plain
# engine knows by ranges. No two alternatives begin alike, so their order is free.
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_PLAIN_TEXT = f"[\\t-\\r -~{_LATIN}]*"
_PLAIN_PIECES = f" ?[{_LATIN}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\\t-\\r 0-9{_LATIN}]+|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+"
CACHED_PIECES = 400_000  # per task; a full cache is emptied, which costs time, not results
LONG_PIECE = 256  # bytes
_FREE = np.int32(2**31 - 1)  # rank of a pair that does not merge; others are below 2**23


@dataclass(frozen=True)
class Vocabulary:
    """Ids of the bytes, the merges by rank, and the bytes of every id."""

    byte_ids: np.ndarray
    byte_pairs: np.ndarray  # rank by left byte * 256 + right byte
    pair_keys: np.ndarray  # left id * 2**20 + right id, sorted
    pair_ranks: np.ndarray
    merged: np.ndarray  # id by rank
    content: dict[int, bytes]
    special: dict[str, int]

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        ids = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(ids[a] << 20) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        content = {i: bytes(back[c] for c in token) for token, i in ids.items() if all(c in back for c in token)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        content |= {i: text.encode() for text, i in special.items()}
        byte_ids = np.array([ids[c] for c in letters], np.int32)
        merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        bare = Vocabulary(byte_ids, merged, keys[order], order.astype(np.int32), merged, content, special)
        both = np.arange(65536)
        return replace(bare, byte_pairs=bare.ranks(byte_ids[both >> 8], byte_ids[both & 255]))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_FREE`` for pairs that do not merge."""
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _FREE)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else free))
        free += b not in shown
    return out


def merge_many(v: Vocabulary, pieces: Sequence[bytes]) -> list[list[int]]:
    """Token ids of pieces of 2 to ``LONG_PIECE`` bytes, all trees in one array."""
    n, longest = len(pieces), max(map(len, pieces))
    size = 1 << (longest - 1).bit_length()
    lengths = np.fromiter(map(len, pieces), np.int32, n)
    inside = np.arange(size) < lengths[:, None]
    raw = np.zeros((n, size), np.uint8)
    raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    # flat arrays: piece i has its tokens from i * size on, its tree from i * 2 * size on
    tok = v.byte_ids[raw].ravel()
    after = np.tile(np.arange(1, size + 1, dtype=np.int32), n)  # place of the next token; the length ends a piece
    before = np.tile(np.arange(-1, size - 1, dtype=np.int32), n)
    leaf = np.full((n, size), _FREE, np.int32)
    pair = v.byte_pairs[(raw[:, :-1].astype(np.int32) << 8) | raw[:, 1:]]
    usable = inside[:, 1:] & (pair < _FREE)
    np.copyto(leaf[:, :-1], (pair << 8) | np.arange(size - 1, dtype=np.int32), where=usable)
    tree = np.empty((n, 2 * size), np.int32)
    tree[:, size:] = leaf
    width = size
    while width > 1:
        width >>= 1
        np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2], out=tree[:, width : 2 * width])
    tree = tree.ravel()
    base = np.arange(n) * size
    size_of = lengths
    root = tree[2 * base + 1]
    live = root < _FREE
    while live.any():
        base, root, size_of = base[live], root[live], size_of[live]
        at = (root & 0xFF).astype(np.int64)
        here = base + at
        gone = after[here]
        last = base + gone
        nxt = after[last]
        tok[here] = v.merged[root >> 8]
        tok[last] = -1
        after[here] = nxt
        more = nxt < size_of
        follows = np.where(more, base + nxt, here)
        before[follows] = np.where(more, at, before[follows])
        prev = before[here]
        back = prev >= 0
        ahead = np.where(back, base + prev, here)
        left, right = np.concatenate([tok[here], tok[ahead]]), np.concatenate([tok[follows], tok[here]])
        rank = v.ranks(left, right)
        rank[: len(at)][~more] = _FREE
        rank[len(at) :][~back] = _FREE
        place = np.concatenate([at, np.where(back, prev, at)])
        value = np.where(rank < _FREE, (rank << 8) | place.astype(np.int32), _FREE)
        ground = 2 * base + size
        # the leaf before the merged token is written first: without one it stands for the merged token itself
        tree[ground + place[len(at) :]] = value[len(at) :]
        tree[ground + at] = value[: len(at)]
        tree[ground + gone] = _FREE
        node, trunk = np.concatenate([place, gone]) + size, np.tile(2 * base, 3)
        for _ in range(size.bit_length() - 1):
            node >>= 1
            child = trunk + 2 * node
            tree[trunk + node] = np.minimum(tree[child], tree[child + 1])
        root = tree[2 * base + 1]
        live = root < _FREE
    kept = tok.reshape(n, size)
    solid = inside & (kept >= 0)
    ends, flat = np.cumsum(solid.sum(axis=1)).tolist(), kept[solid].tolist()
    return [flat[b:e] for b, e in zip([0, *ends], ends)]


def merge_one(v: Vocabulary, piece: bytes) -> list[int]:
    """Token ids of one piece of any length, by a tree in plain Python."""
    n = len(piece)
    size = 1 << max(0, n - 1).bit_length()
    tok = v.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    ranks = v.ranks(np.array(tok[:-1]), np.array(tok[1:])).tolist()
    none, table_ = int(_FREE), dict(zip(v.pair_keys.tolist(), v.pair_ranks.tolist()))
    end = none << 32
    tree = [end] * (2 * size)
    for i, r in enumerate(ranks):
        tree[size + i] = (r << 32) | i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(place: int) -> None:
        nxt = after[place]
        rank = table_.get((tok[place] << 20) | tok[nxt], none) if nxt < n else none
        node = size + place
        tree[node] = (rank << 32) | place
        while node > 1:
            node >>= 1
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

    while tree[1] < end:
        rank, at = tree[1] >> 32, tree[1] & 0xFFFFFFFF
        gone = after[at]
        tok[at] = int(v.merged[rank])
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        tok[gone], after[gone] = -1, n
        put(at)
        put(gone)
        if before[at] >= 0:
            put(before[at])
    return [t for t in tok if t >= 0]


class Encoder:
    """Texts to ids. ``ids_text`` gives the decimal ids joined by commas, the form that is hashed and stored."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.any_cut = regex.compile(PIECES).findall
        self.plain, self.plain_cut = re.compile(_PLAIN_TEXT).fullmatch, re.compile(_PLAIN_PIECES).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.known: dict[str, str] = {}
        self.parts = {str(i): b for i, b in v.content.items()}

    def cut(self, text: str) -> list[str]:
        return self.plain_cut(text) if self.plain(text) else self.any_cut(text)

    def _learn(self, pieces: set[str]) -> None:
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode("utf-8")
            if len(data) == 1:
                self.known[piece] = f",{self.v.byte_ids[data[0]]}"
            elif len(data) > LONG_PIECE:
                self.known[piece] = "".join(f",{i}" for i in merge_one(self.v, data))
            else:
                by_size.setdefault((len(data) - 1).bit_length(), []).append((piece, data))
        for group in by_size.values():
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                for (piece, _), ids in zip(part, merge_many(self.v, [d for _, d in part])):
                    self.known[piece] = "," + ",".join(map(str, ids))

    def ids_texts(self, texts: Sequence[str]) -> list[str]:
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        cut = []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            # every second part is a special token
            cut.append([(p, None) if i % 2 else (None, self.cut(p)) for i, p in enumerate(parts)])
        fresh: set[str] = set()
        for parts in cut:
            for _, pieces in parts:
                if pieces:
                    fresh.update(pieces)
        self._learn(fresh.difference(self.known))
        known = self.known
        return [
            "".join(
                f",{self.v.special[name]}" if name else "".join(map(known.__getitem__, pieces))
                for name, pieces in parts
            )[1:]
            for parts in cut
        ]

    def decode(self, ids_text: str) -> str:
        """Text of ids, special tokens included. Bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.parts.__getitem__, ids_text.split(","))) if ids_text else b""
        return data.decode("utf-8", "replace")


def _batches(spark: SparkSession, path: str | None):
    return spark.sparkContext.broadcast(Vocabulary.read(path or tokenizer_path("byte_bpe_50k.json")))


def encode_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decoded: bool = False,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per input row: id, n_tokens, ids (array of int), ids_sha256; with ``decoded`` also the text that
    the ids decode to and its digest.

    A null text counts as empty: no ids, the digest of the empty string. Texts are encoded whole, whatever their
    length; repeated rows and null ids give a row each; other columns of ``df`` are not read.
    ``keep_ids=False`` leaves ids and decoded text out and gives the digests alone. The vocabulary is a file of
    some 50,000 entries (``path``) and is broadcast; nothing is shuffled.
    """
    shared = _batches(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                texts = [t or "" for t in piece["text"].to_pylist()]
                ids = encoder.ids_texts(texts)
                out = {
                    "id": piece["id"],
                    "n_tokens": pa.array([i.count(",") + 1 if i else 0 for i in ids], pa.int64()),
                    "ids_sha256": pa.array(map(sha, ids), pa.string()),
                }
                if keep_ids:
                    out["ids"] = pa.array([np.array(i.split(","), np.int32) if i else [] for i in ids], pa.list_(pa.int32()))
                if decoded:
                    back = [encoder.decode(i) for i in ids]
                    out["decoded_sha256"] = pa.array(map(sha, back), pa.string())
                    if keep_ids:
                        out["decoded"] = pa.array(back, pa.string())
                yield pa.RecordBatch.from_pydict(out)

    src = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    fields = [f"id {id_field(src, 'id')}", "n_tokens bigint", "ids_sha256 string"]
    fields += ["ids array<int>"] * keep_ids + ["decoded_sha256 string"] * decoded + ["decoded string"] * (decoded and keep_ids)
    return src.mapInArrow(run, ", ".join(fields)).withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id and decoded text of arrays of ids. A null array gives a null text; an id that is not in the
    vocabulary is an error."""
    shared = _batches(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = shared.value.content
        for batch in batches:
            texts = [
                None if ids is None else b"".join(content[i] for i in ids).decode("utf-8", "replace")
                for ids in batch["ids"].to_pylist()
            ]
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "text": pa.array(texts, pa.string())})

    src = df.select(col(id_col).alias("id"), col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(run, f"id {id_field(src, 'id')}, text string").withColumnRenamed("id", id_col)


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again."""
    docs = table(spark, folder, "documents")
    return encode_documents(docs, decoded=True, keep_ids=False)
