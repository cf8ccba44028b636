"""URL filters: rules on hosts and paths, looked up in a sorted array of digests.

The keys of all rules are 64-bit xxhash values in one sorted, memory-mapped array. A task makes the possible
keys of a batch of urls, finds them by one vectorised binary search, and confirms each hit on the full rule
string, so that equal digests of different strings do no harm.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, id_field, table, written

MAX_MAPPED_RULES = 2_000_000  # beyond it, rules and urls meet in a join by digest instead

HOST = r"^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def _ascii_lower(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url) -> tuple:
    """(host, path) of a url column. Without ``://`` both are empty."""
    text = F.coalesce(url, F.lit(""))
    return (
        _ascii_lower(F.regexp_extract(text, "(?s)" + HOST, 1)).alias("host"),
        F.regexp_extract(text, PATH, 1).alias("path"),
    )


def read_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their string; of equal strings one stays, block before allow."""
    own = rules.select(
        _ascii_lower(col("host")).alias("host"), F.coalesce(col("path"), F.lit("")).alias("path"), col("verdict")
    ).filter("host IS NOT NULL AND verdict IS NOT NULL")
    return own.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("rule", F.concat("host", "path"))


class DigestArray:
    """A sorted array of digests with the strings behind them, in files that tasks map into memory."""

    PARTS = ("keys", "ends", "text")

    def __init__(self, stem: str):
        self.keys, self.ends, self.text = (np.load(f"{stem}-{part}.npy", mmap_mode="r") for part in self.PARTS)

    @classmethod
    def build(cls, stem: str, strings: Sequence[bytes]) -> None:
        keys = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))
        order = np.argsort(keys, kind="stable")
        sized = [strings[i] for i in order]
        ends = np.cumsum([0, *map(len, sized)], dtype=np.int64)
        text = np.frombuffer(b"".join(sized) or b"\0", np.uint8)
        for part, values in zip(cls.PARTS, (keys[order], ends, text)):
            np.save(f"{stem}-{part}.npy", values)

    def find(self, strings: Sequence[bytes]) -> list[int]:
        """Place of each string in the array, -1 where it is not there."""
        if not len(self.keys) or not strings:
            return [-1] * len(strings)
        wanted = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))
        left = np.searchsorted(self.keys, wanted, side="left")
        out = [-1] * len(strings)
        for i in np.flatnonzero(self.keys[np.minimum(left, len(self.keys) - 1)] == wanted):
            at = int(left[i])
            while at < len(self.keys) and self.keys[at] == wanted[i]:
                if self.text[self.ends[at] : self.ends[at + 1]].tobytes() == strings[i]:
                    out[i] = at
                    break
                at += 1
        return out


def suffixes(host: str, labels: frozenset[int]) -> list[str]:
    """The host and its parents at dots, of those numbers of dots that some rule has."""
    dots, out, end = host.count("."), [], 0
    for at in range(dots + 1):
        if dots - at in labels:
            out.append(host[end:])
        end = host.find(".", end) + 1
    return out


def _candidates(host: str, path: str, labels: frozenset[int], lengths: tuple[int, ...]) -> list[tuple[str, str]]:
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return [(h, p) for h in suffixes(host, labels) for p in prefixes]


def filter_urls(
    df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
    max_mapped: int = MAX_MAPPED_RULES,
) -> DataFrame:
    """One row per input row: id, host, path, rule (null where none fits), verdict.

    A rule fits its host and all subdomains if the path starts with the rule's. The rule with the longest
    string wins; of equally long ones, block, then the lesser string. Urls that no rule fits get ``default``:
    what the array does not hold is not filtered. Null urls and urls without ``://`` have an empty host and
    path, which only a rule with an empty host can fit. Repeated rows are judged each for itself; other
    columns of ``df`` are not read. Up to ``max_mapped`` rules are mapped by the tasks; more rules are joined.
    """
    spark = df.sparkSession
    host, path = split_url(col(url_col))
    urls = df.select(col(id_col).alias("id"), host, path)
    own = written(read_rules(rules), "url-rules")
    shape = own.agg(
        F.count("*").alias("n"),
        F.collect_set(F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
    ).first()
    labels, lengths = frozenset(shape["labels"]), tuple(sorted(shape["lengths"], reverse=True))
    if shape["n"] > max_mapped:
        return _joined(urls, own, labels, lengths, default).withColumnRenamed("id", id_col)
    found = _mapped(spark, urls, own, labels, lengths, default)
    return found.withColumnRenamed("id", id_col)


def _mapped(spark: SparkSession, urls: DataFrame, own: DataFrame, labels, lengths, default: str) -> DataFrame:
    rows = sorted(((r.host, r.path, r.rule, r.verdict) for r in own.collect()))  # max_mapped rules at most
    name = f"rules-{uuid.uuid4().hex}"
    stem = f"{tempfile.mkdtemp()}/{name}"
    # host and path are parted by a byte that no UTF-8 text holds: a.b + c/ is not a.bc + /
    DigestArray.build(stem, [h.encode() + b"\xff" + p.encode() for h, p, _, _ in rows])
    keyed = {h.encode() + b"\xff" + p.encode(): v for h, p, _, v in rows}
    order = DigestArray(stem)
    verdicts = [
        keyed[order.text[order.ends[i] : order.ends[i + 1]].tobytes()] for i in range(len(order.keys))
    ]
    for part in DigestArray.PARTS:
        spark.sparkContext.addFile(f"{stem}-{part}.npy")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = DigestArray(SparkFiles.get(f"{name}-keys.npy").removesuffix("-keys.npy"))
        for batch in batches:
            hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
            row, pairs = [], []
            for i, (h, p) in enumerate(zip(hosts, paths)):
                for pair in _candidates(h, p, labels, lengths):
                    row.append(i)
                    pairs.append(pair)
            places = known.find([h.encode() + b"\xff" + p.encode() for h, p in pairs])
            best: dict[int, tuple] = {}
            for i, at, (h, p) in zip(row, places, pairs):
                if at >= 0:
                    rank = (-len(h) - len(p), verdicts[at] != "block", h + p, verdicts[at])
                    best[i] = min(best.get(i, rank), rank)
            rule = [best[i][2] if i in best else None for i in range(len(hosts))]
            verdict = [best[i][3] if i in best else default for i in range(len(hosts))]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["host"], batch["path"], pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    kind = id_field(urls, "id")
    return urls.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string")


def _joined(urls: DataFrame, own: DataFrame, labels, lengths, default: str) -> DataFrame:
    """The same by a shuffle: each distinct (host, path) meets the rules by digest, then by string."""
    keys = F.udf(
        lambda h, p: _candidates(h, p, labels, lengths), "array<struct<rule_host:string,rule_path:string>>"
    )
    pairs = urls.select("host", "path").distinct()
    probes = pairs.withColumn("k", F.explode(keys("host", "path"))).select(
        "host", "path", F.col("k.rule_host"), F.col("k.rule_path"), F.xxhash64("k.rule_host", "k.rule_path").alias("key")
    )
    known = own.select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "rule", "verdict",
        F.xxhash64("host", "path").alias("key"),
    )
    best = (
        probes.join(known, ["key", "rule_host", "rule_path"])
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length("rule")).alias("n"), (F.col("verdict") != "block").alias("soft"), "rule", "verdict")).alias("b"))
    )
    return urls.join(best, ["host", "path"], "left").select(
        "id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict")
    )


RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Every url of ``pages`` against the given rules."""
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return filter_urls(table(spark, folder, "pages").select("page_id", "url"), rules)


SQL = """
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
judged AS (
  SELECT page_id, host, path, (
    SELECT min(struct_pack(n := -length(rule_host || rule_path), rule := rule_host || rule_path, verdict := verdict))
    FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
  FROM parts)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""
