"""Document fingerprints: Merkle trees over paragraphs and sections.

A text is cut at newlines into paragraphs, and a paragraph into pieces: runs of up to 40 characters that end
with their sentence. Pieces are the leaves; a paragraph's digest is made of its pieces' digests, a section's of
its paragraphs', the root of the sections'. A section ends after a paragraph whose digest says so (one of four),
so an edit moves no boundary but its own. Equal roots mean equal texts; where roots differ, differing branches
lead to the edit. The fingerprint spells the tree: ``root:sections:paragraphs:pieces``, 8 digits per branch.

All expressions are SQL over one row. The one shuffle brings each document next to its successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import let
from .common import col, table

PIECE = r"[^.!?]{1,40}[.!?]*|[.!?]+"
SECTION = r"(?:[0-9a-f]{31}[4-9a-f] )*+[0-9a-f]{31}[0-3] |(?:[0-9a-f]{31}[4-9a-f] )++"
BUCKET_ROWS, MOST_BUCKETS = 1000, 65536


def tree(text: str) -> str:
    """SQL of the tree of a text column: struct<root, sections, paragraphs, pieces>, digests as arrays.

    A null text counts as empty, whose tree has one empty paragraph. ``root`` is a SHA-256, branches are MD5.
    """
    pieces = f"""transform(split(coalesce({text}, ''), '\\\\n', -1),
      p -> transform(regexp_extract_all(p, r'{PIECE}', 0), q -> md5(q)))"""
    paragraphs = "transform(leaves, a -> md5(array_join(a, '')))"
    sections = f"transform(regexp_extract_all(concat(array_join(pars, ' '), ' '), r'{SECTION}', 0), s -> md5(s))"
    whole = """named_struct('root', sha2(array_join(secs, ''), 256), 'sections', secs, 'paragraphs', pars,
      'pieces', transform(flatten(leaves), x -> substr(x, 1, 8)))"""
    return let(pieces, "leaves", let(paragraphs, "pars", let(sections, "secs", whole)))


def spelled(tree_: str) -> str:
    """The fingerprint string of a tree."""
    short = lambda part: f"array_join(transform({tree_}.{part}, x -> substr(x, 1, 8)), '')"
    return f"concat_ws(':', {tree_}.root, {short('sections')}, {short('paragraphs')}, {short('pieces')})"


def pieces_of(fingerprint: str) -> str:
    """The leaves of a fingerprint string, as SQL."""
    return f"regexp_extract_all(substring_index({fingerprint}, ':', -1), '[0-9a-f]{{8}}', 0)"


def likeness(a: str, b: str) -> str:
    """0 to 1 for two fingerprint strings: 1 for equal roots, else twice the distinct shared leaves over the sum
    of both sides' distinct leaves."""
    shared = "size(array_intersect(x, y))"
    # sizes of the distinct leaves: |x| + |y| = |x or y| + |x and y|
    dice = f"coalesce(2.0D * {shared} / nullif(size(array_union(x, y)) + {shared}, 0), 0.0D)"
    return f"if({a} = {b}, 1.0D, {let(pieces_of(a), 'x', let(pieces_of(b), 'y', dice))})"


def differing(a: str, b: str) -> str:
    """Numbers (from 0) of the paragraphs of tree ``a`` that tree ``b`` has not: where the edit is."""
    return f"""if({a}.root = {b}.root, CAST(array() AS array<int>),
      filter(transform({a}.paragraphs, (p, i) -> if(array_contains({b}.paragraphs, p), -1, i)), i -> i >= 0))"""


def _bounds(ids: DataFrame) -> tuple[list, bool, object]:
    """Ids that begin a bucket of some ``BUCKET_ROWS`` rows; whether there are null ids; the least id."""
    seen = ids.agg(F.count("*").alias("n"), F.count("id").alias("filled"), F.min("id").alias("least")).first()
    buckets = min(MOST_BUCKETS, seen["filled"] // BUCKET_ROWS)
    if buckets < 2:
        return [], seen["n"] > seen["filled"], seen["least"]
    shares = [i / buckets for i in range(1, buckets)]
    cuts = ids.agg(F.percentile_approx("id", shares, 10 * buckets).alias("c")).first()["c"]
    return sorted({c for c in cuts if c > seen["least"]}), seen["n"] > seen["filled"], seen["least"]


def _bucket(bounds: list) -> tuple[Column, Column]:
    """(number of bounds up to the id, whether the id is one), looked up in two steps of the root's length."""
    if not bounds:
        return F.lit(0), F.lit(False)
    width = int(len(bounds) ** 0.5) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    inner = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    outer = F.size(F.filter(heads, lambda b: b <= F.col("id")))
    group = F.get(inner, outer - 1)
    at = F.size(F.filter(group, lambda b: b <= F.col("id")))
    number = F.when(F.col("id").isNull() | (outer == 0), 0).otherwise((outer - 1) * width + at)
    return number, F.coalesce((outer > 0) & (F.get(group, at - 1) == F.col("id")), F.lit(False))


def with_next(df: DataFrame, bounds: list, nulls: bool, least, value: str) -> DataFrame:
    """``df`` (id, text, ...) with ``next``: the struct ``value`` of the row with the next id, after the last the first.

    Rows go to buckets of neighbouring ids; the row that begins a bucket is also sent to the bucket before as its
    end. Null ids come first; equal ids are in the order of their texts.
    """
    number, begins = _bucket(bounds)
    first = F.col("id").isNull() if nulls else F.col("id") == F.lit(least)
    own = F.struct(F.col("n_").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct((F.col("n_") - 1).alias("bucket"), F.lit(True).alias("guest"))
    last = F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(True).alias("guest"))
    places = F.concat(
        F.array(own), F.when(F.col("b_"), F.array(guest)).otherwise(F.array()), F.when(first, F.array(last)).otherwise(F.array())
    )
    rows = df.withColumn("n_", number).withColumn("b_", begins).withColumn("p_", F.explode(places))
    rows = rows.select(*df.columns, "p_.bucket", "p_.guest")
    lead = f"lead({value}) OVER (PARTITION BY bucket ORDER BY guest, id NULLS FIRST, text NULLS FIRST)"
    return rows.withColumn("next", F.expr(lead)).filter("NOT guest").drop("bucket", "guest")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter (rounded down, in code points) replaced by the beginning of the next
    document's text. Null texts count as empty; an only document is its own successor; null ids come first; rows
    that repeat an id follow each other in the order of their texts. Other columns are not read.
    """
    docs = df.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    bounds, nulls, least = _bounds(docs.select("id"))
    known = docs.withColumn("tree", F.expr(tree("text"))).withColumn("fp", F.expr(spelled("tree"))).drop("tree")
    rows = with_next(known, bounds, nulls, least, "struct(text, fp)").withColumn("n", F.length("text").cast("long"))
    edited = "concat(substring(text, 1, CAST(n - n div 4 AS int)), substring(next.text, 1, CAST(n div 4 AS int)))"
    rows = rows.withColumn("edited", F.expr(edited)).withColumn("tree", F.expr(tree("edited")))
    rows = rows.withColumn("edited_fp", F.expr(spelled("tree")))
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        F.expr(likeness("fp", "edited_fp")).alias("near_edited"), F.expr(likeness("fp", "next.fp")).alias("near_next"),
    )


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edited_fingerprints(table(spark, folder, "documents"))


def _sql_tree(name: str, source: str, text: str) -> str:
    section = SECTION.replace("*+", "*").replace("++", "+")
    return f"""
{name}_leaves AS (SELECT *, list_transform(string_split({text}, chr(10)),
    lambda p: list_transform(regexp_extract_all(p, '{PIECE}'), lambda q: md5(q))) AS leaves FROM {source}),
{name}_pars AS (SELECT *, list_transform(leaves, lambda a: md5(coalesce(array_to_string(a, ''), ''))) AS pars FROM {name}_leaves),
{name}_secs AS (SELECT *, list_transform(regexp_extract_all(array_to_string(pars, ' ') || ' ', '{section}'),
    lambda s: md5(s)) AS secs FROM {name}_pars),
{name} AS (SELECT * EXCLUDE (leaves, pars, secs), list_transform(flatten(leaves), lambda x: x[1:8]) AS {name}_pieces,
    sha256(array_to_string(secs, '')) || ':' || array_to_string(list_transform(secs, lambda x: x[1:8]), '') || ':' ||
    array_to_string(list_transform(pars, lambda x: x[1:8]), '') || ':' ||
    coalesce(array_to_string(list_transform(flatten(leaves), lambda x: x[1:8]), ''), '') AS {name}_fp FROM {name}_secs)"""


def _sql_likeness(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}_pieces, {b}_pieces))"
    both = f"len(list_distinct({a}_pieces)) + len(list_distinct({b}_pieces))"
    return f"CASE WHEN {a}_fp = {b}_fp THEN 1.0::DOUBLE ELSE coalesce(2.0::DOUBLE * {shared} / nullif({both}, 0), 0.0) END"


SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
{_sql_tree('own', 'docs', 'text')},
paired AS (SELECT *,
    coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text,
    coalesce(lead(own_fp) OVER w, first_value(own_fp) OVER w) AS next_fp,
    coalesce(lead(own_pieces) OVER w, first_value(own_pieces) OVER w) AS next_pieces
  FROM own WINDOW w AS (ORDER BY doc_id NULLS FIRST, text)),
changed AS (SELECT *, substr(text, 1, n - n // 4) || substr(next_text, 1, n // 4) AS edited FROM paired),
{_sql_tree('edit', 'changed', 'edited')}
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, own_fp AS fingerprint, edit_fp AS edited_fingerprint,
  {_sql_likeness('own', 'edit')} AS near_edited, {_sql_likeness('own', 'next')} AS near_next
FROM edit
"""
