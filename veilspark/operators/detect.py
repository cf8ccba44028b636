"""Detection jobs over tables of text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import patterns as P
from ..functions.detectors import (
    REFERENCE,
    Detector,
    analyze,
    analyze_sql,
    choose,
    raw_spans,
)
from ..functions.spans import let, merge_spans


def detect(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    entities: Iterable[str] | None = None,
    detectors: Iterable[Detector] | None = None,
    min_score: float = 0.0,
    mode: str = REFERENCE,
) -> DataFrame:
    """One row per hit: the key columns, entity, start, end, match, score, recognizer.

    A narrow job: only the key and text columns are read, and nothing is shuffled.
    """
    chosen = detectors if detectors is not None else choose(entities)
    hits = df.select(*keys, F.inline(raw_spans(text, chosen, mode)))
    return hits.filter(F.col("score") >= min_score) if min_score > 0 else hits


def detect_batches(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    function: Callable[[pd.Series], Iterable[Iterable[tuple[int, int, float]]]],
    entity: str,
    recognizer: str,
    gate: Callable[[Column], Column] | None = None,
    min_score: float = 0.0,
) -> DataFrame:
    """As ``detect``, by a user's function of an Arrow batch of texts: a list of hits (start, end, score) for each text.

    ``start`` and ``end`` count characters; the result has byte offsets like all detectors. Null texts and those that ``gate``,
    a cheap built-in condition on the text column, rules out do not reach Python. A hit that is empty or not inside its text is an error.
    """

    def place(value: str, hit: tuple[int, int, float]) -> tuple[int, int, str, float]:
        start, end, score = hit
        if not 0 <= start < end <= len(value):
            raise ValueError(f"hit {start}..{end} is not in a text of {len(value)} characters")
        low, match = len(value[:start].encode()), value[start:end]
        return low, low + len(match.encode()), match, float(score)

    def find(texts: pd.Series) -> pd.Series:
        hits = list(function(texts))
        if len(hits) != len(texts):
            raise ValueError(f"the recognizer gave {len(hits)} lists for {len(texts)} texts")
        return pd.Series([[place(v, h) for h in row] for v, row in zip(texts, hits)], dtype=object)

    batches = F.pandas_udf(find, "array<struct<start: int, end: int, match: string, score: double>>")
    rows = df.select(*keys, F.col(text).alias("text_")).filter("text_ IS NOT NULL")
    rows = rows if gate is None else rows.filter(gate(F.col("text_")))
    found = rows.select(*keys, F.inline(batches("text_"))).filter(F.col("score") >= min_score)
    return found.select(*keys, F.lit(entity).alias("entity"), "start", "end", "match", "score", F.lit(recognizer).alias("recognizer"))


def analyze_texts(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    detectors: Iterable[Detector] | None = None,
    min_score: float = P.MIN_SCORE,
    mode: str = REFERENCE,
) -> DataFrame:
    """As ``detect`` over all entities, with one row for each distinct extent within a text."""
    return df.select(*keys, F.inline(analyze(text, detectors, min_score, mode)))


def _per_entity(spans: str) -> str:
    """From a span array, ``array<struct<entity, hits>>`` with one element per entity."""
    return f"""transform(array_distinct(transform({spans}, s -> s.entity)),
      e -> named_struct('entity', e, 'hits', size(filter({spans}, s -> s.entity = e))))"""


def entity_profile(
    df: DataFrame,
    text: str,
    by: Sequence[str],
    detectors: Iterable[Detector] | None = None,
    min_score: float = P.MIN_SCORE,
    cube: bool = False,
) -> DataFrame:
    """Hits, rows with a hit and their share, per group and entity.

    Hits are counted within the row first, so no distinct count is needed. The first aggregate leaves
    (groups x entities) rows, whatever the table size or the skew of the groups; totals, cube and shares
    work on that.
    """
    counted = F.expr(let(analyze_sql(text, detectors, min_score), "sp", _per_entity("sp")))
    # one extra element without entity counts the row itself
    whole_row = F.array(F.struct(F.lit(None).cast("string").alias("entity"), F.lit(0).alias("hits")))
    exploded = df.select(*by, F.inline(F.concat(counted, whole_row)))
    sums = exploded.groupBy(*by, "entity").agg(
        F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("rows_hit")
    )
    group = list(by)
    if cube:
        # the row counts of all levels come from the finest level
        level = F.grouping_id().alias("level")
        flagged = sums.withColumn("is_total", F.col("entity").isNull()).withColumn(
            "entity", F.coalesce("entity", F.lit(""))
        )
        sums = (
            flagged.cube(*[F.col(c) for c in by], "entity", "is_total")
            .agg(F.sum("hits").alias("hits"), F.sum("rows_hit").alias("rows_hit"), level)
            .filter(F.col("entity").isNotNull() & F.col("is_total").isNotNull())
            .withColumn("entity", F.when(~F.col("is_total"), F.col("entity")))
            .drop("is_total")
        )
        group = [*by, "level"]
    per_group = Window.partitionBy(*group)
    totals = F.max(F.when(F.col("entity").isNull(), F.col("rows_hit"))).over(per_group)
    return (
        sums.withColumn("n_rows", totals)
        .filter(F.col("entity").isNotNull())
        .select(
            *by,
            "entity",
            "hits",
            "rows_hit",
            "n_rows",
            (F.col("rows_hit") / F.col("n_rows")).alias("share"),
        )
    )


def entity_values(
    df: DataFrame,
    text: str,
    by: Sequence[str],
    detectors: Iterable[Detector] | None = None,
    min_score: float = P.MIN_SCORE,
    cube: bool = False,
    sketch: bool = False,
) -> DataFrame:
    """Distinct values found, per group and entity: the ``by`` columns, level, entity, n_distinct.

    Equal values of a group meet in the task first, as digests, and once more in one shuffle. Only what is left is repeated
    for the levels of a ``cube``, so rows and repeated values are not. ``level`` has a bit for each ``by`` column (the last
    one lowest) that the row sums over; it is 0 without ``cube``. With ``sketch`` a group and entity is one HLL sketch of
    some kilobytes, levels merge sketches, and the count is an estimate, some percent off.
    """
    hits = df.select(*by, F.inline(analyze(text, detectors, min_score)))
    found = hits.select(*by, "entity", F.unhex(F.sha2("match", 256)).alias("value_"))
    if sketch:
        finest = found.groupBy(*by, "entity").agg(F.hll_sketch_agg("value_").alias("value_"))
        count = F.hll_sketch_estimate(F.hll_union_agg("value_"))
    else:
        finest = found.distinct()
        count = F.count(F.lit(1))
    top = 2 ** len(by) - 1 if cube else 0
    levels = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    for i, c in enumerate(reversed(list(by))):
        levels = levels.withColumn(c, F.when(F.col("level").bitwiseAND(1 << i) == 0, F.col(c)))
    levels = levels if sketch or not cube else levels.distinct()
    return levels.groupBy(*by, "level", "entity").agg(count.alias("n_distinct"))


def column_hits(
    df: DataFrame,
    columns: Sequence[str],
    detectors: Iterable[Detector] | None = None,
) -> DataFrame:
    """What the values of string columns hold: one row per (column, entity), and one without entity.

    ``n_values`` counts the values that are not null, ``hits`` those with a hit of the entity,
    ``score`` is the best raw score, and ``lead`` the first place (start, longest, best score) at which
    the entity is the best reading of its extent. All columns go through one set of expressions and one
    aggregate with a result of (columns x entities) rows. The lead is one number until then: the least of a struct
    would make the aggregate sort every row of a task, where numbers are kept in a small hash table.
    """
    long = df.select(*[F.col(f"`{c}`") for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    lead = "shiftleft(CAST({0}.start AS bigint), 32) - {0}.end"
    one = f"""array(named_struct('entity', found[0].entity, 'score', found[0].score,
      'lead', CASE WHEN found[0].score >= 0.0D THEN {lead.format("found[0]")} END))"""
    per_entity = f"""transform(array_distinct(transform(found, s -> s.entity)), e -> named_struct(
        'entity', e,
        'score', array_max(transform(filter(found, s -> s.entity = e), s -> s.score)),
        'lead', array_min(transform(filter(best, s -> s.entity = e), s -> {lead.format("s")}))))"""
    merged = let(merge_spans("found", 0.0), "best", per_entity)
    # each step is a projection of its own, which Spark compiles; inside a generator, all of it would be interpreted
    spans = long.filter(F.col("value").isNotNull()).select("column_name", raw_spans("value", detectors).alias("found"))
    summary = F.expr(f"CASE WHEN size(found) = 1 THEN {one} WHEN size(found) > 1 THEN {merged} END")
    rows = spans.select("column_name", summary.alias("entities")).select(
        "column_name", F.posexplode_outer("entities").alias("place", "e")
    )
    sums = rows.groupBy("column_name", F.col("e.entity").alias("entity")).agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if(F.col("place").isNull() | (F.col("place") == 0)).alias("heads"),
        F.max("e.score").alias("score"),
        F.min("e.lead").alias("lead"),
    )
    # start * 2^32 - end, where end is from 0 to 2^31 - 1
    start = "CAST(shiftright(lead + 4294967295, 32) AS int)"
    lead = f"CASE WHEN lead IS NOT NULL THEN named_struct('start', {start}, 'neg_end', CAST(lead - shiftleft(CAST({start} AS bigint), 32) AS int)) END"
    return sums.withColumn("lead", F.expr(lead))


def analyze_columns(
    df: DataFrame,
    columns: Sequence[str],
    detectors: Iterable[Detector] | None = None,
    min_score: float = P.MIN_SCORE,
    boost: bool = True,
    use_names: bool = False,
) -> DataFrame:
    """Entities found in the values of string columns, with the boost for frequent ones.

    With ``use_names`` a column whose name says what it holds is settled by that: its one row has the entity, the
    score of a name, and neither hits nor values, as none are read.

    An entity found in at least half of a column's values (integer division) is lifted to score 0.80;
    this is how weak patterns come to count. The result is small and has for each column the entities
    in order of their first place.
    """
    if use_names:
        spark = df.sparkSession
        named = N.classify(spark.createDataFrame([(c,) for c in columns], "column_name string"), data_type=None)
        known = named.filter("name_hint != ''").selectExpr(
            "column_name", "name_hint AS entity", "CAST(NULL AS bigint) AS hits", "CAST(NULL AS bigint) AS n_values",
            "name_hint_score AS score", "1 AS rank",
        )
        settled = {r["column_name"] for r in known.select("column_name").collect()}  # columns at most
        rest = [c for c in columns if c not in settled]
        return known.unionByName(analyze_columns(df, rest, detectors, min_score, boost)) if rest else known
    return judge_hits(column_hits(df, columns, detectors), min_score, boost)


def judge_hits(hits: DataFrame, min_score: float = P.MIN_SCORE, boost: bool = True) -> DataFrame:
    """The rows of ``analyze_columns`` from those of ``column_hits``, or from sums of them over parts of a table."""
    per_column = Window.partitionBy("column_name")
    boosted: Column = F.col("score")
    if boost:
        often = F.col("hits") >= F.floor(F.col("n_values") / 2)
        boosted = F.when(often, F.greatest("score", F.lit(P.BOOSTED))).otherwise(F.col("score"))
    return (
        hits.withColumn("n_values", F.sum("heads").over(per_column))
        .filter(F.col("entity").isNotNull())
        .withColumn("score", boosted)
        .filter((F.col("score") >= min_score) & F.col("lead").isNotNull())
        .withColumn(
            "rank",
            F.row_number().over(
                per_column.orderBy("lead.start", "lead.neg_end", F.desc("score"), "entity")
            ),
        )
        .select("column_name", "entity", "hits", "n_values", "score", "rank")
    )
