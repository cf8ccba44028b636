"""Treatment of whole tables: decide per column, then treat every row.

The decision is one pass over the columns that need it, which ends in columns x entities rows; a sample is
taken only where the caller asks for one. The treatment is one projection without a shuffle, and the same
projection serves a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from ..functions import patterns as P
from ..functions.detectors import Detector
from ..functions.texts import anonymise_value
from ..functions.treatments import ACCESS_DENIED, BINARY_REMOVED, NONE, STRIPPED, TreatmentMap
from ..operators.detect import analyze_columns
from ..sources.tables import quoted

SAMPLE_ROWS = 20  # fixed value: rows of a table sample

# fixed values: why a column was treated
REASON_DENIED = "access denied by policy"
REASON_FORCED = "forced by policy"
REASON_BINARY = "binary column"
REASON_NAME = "pii from column name"
REASON_VALUES = "pii detected in values"

NULLED = "nulled"  # treatment of dates: a type that holds no note

REPORT_TYPE = (
    "column_name string, data_type string, scan_policy string, detected boolean,"
    " entities array<string>, confidence double, source string, treatment string, reason string,"
    " sampled_rows bigint"
)

_NESTED = (T.StructType, T.MapType, T.ArrayType, T.VariantType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class ColumnPolicy:
    """A standing rule for a column: deny it, or take it as personal data whatever it holds."""

    access: str = "allow"
    forced: bool = False


@dataclass(frozen=True)
class ColumnDecision:
    column: str
    data_type: str
    scan_policy: str = N.SAFE
    detected: bool = False
    entities: tuple[str, ...] = ()
    confidence: float = 0.0
    source: str = "none"
    treatment: str = NONE
    reason: str = ""
    sampled_rows: int | None = None  # rows that the decision looked at; None for all


@dataclass(frozen=True)
class TableDecisions:
    """What to do with each column of a table; made once, used for any number of batches."""

    columns: tuple[ColumnDecision, ...]
    treatments: TreatmentMap = field(default_factory=TreatmentMap)

    def __getitem__(self, column: str) -> ColumnDecision:
        return next(d for d in self.columns if d.column == column)


def _classes(df: DataFrame, typed: bool = True) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    frame = df.sparkSession.createDataFrame(rows, "column_name string, data_type string")
    return N.classify(frame, data_type="data_type" if typed else None)


def column_hints(df: DataFrame, typed: bool = True) -> dict[str, str]:
    """Scan policy per column, from names and types, or from names alone."""
    rows = _classes(df, typed).select("column_name", "hint_policy").collect()
    return {r.column_name: r.hint_policy for r in rows}


def with_json_text(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Nested columns (those named, or all) as JSON text, so that their contents can be scanned and treated."""
    chosen = {f.name for f in df.schema.fields if isinstance(f.dataType, _NESTED)}
    chosen = chosen if columns is None else chosen & set(columns)
    return df.select(
        *[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.name in chosen else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def table_sample(df: DataFrame, order_by: Sequence[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` rows by a stable key, as one top-k.

    The first key column is read alone to find its ``n``-th smallest value; the bound this gives is
    pushed to the scan, so that wide columns are read only where such keys are.
    """
    first = order_by[0]
    if set(df.columns) - set(order_by):
        bound = df.select(first).orderBy(first).limit(n).agg(F.max(first)).first()[0]
        key = F.col(f"`{first}`")
        df = df.filter(key.isNull() if bound is None else key.isNull() | (key <= F.lit(bound)))
    return df.orderBy(*order_by).limit(n)


def sample_groups(df: DataFrame, by: Sequence[str], keys: Sequence[str], n: int = SAMPLE_ROWS, seed: str = "") -> DataFrame:
    """``n`` rows of each group (all of a smaller one), those with the least digests of seed and keys: repeatable, spread evenly.

    Only group and key columns are read to choose. Each task keeps the least ``n`` of every group before the shuffle, so a
    group with a third of all rows sends ``n`` rows a task. The chosen keys then pick the rows by a semi-join. Nulls are a
    group of their own. Keys must be unique; rows with a null in a key are not sampled.
    """
    digest = F.md5(F.concat_ws("\x1f", F.lit(seed), *[F.col(quoted(k)).cast("string") for k in keys]).cast("binary"))
    narrow = df.select(*[F.col(quoted(c)) for c in dict.fromkeys([*by, *keys])]).dropna(subset=[quoted(k) for k in keys])
    order = Window.partitionBy(*[F.col(quoted(b)) for b in by]).orderBy("digest_", *[F.col(quoted(k)) for k in keys])
    first = narrow.withColumn("digest_", digest).withColumn("nth_", F.row_number().over(order)).filter(F.col("nth_") <= n)
    return df.join(first.select(*[F.col(quoted(k)) for k in keys]), list(keys), "left_semi")


def decide(
    df: DataFrame,
    hints: Mapping[str, str] | None = None,
    policies: Mapping[str, ColumnPolicy] | None = None,
    sample: int | None = None,
    order_by: Sequence[str] | None = None,
    treatments: TreatmentMap | None = None,
    detectors: Iterable[Detector] | None = None,
    min_score: float = P.MIN_SCORE,
    use_names: bool = True,
    also_named: Mapping[str, Sequence[str]] | None = None,
    scan: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> TableDecisions:
    """Decide each column by standing policy, then scan policy, then name, then values.

    All values count unless ``sample`` asks for the first rows by ``order_by`` only; the report then says so.
    ``hints`` gives scan policies; a column missing there is judged by its own name and type. ``also_named`` gives
    further names under which a column is judged, such as those of the columns it was selected from. A column whose
    name says what it holds is not read; ``use_names=False`` scans it nevertheless, and the name then stands unless
    the values score higher. Nested columns are scanned as JSON text. ``scan`` takes the place of ``analyze_columns`` for
    the columns to be read, such as to count in what was seen before.
    """
    treatments = treatments or TreatmentMap()
    policies, hints = policies or {}, hints or {}
    aliases = {c: [n for n in names if n != c] for c, names in (also_named or {}).items()}
    classes = _named_classes(df, aliases)
    entity_of = {c: next((e for e, _ in rows if e), "") for c, rows in classes.items()}
    # a hint may ask for less reading of a column, but not hide what its name says
    own_policy = {c: rows[0][1] for c, rows in classes.items()}
    policy_of = {c: hints.get(c, own_policy[c]) for c in df.columns}
    readable = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, *_NESTED))}

    def unsettled(column: str) -> bool:
        policy = policies.get(column, ColumnPolicy())
        if policy.access == "deny" or policy.forced or column not in readable:
            return False
        if policy_of[column] in (N.SAFE, N.STRIP):
            return False
        return not (entity_of[column] and use_names)

    to_scan = [c for c in df.columns if unsettled(c)]
    found: dict[str, list] = {}
    if to_scan:
        rows = df
        if sample is not None:
            keys = list(order_by or df.columns[:1])
            rows = table_sample(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keys, *to_scan])]), keys, sample)
        if scan is None:
            hits = analyze_columns(with_json_text(rows, to_scan), to_scan, detectors, min_score, boost=use_names)
        else:
            hits = scan(with_json_text(rows, to_scan), to_scan)
        # columns x entities rows at most
        for r in hits.orderBy("column_name", "rank").collect():
            found.setdefault(r.column_name, []).append(r)

    def one(f: T.StructField) -> ColumnDecision:
        column, kind = f.name, f.dataType.simpleString()
        make = partial(ColumnDecision, column, kind)
        policy = policies.get(column, ColumnPolicy())
        if policy.access == "deny":
            return make(N.SAFE, True, (), 0.0, "static_policy", STRIPPED, REASON_DENIED)
        if policy.forced:
            done = treatments.of(P.PERSON).kind
            return make(N.SAFE, True, (P.PERSON,), 1.0, "static_policy", done, REASON_FORCED)
        scan = policy_of[column]
        if scan == N.STRIP:
            return make(scan, True, (), 0.0, "opaque_type", STRIPPED, REASON_BINARY)
        hits, looked = found.get(column, []), sample if column in to_scan else None
        named = entity_of[column] if column in readable or isinstance(f.dataType, _DATES) else ""
        if named and scan != N.SAFE:
            entity, score, source = named, N.HINT_SCORE, "name_heuristic"
            if hits and hits[0].score > score:
                entity, score, source = hits[0].entity, hits[0].score, "value_scan"
            done = NULLED if isinstance(f.dataType, _DATES) else treatments.of(entity).kind
            return make(scan, True, (entity,), score, source, done, REASON_NAME, looked)
        if not hits:
            return make(scan, sampled_rows=looked)
        entities = tuple(r.entity for r in hits)
        done = treatments.of(entities[0]).kind
        return make(scan, True, entities, hits[0].score, "value_scan", done, REASON_VALUES, looked)

    return TableDecisions(tuple(one(f) for f in df.schema.fields), treatments)


def _named_classes(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> dict[str, list[tuple[str, str]]]:
    """(entity by name, scan policy) of each column under its own name, then under its further names."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(c, i, n, kinds[c]) for c in df.columns for i, n in enumerate([c, *aliases.get(c, ())])]
    frame = df.sparkSession.createDataFrame(rows, "owner string, place int, column_name string, data_type string")
    found: dict[str, list[tuple[str, str]]] = {}
    # one row per column and name
    for r in N.classify(frame).orderBy("owner", "place").collect():
        found.setdefault(r.owner, []).append((r.hint_entity or r.name_hint, r.hint_policy))
    return found


def treat_table(df: DataFrame, decisions: TableDecisions) -> DataFrame:
    """Treat every row: a projection, for a table or a stream.

    A text column is treated as its first entity, over the whole value; so is a nested column, which becomes JSON
    text for that. Dates become null. Nulls and other types pass. A denied or binary column is overwritten by a
    note, whatever its type.
    """
    by_name = {d.column: d for d in decisions.columns}

    def one(f: T.StructField) -> Column:
        column = F.col(f"`{f.name}`")
        decision = by_name[f.name]
        if decision.treatment == STRIPPED:
            note = ACCESS_DENIED if decision.source == "static_policy" else BINARY_REMOVED
            return F.when(column.isNotNull(), F.lit(note)).alias(f.name)
        if not decision.entities:
            return column
        if isinstance(f.dataType, _DATES):
            return F.lit(None).cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, _NESTED):
            column = F.to_json(column)
        elif not isinstance(f.dataType, T.StringType):
            return column
        return anonymise_value(column, F.lit(decision.entities[0]), decisions.treatments).alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


def column_report(spark: SparkSession, decisions: TableDecisions) -> DataFrame:
    rows = [
        (
            d.column,
            d.data_type,
            d.scan_policy,
            d.detected,
            list(d.entities),
            float(d.confidence),
            d.source,
            d.treatment,
            d.reason,
            d.sampled_rows,
        )
        for d in decisions.columns
    ]
    return spark.createDataFrame(rows, REPORT_TYPE)


def process_table(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Treated rows and the column report; options as for ``decide``."""
    decisions = decide(df, **options)
    return treat_table(df, decisions), column_report(df.sparkSession, decisions)
