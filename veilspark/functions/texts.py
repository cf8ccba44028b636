"""Treatment of free text and of whole values, with a report per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .detectors import SAFE, Detector, analyze_sql
from .spans import EMPTY, cut_overlaps, join_overlaps, let
from .treatments import (
    NONE,
    TRUNCATED_AND_REDACTED,
    TRUNCATED_REDACTED,
    TreatmentMap,
    truncated_text,
)


def anonymise_text(
    text: str,
    treatments: TreatmentMap | None = None,
    detectors: Iterable[Detector] | None = None,
    min_score: float = P.MIN_SCORE,
    withhold_over: int | None = None,
    mode: str = SAFE,
) -> Column:
    """``struct<text, report>`` for the string column named ``text``.

    In safe mode overlapping spans are replaced as one, from the first start to the last end, named by the best
    score, then the longest. In reference mode spans are replaced left to right, and one that starts inside the last
    replaced span is skipped. A text without personal data stays as it is. Texts of any length are treated; with
    ``withhold_over``, a text of more bytes with any hit is withheld whole instead.
    """
    treatments = treatments or TreatmentMap()
    found = F.expr(
        let(
            analyze_sql(text, detectors, min_score, mode),
            "sp",
            f"named_struct('spans', sp, 'kept', {join_overlaps('sp') if mode == SAFE else cut_overlaps('sp')})",
        )
    )
    original = F.col(text)
    row = F.struct(found.alias("found"), original.cast("binary").alias("raw"), original.alias("text"))

    def result(x: Column) -> Column:
        spans, kept, raw = x["found"]["spans"], x["found"]["kept"], x["raw"]
        untouched = F.size(spans) == 0
        size = F.octet_length(x["text"])
        too_long = F.lit(False) if withhold_over is None else size > withhold_over

        def piece(s: Column) -> Column:
            gap = F.substring(raw, s["prev"] + F.lit(1), s["start"] - s["prev"]).cast("string")
            covered = F.substring(raw, s["start"] + F.lit(1), s["end"] - s["start"]).cast("string")
            return F.concat(gap, treatments.apply(covered, s["entity"]))

        last = F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0))
        tail = F.substring(raw, last + F.lit(1), size - last).cast("string")
        spliced = F.concat(F.array_join(F.transform(kept, piece), ""), tail)
        # every kind that was applied, so that a mixed treatment reads e.g. "masked,redacted"
        kinds = F.array_join(
            F.array_sort(F.array_distinct(F.transform(kept, lambda s: treatments.kind(s["entity"])))), ","
        )
        withheld = ~untouched & too_long
        report = F.struct(
            (~untouched).alias("detected"),
            spans.alias("entities"),
            F.when(untouched, NONE)
            .when(withheld, TRUNCATED_AND_REDACTED)
            .otherwise(kinds)
            .alias("treatment"),
            F.when(untouched, "")
            .when(withheld, "content truncated and redacted")
            .otherwise("anonymised")
            .alias("treatment_reason"),
            F.when(withheld, size).otherwise(0).alias("original_length"),
            F.when(withheld, F.lit(withhold_over or 0)).otherwise(0).alias("truncated_at"),
        )
        treated = (
            F.when(untouched, x["text"]).when(too_long, TRUNCATED_REDACTED).otherwise(spliced)
        )
        return F.struct(treated.alias("text"), report.alias("report"))

    return F.transform(F.array(row), result)[0]


def anonymise_value(value: Column, entity: Column, treatments: TreatmentMap | None = None) -> Column:
    """The whole value is taken to be of ``entity``; a null value or entity leaves it as it is."""
    treatments = treatments or TreatmentMap()
    treated = treatments.apply(value, entity)
    return F.when(value.isNull() | entity.isNull(), value).otherwise(treated)


def anonymise_value_report(value: Column, entity: Column, treatments: TreatmentMap | None = None) -> Column:
    """What ``anonymise_value`` did: one span over the whole value, certain, found by no detector."""
    treatments = treatments or TreatmentMap()
    whole = F.array(
        F.struct(
            entity.alias("entity"),
            F.lit(0).alias("start"),
            F.octet_length(value).alias("end"),
            value.alias("match"),
            F.lit(1.0).alias("score"),
            F.lit("direct").alias("recognizer"),
        )
    )
    known = value.isNotNull() & entity.isNotNull()
    return F.struct(
        known.alias("detected"),
        F.when(known, whole).otherwise(F.expr(EMPTY)).alias("entities"),
        F.when(known, treatments.kind(entity)).otherwise(NONE).alias("treatment"),
        F.when(known, "anonymised").otherwise("").alias("treatment_reason"),
    )


def truncate_text(value: Column, max_bytes: int) -> Column:
    """Texts over the limit become a note of the limit."""
    return F.when(F.octet_length(value) > max_bytes, truncated_text(max_bytes)).otherwise(value)
