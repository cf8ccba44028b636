"""Previewed writes: a change is described first, and stored only on commit.

Parquet files are not changed in place. INSERT appends; UPDATE, DELETE and MERGE write the whole new
content to another folder, so that readers of the old one, and a retry after a lost executor, see the old
rows until the caller switches over.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MARK = "_hit"  # whether a row is affected


@dataclass(frozen=True)
class Change:
    """A change not yet made: ``marked`` has the new rows, and those that go, with ``MARK``; ``kept`` says which of
    them commit stores (all, if None)."""

    op: str
    marked: DataFrame
    kept: Column | None = None
    appends: bool = False

    @property
    def rows(self) -> DataFrame:
        """What commit stores."""
        return (self.marked if self.kept is None else self.marked.filter(self.kept)).drop(MARK)

    @property
    def affected(self) -> DataFrame:
        """A one-row count, ``rows_affected``."""
        return self.marked.agg(F.count_if(MARK).alias("rows_affected"))


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _result(change: Change, committed: bool) -> DataFrame:
    return change.affected.select(
        F.lit(change.op).alias("op"),
        F.col("rows_affected").cast("long").alias("rows_affected"),
        F.lit(committed).alias("committed"),
    )


def preview(change: Change) -> DataFrame:
    """One row (op, rows_affected, committed = false); nothing is stored."""
    return _result(change, False)


def commit(change: Change, path: str, read_only: bool = False) -> DataFrame:
    """Store the change below ``path`` and return (op, rows_affected, committed = true).

    Rows and their marks are computed once, into a folder beside, and both the count and what is stored come from
    there: the source may change meanwhile, and task counters repeat when a stage runs again.
    """
    if read_only:
        raise PermissionError("tables are read-only")
    spark = change.rows.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    change.marked.write.parquet(staged)
    rows = spark.read.schema(change.marked.schema).parquet(staged)
    count = rows.filter(F.col(MARK)).count()
    kept = rows.filter(change.kept) if change.kept is not None else rows
    kept.drop(MARK).write.mode("append" if change.appends else "errorifexists").parquet(path)
    _remove(spark, staged)
    return spark.createDataFrame(
        [(change.op, int(count), True)], "op string, rows_affected bigint, committed boolean"
    )


def _marked(
    target: DataFrame, where: str, params: Mapping[str, Any] | None, assign: Mapping[str, str] | None = None
) -> DataFrame:
    """The target with ``MARK``: whether the condition holds (unknown counts as no), and with the assigned values.

    Parameters are bound over the whole statement, assignments included.
    """
    new = "".join(f", ({value}) AS `_n_{column}`" for column, value in (assign or {}).items())
    return target.sparkSession.sql(
        f"SELECT *, coalesce(({where}), false) AS {MARK}{new} FROM {{target}}",
        args=dict(params or {}),
        target=target,
    )


def insert(target: DataFrame, rows: DataFrame) -> Change:
    """Add rows; columns are matched by name and cast to the target's types, missing ones are null."""
    given = set(rows.columns)
    unknown = given - set(target.columns)
    if unknown:
        raise ValueError(f"the target has no columns {sorted(unknown)}")
    fitted = rows.select(
        *[
            (F.col(f"`{f.name}`") if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ]
    )
    return Change("insert", fitted.withColumn(MARK, F.lit(True)), appends=True)


def update(
    target: DataFrame,
    assign: Mapping[str, str],
    where: str = "true",
    params: Mapping[str, Any] | None = None,
) -> Change:
    """Set columns to SQL expressions (over the old row) where the condition holds."""
    marked = _marked(target, where, params, assign)
    new = [
        (
            F.when(F.col(MARK), F.col(f"`_n_{f.name}`").cast(f.dataType)).otherwise(F.col(f"`{f.name}`"))
            if f.name in assign
            else F.col(f"`{f.name}`")
        ).alias(f.name)
        for f in target.schema.fields
    ]
    return Change("update", marked.select(*new, MARK))


def delete(target: DataFrame, where: str, params: Mapping[str, Any] | None = None) -> Change:
    """Drop rows for which the condition holds; rows for which it is unknown stay."""
    return Change("delete", _marked(target, where, params), kept=~F.col(MARK))


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> Change:
    """Update matched rows from the source, insert the unmatched ones.

    Two joins that keep the large side in place when the source is small (the planner broadcasts it only
    below its size limit), and that split skewed target keys when it is not: a full outer join could do
    neither. A source with two rows for one key has no defined outcome: the job fails on it. No job runs here.
    """
    changed = [c for c in source.columns if c not in keys]
    held = source.groupBy(*keys).agg(*[F.first(c).alias(c) for c in changed], F.count(F.lit(1)).alias("_held"))
    once = F.when(F.col("_held") == 1, True).otherwise(
        F.raise_error(F.lit("the source has several rows for one key")).cast("boolean")
    )
    source = held.filter(once).select(*source.columns)
    fresh = source.select(
        *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.col(f"`{c}`").alias(f"_n_{c}") for c in changed],
        F.lit(True).alias("_matched"),
    )
    same: list[Column] = [F.col(f"`{k}`") == F.col(f"_k{i}") for i, k in enumerate(keys)]
    joined = target.join(fresh, same, "left")
    updated = joined.select(
        *[
            (
                F.when(F.col("_matched"), F.col(f"`_n_{f.name}`").cast(f.dataType)).otherwise(
                    F.col(f"`{f.name}`")
                )
                if f.name in changed
                else F.col(f"`{f.name}`")
            ).alias(f.name)
            for f in target.schema.fields
        ],
        F.coalesce("_matched", F.lit(False)).alias(MARK),
    )
    present = target.select(*keys).distinct()
    inserted = insert(target, source.join(present, list(keys), "left_anti")).marked
    return Change("merge", updated.unionByName(inserted))
