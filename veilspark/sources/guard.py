"""Guarded reads: only queries, bound parameters, and always a row cap.

A statement is parsed before it runs, as Spark carries out commands while it plans them, and lets ``WITH`` and
``FROM`` stand before a write.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: rows per read
DEFAULT_ROWS = 100
MAX_ROWS = 1000

# plan nodes that change something or run a program, though they are no commands by their type
_ACTING = ("InsertIntoDir", "ScriptTransformation")
_OUTSIDE_CALLS = re.compile(r"(?i)\b(?:try_)?(?:reflect|java_method)\s*\(")


def is_select(sql: str) -> bool:
    return re.match(r"\s*(?:SELECT|WITH)", sql, re.IGNORECASE) is not None


def refuse_writes(spark: SparkSession, sql: str) -> None:
    """Raise unless the parsed statement only reads."""
    jvm = spark._jvm
    kinds = [
        jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{name}", True, jvm.Thread.currentThread().getContextClassLoader())
        for name in ("Command", "ParsedStatement")
    ]
    open_ = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while open_:
        node = open_.pop()
        if any(k.isInstance(node) for k in kinds) or node.getClass().getSimpleName() in _ACTING:
            raise ValueError(f"only SELECT queries are read; {node.nodeName()} is not one")
        for part in (node.children(), node.innerChildren()):
            open_ += [x for x in map(part.apply, range(part.size())) if hasattr(x, "innerChildren")]
    if _OUTSIDE_CALLS.search(sql):
        raise ValueError("calls to Java methods are not read")


def query_table(sql: str) -> str:
    """The word after the first FROM of a SELECT, less its schema, in capitals; '' if there is none."""
    found = re.search(r"\A\s*SELECT.*?FROM\s*(\S+)", sql.upper(), re.DOTALL)
    return found.group(1).partition(".")[2] or found.group(1) if found else ""


def guarded_select(
    spark: SparkSession,
    sql: str,
    params: Mapping[str, Any] | None = None,
    max_rows: int = DEFAULT_ROWS,
    order_by: Sequence[str] | None = None,
    cut_flag: str | None = None,
) -> DataFrame:
    """Run a SELECT or WITH and return at most ``max_rows`` of its rows; over 1000 is refused.

    With ``order_by`` they are the first in that order, as one top-k: every task keeps at most ``max_rows`` rows and
    only those are merged. Without, they are any rows, and nothing is sorted. ``cut_flag`` names a boolean column
    that says whether the query has more rows than were returned. Parameters are bound as ``:name``, never spliced.
    """
    if not is_select(sql):
        raise ValueError("only SELECT queries are read; use the write functions for changes")
    if not 0 <= max_rows <= MAX_ROWS:
        raise ValueError(f"max_rows must be from 0 to {MAX_ROWS}")
    refuse_writes(spark, sql)
    rows = spark.sql(sql, args=dict(params or {}))
    rows = rows.orderBy(*order_by) if order_by else rows
    if cut_flag is None:
        return rows.limit(max_rows)
    # one row more tells; the window is over max_rows + 1 rows at most
    some = rows.limit(max_rows + 1).withColumn(cut_flag, F.count(F.lit(1)).over(Window.partitionBy()) > max_rows)
    return (some.orderBy(*order_by) if order_by else some).limit(max_rows)
