"""Guarded reads with treatment, and reads that filter on tokens."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.treatments import TOKEN_PREFIX, detokenise, pseudonymise
from ..sources.guard import DEFAULT_ROWS, guarded_select, query_table
from .tables import column_hints, process_table


def open_token(spark: SparkSession, token: str, key: bytes) -> str:
    """The clear value of one token; fails on a wrong key, a changed token or no token at all."""
    row = spark.range(1).select(detokenise(F.lit(token), key).alias("d")).first()["d"]
    if row["error"] is not None:
        raise ValueError(row["error"])
    return row["value"]


def lineage(df: DataFrame) -> dict[str, list[str]]:
    """Names of the columns that each column of a query comes from, the nearest first, from its analyzed plan.

    Aliases are followed through joins, subqueries, views, common table expressions and aggregates. A column that is
    not renamed has its own name; columns computed without a source, and those behind a union, have no more names.
    """
    made: dict[int, list[tuple[int, str]]] = {}

    def references(expression) -> list[tuple[int, str]]:
        found = expression.references().toSeq()
        return [(found.apply(i).exprId().id(), found.apply(i).name()) for i in range(found.size())]

    def visit(node) -> None:
        expressions = node.expressions()
        for i in range(expressions.size()):
            e = expressions.apply(i)
            if e.getClass().getSimpleName() == "Alias":
                made[e.exprId().id()] = references(e.child())
        for part in (node.children(), node.innerChildren()):
            for i in range(part.size()):
                child = part.apply(i)
                if hasattr(child, "expressions"):
                    visit(child)

    plan = df._jdf.queryExecution().analyzed()
    visit(plan)

    out = plan.output()
    found: dict[str, list[str]] = {}
    for i in range(out.size()):
        name = out.apply(i).name()
        names: list[str] = []
        level, seen = {out.apply(i).exprId().id()}, set()
        while level:
            seen |= level
            nearest = sorted({x for number in level for x in made.get(number, ())}, key=lambda x: x[1])
            names += [n for _, n in nearest if n not in names]
            level = {number for number, _ in nearest} - seen
        found[name] = names or [name]
    return found


def treated_select(
    spark: SparkSession,
    sql: str,
    params: Mapping[str, Any] | None = None,
    max_rows: int = DEFAULT_ROWS,
    order_by: Sequence[str] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
    token_key: bytes | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """A guarded read whose rows are treated: (rows, column report).

    Every result column is judged by its own name, by the names of the columns it comes from (also through aliases
    and joins), and by all its values in the result. If the statement reads one of ``tables``, result columns of the
    same name take their scan policy from its types. With ``token_key``, parameters that are tokens are opened
    first, so a token from an earlier result can be used as a filter.
    """
    bound = dict(params or {})
    if token_key is not None:
        bound = {
            k: open_token(spark, v, token_key) if isinstance(v, str) and v.startswith(TOKEN_PREFIX) else v
            for k, v in bound.items()
        }
    rows = guarded_select(spark, sql, bound, max_rows, order_by)
    names = lineage(rows)
    # at most 1000 rows: taken once, as they are read for the decisions and for the result
    rows = spark.createDataFrame(rows.toArrow(), rows.schema)
    known = {name.upper(): df for name, df in (tables or {}).items()}
    source = known.get(query_table(sql))
    hints = None
    if source is not None:
        own, types = column_hints(source), dict(source.dtypes)
        hints = {c: own[c] for c, kind in rows.dtypes if types.get(c) == kind}
    return process_table(rows, **{"hints": hints, "also_named": names, **options})


def token_filter(df: DataFrame, column: str, token: Column | str, key: bytes) -> DataFrame:
    """Rows whose clear ``column`` makes the given token; the column comes back as token.

    Equal values make equal tokens, so the test needs no clear value.
    """
    tokens = pseudonymise(key).apply(F.col(column), F.lit(""))
    wanted = F.lit(token) if isinstance(token, str) else token
    return df.withColumn(column, tokens).filter(F.col(column) == wanted)


def token_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two treated tables on token or hash columns; clear values are not needed.

    Null and empty tokens stand for no value and match nothing. The right side must hold each key once, or the
    job fails: a default value that fills a third of both tables would otherwise give all its pairs. Aggregate the
    right side by the token first where it does not.
    """
    filled = " AND ".join(f"`{c}` IS NOT NULL AND `{c}` != ''" for c in on)
    checked = right.filter(filled).groupBy(*on).agg(
        *[F.first(c).alias(c) for c in right.columns if c not in on], F.count(F.lit(1)).alias("_held")
    )
    once = F.when(F.col("_held") == 1, True).otherwise(
        F.raise_error(F.lit(f"several rows of the right side have one {', '.join(on)}")).cast("boolean")
    )
    return left.filter(filled).join(checked.filter(once).drop("_held"), list(on), how)
