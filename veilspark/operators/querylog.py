"""Jobs over a table of logged SQL statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: statement classes and advice -------------------------------------------------
READ_WORDS = ("SELECT", "WITH")
WRITE_WORDS = (
    "INSERT", "UPDATE", "DELETE", "MERGE", "DROP", "CREATE", "ALTER", "TRUNCATE", "GRANT", "REVOKE",
)
ADVICE_STAR = "Consider selecting only needed columns instead of SELECT *"
ADVICE_LIKE = "Leading wildcards in LIKE predicates prevent index usage"
ADVICE_IN = "Consider using EXISTS instead of IN with subqueries for better performance"
ADVICE_OR = "OR conditions may prevent index usage. Consider UNION ALL of separated queries"
ADVICE_JOINS = ("Query joins ", " tables - consider reviewing join order and conditions")  # around their number


def _upper_trimmed(sql: Column) -> Column:
    return F.btrim(F.upper(sql), F.lit(" \t\n\r\f\x0b"))


def statement_class(sql: Column) -> Column:
    """``select``, ``write`` or ``other``, by the first word."""
    text = _upper_trimmed(sql)
    return (
        F.when(text.rlike(rf"\A(?:{'|'.join(READ_WORDS)})"), "select")
        .when(text.rlike(rf"\A(?:{'|'.join(WRITE_WORDS)})"), "write")
        .otherwise("other")
    )


def target_table(sql: Column) -> Column:
    """The table a statement reads or changes, in capitals and without schema; '' if not found.

    For a SELECT the word after the first FROM; else the word after INSERT INTO, UPDATE or DELETE FROM.
    """
    text = _upper_trimmed(sql)
    found = (
        F.when(text.startswith("SELECT"), F.regexp_extract(text, r"FROM\s*(\S+)", 1))
        .when(text.startswith("INSERT"), F.regexp_extract(text, r"\A\S+\s+\S+\s+(\S+)", 1))
        .when(text.startswith("UPDATE"), F.regexp_extract(text, r"\A\S+\s+(\S+)", 1))
        .when(text.startswith("DELETE"), F.regexp_extract(text, r"\A\S+\s+FROM\s+(\S+)", 1))
        .otherwise("")
    )
    return F.regexp_replace(found, r"\A[^.]*\.", "")


def query_log_audit(log: DataFrame, sql: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Statements per class and table, and per ``by`` columns."""
    return (
        log.select(
            *by,
            statement_class(F.col(sql)).alias("statement_class"),
            target_table(F.col(sql)).alias("target_table"),
        )
        .groupBy(*by, "statement_class", "target_table")
        .agg(F.count(F.lit(1)).alias("n_statements"))
    )


def advice(sql: Column) -> Column:
    """Array of advice texts for one statement."""
    text = F.upper(sql)
    n_joins = (F.length(text) - F.length(F.replace(text, F.lit(" JOIN "), F.lit("")))) / F.lit(6)
    return F.array_compact(
        F.array(
            F.when(text.contains("SELECT *"), ADVICE_STAR),
            F.when(text.contains(" LIKE '%"), ADVICE_LIKE),
            F.when(text.contains(" IN (SELECT ") & ~text.contains(" EXISTS"), ADVICE_IN),
            F.when(text.contains(" OR "), ADVICE_OR),
            F.when(
                n_joins > 2,
                F.concat(
                    F.lit(ADVICE_JOINS[0]),
                    (n_joins + 1).cast("int").cast("string"),
                    F.lit(ADVICE_JOINS[1]),
                ),
            ),
        )
    )


def query_log_lint(log: DataFrame, sql: str, by: tuple[str, ...] = ()) -> DataFrame:
    """How often each advice applies."""
    return (
        log.select(*by, F.explode(advice(F.col(sql))).alias("advice"))
        .groupBy(*by, "advice")
        .agg(F.count(F.lit(1)).alias("n_statements"))
    )
