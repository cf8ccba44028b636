"""A catalog measured from the data: tables, columns, name search."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from ..sources.tables import quoted


def text_literal(value: str) -> str:
    """A string as a SQL literal, whatever characters it holds."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table_inventory(tables: Mapping[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Rows, columns and share of nulls per table; of the first ``limit`` tables by name, if given.

    Each table is one scan with counters only. The cut takes names before anything is read.
    """
    chosen = sorted(tables)[:limit]

    def one(name: str) -> DataFrame:
        df = tables[name]
        width = len(df.columns)
        filled = " + ".join(f"count({quoted(c)})" for c in df.columns) or "0"
        return df.selectExpr(
            f"{text_literal(name)} AS table_name",
            "count(1) AS n_rows",
            f"{width} AS n_columns",
            f"if(count(1) = 0, 0.0D, 1 - ({filled}) / (count(1) * {width})) AS null_share",
        )

    return _union([one(name) for name in chosen])


def column_catalog(
    tables: Mapping[str, DataFrame], distinct: str | None = None, classified: bool = True, lengths: bool = False
) -> DataFrame:
    """One row per column: place, type, nullability, nulls, shortest and longest value, classes.

    One aggregate per table, then one row of counters is turned into one row per column. Lengths are null unless
    ``lengths`` asks for them: they read every text, the other counters need Parquet footers alone.
    ``distinct="approx"`` adds a sketch-based distinct count in the same scan; ``"exact"`` an exact one,
    which shuffles the values of every column.
    """
    counter = {None: None, "approx": "approx_count_distinct(", "exact": "count(DISTINCT "}[distinct]

    def one(name: str) -> DataFrame:
        df = tables[name]
        aggs, rows = ["count(1) AS n"], []
        for i, field in enumerate(df.schema.fields):
            column = quoted(field.name)
            text = lengths and isinstance(field.dataType, (T.StringType, T.BinaryType))
            aggs.append(f"count({column}) AS filled{i}")
            if text:
                aggs.append(f"min(octet_length({column})) AS min{i}")
                aggs.append(f"max(octet_length({column})) AS max{i}")
            if counter:
                aggs.append(f"{counter}{column}) AS distinct{i}")
            rows.append(
                f"""named_struct('table_name', {text_literal(name)}, 'position', {i + 1},
                  'column_name', {text_literal(field.name)}, 'data_type', {text_literal(field.dataType.simpleString())},
                  'nullable', {str(field.nullable).lower()}, 'n_rows', n, 'n_nulls', n - filled{i},
                  'min_length', {f"min{i}" if text else "CAST(NULL AS int)"},
                  'max_length', {f"max{i}" if text else "CAST(NULL AS int)"}
                  {f", 'n_distinct', distinct{i}" if counter else ""})"""
            )
        return df.selectExpr(*aggs).selectExpr(f"array({', '.join(rows)}) AS columns")

    # the arrays are united before they are opened, so that the classes are planned once, not per table
    catalog = _union([one(name) for name in sorted(tables)]).selectExpr("inline(columns)")
    return classify_columns(catalog) if classified else catalog


def names_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Table and column names and types alone; reads no data. This is what a search by name needs."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, i + 1, f.name, f.dataType.simpleString(), f.nullable)
        for name in sorted(tables)
        for i, f in enumerate(tables[name].schema.fields)
    ]
    kind = "table_name string, position int, column_name string, data_type string, nullable boolean"
    return spark.createDataFrame(rows, kind)


def classify_columns(catalog: DataFrame) -> DataFrame:
    """Add scan policy, scan length, entity and hint to a catalog of columns."""
    return N.classify(catalog)


def describe_table(catalog: DataFrame, edges: DataFrame, table: str) -> DataFrame:
    """Columns of one table, each with the columns it refers to and is referred to by.

    ``edges`` holds one row per foreign key, as ``fk_discovery`` gives it: metadata, not data.
    """
    out = edges.filter(F.col("child_table") == table).select(
        F.col("child_column").alias("column_name"),
        F.concat(F.lit("-> "), "parent_table", F.lit("."), "parent_column").alias("link"),
    )
    back = edges.filter(F.col("parent_table") == table).select(
        F.col("parent_column").alias("column_name"),
        F.concat(F.lit("<- "), "child_table", F.lit("."), "child_column").alias("link"),
    )
    links = (
        out.unionByName(back)
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_set("link")).alias("links"))
    )
    return (
        catalog.filter(F.col("table_name") == table)
        .join(links, "column_name", "left")
        .withColumn("links", F.coalesce("links", F.array().cast("array<string>")))
    )


def search_tables(catalog: DataFrame, term: str, limit: int | None = None) -> DataFrame:
    """Tables of a catalog or inventory whose name holds ``term``, whatever the case; the term is taken literally.

    With ``limit``, the first so many by name.
    """
    found = catalog.filter(F.upper("table_name").contains(term.upper()))
    if "column_name" in catalog.columns:
        found = found.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"))
    return found if limit is None else found.orderBy("table_name").limit(limit)


def search_columns(catalog: DataFrame, term: str, limit: int | None = None) -> DataFrame:
    """Columns whose name holds ``term``; with ``limit``, those of the first so many tables by name."""
    found = catalog.filter(F.upper("column_name").contains(term.upper()))
    if limit is None:
        return found
    return found.join(found.select("table_name").distinct().orderBy("table_name").limit(limit), "table_name", "left_semi")
