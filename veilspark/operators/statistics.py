"""Statistics of columns kept per file, so that a later run reads new files only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import quoted
from .catalog import text_literal

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.NullType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_BROKEN = (T.FloatType, T.DoubleType, T.DecimalType)
_STATE_TYPE = (
    "file string, modified timestamp, column_name string, n_rows bigint, n_nulls bigint, low_whole bigint,"
    " high_whole bigint, low_real double, high_real double, low_text string, high_text string, sketch binary"
)


def _states(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per file and column, from one aggregate whose groups are the files."""
    aggs, columns = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(schema.fields):
        c, kind = quoted(f.name), f.dataType
        aggs.append(F.expr(f"count({c}) AS filled_{i}"))
        ends = {"whole": "CAST(NULL AS bigint)", "real": "CAST(NULL AS double)", "text": "CAST(NULL AS string)"}
        form = None
        if isinstance(kind, _WHOLE):
            ends["whole"], form = "CAST({}_{} AS bigint)", f"CAST({c} AS bigint)"
        elif isinstance(kind, _BROKEN):
            ends["real"], form = "CAST({}_{} AS double) + 0D", f"CAST({c} AS string)"
        elif isinstance(kind, T.BinaryType):
            form = c
        elif not isinstance(kind, _NESTED):
            ends["text"], form = "CAST({}_{} AS string)", f"CAST({c} AS string)"
        if form is not None:
            aggs.append(F.expr(f"hll_sketch_agg({form}) AS sketch_{i}"))
            aggs += [F.expr(f"min({c}) AS low_{i}"), F.expr(f"max({c}) AS high_{i}")]
        each = ", ".join(f"{ends[e].format(side, i)} AS {side}_{e}" for e in ends for side in ("low", "high"))
        sketch = f"sketch_{i}" if form is not None else "CAST(NULL AS binary)"
        # adding zero makes -0.0, which equals 0.0, the same value
        columns.append(
            f"struct({text_literal(f.name)} AS column_name, n AS n_rows, n - filled_{i} AS n_nulls, {each}, {sketch} AS sketch)"
        )
    counted = rows.groupBy("file_", "modified_").agg(*aggs)
    return counted.selectExpr("file_ AS file", "modified_ AS modified", f"inline(array({', '.join(columns)}))")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Path and modification time of the files of a table; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.selectExpr("_metadata.file_path AS file", "_metadata.file_modification_time AS modified")


def _kept(spark: SparkSession, state: str) -> DataFrame:
    try:
        return spark.read.schema(_STATE_TYPE).parquet(state)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STATE_TYPE)


def refresh_statistics(spark: SparkSession, path: str, state: str, schema: T.StructType | None = None) -> list[str]:
    """Add the states of files that ``state`` does not hold in their present form; the files that were read.

    A file is known by its path and modification time. Names of new files come to the driver, which lists the files
    for every scan anyway. Their rows are read once, and files that are known are not opened (give ``schema`` if not
    even for the schema). A refresh that dies leaves nothing, as states are added by one job with one commit; one that is done
    twice adds states that count once. Files without a row have no state and are looked at each time.
    """
    known = _kept(spark, state).select("file", "modified").distinct()
    new = [tuple(r) for r in _listed(spark, path).join(known, ["file", "modified"], "left_anti").collect()]
    if not new:
        return []
    reader = spark.read if schema is None else spark.read.schema(schema)
    table = reader.parquet(path)
    rows = table.select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_modification_time").alias("modified_"))
    rows = rows.filter(F.col("_metadata.file_path").isin([name for name, _ in new]))
    _states(rows, table.schema).write.mode("append").parquet(state)
    return sorted(name for name, _ in new)


def merged_statistics(spark: SparkSession, path: str, state: str, schema: T.StructType | None = None) -> DataFrame:
    """One row per column of the table, merged from the states of its present files.

    States of files that are gone or have changed do not count. Whole numbers and booleans have their ends in ``low_whole`` and
    ``high_whole``, other numbers in ``low_real`` and ``high_real`` (decimals rounded), texts, dates and times in ``low_text``
    and ``high_text``, nested and binary columns nowhere. ``n_distinct`` is an estimate from merged sketches, null for nested columns.
    """
    schema = schema or spark.read.parquet(path).schema
    states = _kept(spark, state).dropDuplicates(["file", "modified", "column_name"])
    states = states.join(_listed(spark, path), ["file", "modified"], "left_semi")
    ends = [f"{side}_{e}" for e in ("whole", "real", "text") for side in ("low", "high")]
    merged = states.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_nulls").alias("n_nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"),
        *[(F.min if e.startswith("low") else F.max)(e).alias(e) for e in ends],
    )
    plain = [(i, f.name, f.dataType.simpleString(), not isinstance(f.dataType, _NESTED)) for i, f in enumerate(schema.fields, 1)]
    columns = spark.createDataFrame(plain, "position int, column_name string, data_type string, plain boolean")
    zero = [F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("n_rows", "n_nulls")]
    distinct = F.when(F.col("plain"), F.coalesce("n_distinct", F.lit(0).cast("bigint"))).alias("n_distinct")
    return columns.join(merged, "column_name", "left").select("position", "column_name", "data_type", *zero, distinct, *ends)
